import math
import random
from collections import Counter

import pytest

from wayloom.llm import bloom, pst


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def tokens(text):
    return [*pst.words_of(text), pst.END]


class Plain:
    """The same model by plain counting of all contexts."""

    def __init__(self, train, depth=pst.DEPTH, min_count=pst.MIN_COUNT, listed=pst.LISTED, gain=pst.GAIN, kappa=pst.KAPPA):
        self.c = Counter(w for t in train for w in tokens(t))
        self.total = sum(self.c.values()) + 0.1 * (len(self.c) + 1)
        self.kappa, self.depth, self.kept = kappa, depth, {}
        after = {}
        for t in train:
            own = tokens(t)
            for i in range(len(own)):
                for k in range(1, min(depth, i) + 1):
                    after.setdefault(tuple(own[i - k : i]), Counter())[own[i]] += 1
        for ctx in sorted(after, key=len):
            n = after[ctx].total()
            if n < min_count:
                continue
            some = {w: k for w, k in after[ctx].items() if k >= listed}
            rest = n - sum(some.values())
            up = {w: self.p(ctx[1:], w) for w in after[ctx]}
            own = {w: (some.get(w, 0) + (kappa + rest) * up[w]) / (n + kappa) for w in after[ctx]}
            if sum(k * math.log(own[w] / up[w]) for w, k in after[ctx].items()) >= gain:
                self.kept[ctx] = (n, some, rest)

    def p(self, ctx, w):
        while ctx and ctx not in self.kept:
            ctx = ctx[1:]
        if not ctx:
            return (self.c[w] + 0.1) / self.total
        n, some, rest = self.kept[ctx]
        return (some.get(w, 0) + (self.kappa + rest) * self.p(ctx[1:], w)) / (n + self.kappa)

    def score(self, text):
        own = tokens(text)
        return sum(math.log10(self.p(tuple(own[max(0, i - self.depth) : i]), w)) for i, w in enumerate(own))

    def base(self, text):
        return sum(math.log10((self.c[w] + 0.1) / self.total) for w in tokens(text))


def compare(spark, train, test, head=pst.HEAD, head_grams=pst.HEAD_GRAMS, **params):
    plain = Plain(train, **params)
    tree, vocab = pst.fit(frame(spark, train), head=head, head_grams=head_grams, **params)
    assert tree.grams.where("w is null").count() == len(plain.kept)
    assert tree.grams.where("w is not null").count() == sum(len(some) for _, some, _ in plain.kept.values())
    got = {r.id: r for r in pst.score(frame(spark, test), tree, vocab).collect()}
    for i, t in enumerate(test):
        own = tokens(t)
        assert (got[i].n_tokens, got[i].n_known) == (len(own), sum(w in plain.c for w in own))
        assert got[i].base_score == pytest.approx(plain.base(t), rel=1e-9)
        assert got[i].score == pytest.approx(plain.score(t), rel=1e-5), t
    return plain


@pytest.mark.parametrize("head, head_grams", [(pst.HEAD, pst.HEAD_GRAMS), (3, 0), (40, 300)])
def test_scores_equal_brute_force(spark, head, head_grams):
    rng = random.Random(8)
    names = [f"name{i}" for i in range(60)]

    def text():
        i = [rng.randrange(60) for _ in range(8)]
        return " ".join(f"{names[k]} lives in the {names[k][::-1]} Street" if rng.random() < 0.8 else f"{names[k]} {rng.choice(names)} of" for k in i)

    train = [text() for _ in range(400)] + [f"{p} k1 k2 k3 {q}" for p, q in ("xy", "zv") for _ in range(30)] + [f"{p} m1 m2 m3 m4 {q}" for p, q in ("xy", "zv") for _ in range(30)] + [None, "", "a a a a a a a a a"]
    test = train[:20] + train[-4:] + [text() for _ in range(20)] + ["unknown name3 lives in", "name3", "x" * 5000, "x k1 k2 k3 y", "z m1 m2 m3 m4 y", "a a a a a a a a a a a a"]
    plain = compare(spark, train, test, head, head_grams, gain=4.0)
    assert {len(ctx) for ctx in plain.kept} >= {1, 2, 4, 5}


@pytest.mark.parametrize("depth", [1, 3])
def test_random_text_equals_brute_force(spark, depth):
    rng = random.Random(depth)
    follow = {"a": "b", "b": "c", "c": "a"}

    def text():
        w = [rng.choice("abc")]
        while len(w) < 30:
            w.append(follow[w[-1]] if rng.random() < 0.6 else rng.choice("abcdé"))
            w[-1] in follow or w.append("a")
        return " ".join(w)

    train = [text() for _ in range(60)]
    compare(spark, train, train[:10] + [text() for _ in range(10)], depth=depth, gain=3.0, min_count=5, listed=2)


def test_probabilities_sum_to_one(spark):
    train = ["a b a b c"] * 300 + ["c a c b"] * 200
    plain = Plain(train, gain=1.0)
    assert plain.kept
    for ctx in plain.kept:
        assert sum(plain.p(ctx, w) for w in plain.c) + 0.1 / plain.total == pytest.approx(1, abs=1e-4)


def test_contexts_help_where_order_matters(spark):
    rng = random.Random(1)
    flat = [" ".join(rng.choice("abc") for _ in range(40)) for _ in range(200)]
    tree, _ = pst.fit(frame(spark, flat), depth=1, gain=20.0)
    assert tree.grams.where("w is not null and c > 200").count() <= 3  # the end after 40 words only


def test_filter_rows_are_pages(spark, monkeypatch):
    """What tasks send of a filter is bounded by its pages and doesn't grow with the rows."""
    from pyspark.sql import functions as F

    sent = []
    rows = spark.range(200_000, numPartitions=3).select(F.xxhash64("id").alias("hash"))
    whole = type(rows).mapInPandas

    def counted(self, *args, **more):
        out = whole(self, *args, **more)
        sent.append(out)
        return out

    monkeypatch.setattr(type(rows), "mapInPandas", counted)
    packed = bloom.bloom_filter(rows)
    monkeypatch.undo()
    assert len(packed) == 1 << 19 and sent[0].count() <= 3 * 32
    h = rows.toPandas()["hash"].to_numpy().view("uint64")
    assert bloom.passes(packed, h).all()
    plain = [0] * len(packed)
    for x in h.tolist():
        for at in (x & 8 * len(packed) - 1, x >> 32 & 8 * len(packed) - 1):
            plain[at >> 3] |= 1 << (at & 7)
    assert packed.tolist() == plain
    assert not bloom.bloom_filter(rows.limit(0)).any()


def test_large_ids_beside_null(spark):
    rows = spark.createDataFrame([((1 << 60) + 1, "a b"), (None, "a b"), ((1 << 60) + 3, None)], "doc_id long, text string").coalesce(1)
    tree, vocab = pst.fit(rows.select("text"))
    assert {r.id for r in pst.score(rows, tree, vocab).collect()} == {(1 << 60) + 1, None, (1 << 60) + 3}


def test_odd_rows(spark, odd, none):
    tree, vocab = pst.fit(odd.select("text"))
    assert pst.score(odd, tree, vocab).count() == odd.count()
    assert pst.score(none, tree, vocab).count() == 0
    empty, v = pst.fit(none.select("text"))
    assert pst.score(odd, empty, v).count() == odd.count()


def test_tasks_send_packed_rows(spark, monkeypatch):
    """What tasks send is a row a bucket and batch of texts, whatever the number of look-ups and counts."""
    rng = random.Random(3)
    train = [" ".join(f"w{rng.randrange(300)}" for _ in range(200)) for _ in range(300)]
    tree, vocab = pst.fit(frame(spark, train), head=3, head_grams=0, gain=0.5, min_count=5)
    assert tree.filters
    sent = []
    docs = frame(spark, train).coalesce(2)
    whole = type(docs).mapInPandas

    def counted(self, *args, **more):
        out = whole(self, *args, **more)
        sent.append(out)
        return out

    monkeypatch.setattr(type(docs), "mapInPandas", counted)
    pst.score(docs, tree, vocab)
    pst.gram_counts(pst.symbols_of(docs), range(1, 3), tree, *[pst.bloom_filter(vocab, "w")] * 2)
    monkeypatch.undo()
    assert sent and all(x.count() <= 40 for x in sent)


def test_packs_give_back_arrays():
    import numpy as np

    from wayloom.llm import packs

    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    some = [packs.steps(keys), np.array([1.5, np.nan]), np.zeros(0, np.uint32), np.array([-1, 7], np.int32), np.array([3], np.uint8)]
    got = packs.unpack(packs.pack(*some))
    assert [x.dtype for x in got] == [x.dtype for x in some] and all(np.array_equal(a, b, equal_nan=a.dtype.kind == "f") for a, b in zip(got, some))
    assert (packs.whole(got[0]) == keys).all() and (packs.whole(packs.steps(keys[::-1])) == keys[::-1]).all()
    assert packs.n_buckets(0) == 1 and packs.n_buckets(3 << 20) == 4
    assert (np.diff(packs.bucket_of(keys, 8)) >= 0).all() and packs.bucket_of(keys, 8).max() == 7


def test_totals_part_contexts_with_equal_keys():
    """Two pairs of a context and a word with the same key of both, lying mixed, are two."""
    import numpy as np

    ctx = np.array([5, 9, 5, 9, 5], np.uint64)
    turned = (ctx << np.uint64(13)) | (ctx >> np.uint64(51))
    c, w, n = pst._totals(ctx, turned ^ np.uint64(77), np.ones(5, np.uint32))
    assert sorted(zip(c.tolist(), n.tolist())) == [(5, 3), (9, 2)]

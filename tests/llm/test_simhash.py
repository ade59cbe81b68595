import random

import numpy as np
import pytest
import xxhash

from wayloom.llm import simhash as sh


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rng = random.Random(1)
    texts = [None, "", " \n", "One", "a b c", "A b c d", "É é x y z"] + [" ".join(rng.choice("ab cd ef gh Ij".split()) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    assert [sh.fingerprint(t) for t in texts] == [plain(t) for t in texts]
    long = " ".join(map(str, range(3000)))
    assert sh.fingerprint(long, block=100) == plain(long)


@pytest.mark.parametrize("limit", [sh.LIMIT, 500])
def test_links_lose_no_component(spark, limit):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base) | {0, (1 << 64) - 1}
    for b in base[:25]:
        x = b
        for _ in range(6):  # chains of steps up to the radius
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    arr = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.nonzero(np.bitwise_count(arr ^ arr[i]) <= 4)[0]:
            root[max(find(i), find(j))] = min(find(i), find(j))
    df = spark.createDataFrame([(int(np.int64(x)),) for x in arr.view(np.int64)], "fp long")
    got = sh.links(df, limit=limit).collect()
    own = list(range(len(fps)))
    at = {int(v): k for k, v in enumerate(arr.view(np.int64))}
    for r in got:
        assert bin((r.fp ^ r.lo) & (2**64 - 1)).count("1") <= 4
        a, b = at[r.fp], at[r.lo]
        while own[a] != a:
            a = own[a]
        while own[b] != b:
            b = own[b]
        own[max(a, b)] = min(a, b)

    def top(i):
        while own[i] != i:
            i = own[i]
        return i

    assert [top(i) for i in range(len(fps))] == [find(i) for i in range(len(fps))]


def jaccard(a, b, k=5):
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] or sets[1] else 1.0


def test_similar_texts(spark):
    """Only pairs of that similarity are linked, and nearly all of them."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = rng.choices(vocab, k=rng.randint(60, 300))
        texts.append(" ".join(base))
        for changes in (1, 2, 4, 8, 16):
            own = list(base)
            for _ in range(changes):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            texts.append(" ".join(own))
    texts += ["", "one two", "One two", "x " * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "th long, text string")
    got = {tuple(sorted((r.fp, r.lo))) for r in sh.similar(df).collect()}
    want = {(i, j) for j in range(len(texts)) for i in range(j) if jaccard(texts[i], texts[j]) >= 0.8}
    assert got <= want
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in got:
        root[max(find(i), find(j))] = min(find(i), find(j))
    assert sum(find(i) == find(j) for i, j in want) >= 0.95 * len(want)
    docs = spark.createDataFrame([(1 + i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0]), (0, texts[6]), (0, texts[0])], "doc_id long, text string")
    kept = sh.drop_near_duplicates(docs).collect()
    assert sorted(r.text for r in kept if r.doc_id == 0) == sorted([texts[0], texts[0], texts[6]])
    assert {r.doc_id for r in kept} & {1, 7} == set() and None not in {r.doc_id for r in kept}


def test_crowded_variants_are_compared_whole(spark):
    """Similar texts that share a variant with many others are linked, though neither is the smallest there nor follows the other."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(150):
        own = list(base)
        for k in range(3):  # two of these have a similarity of some 0.75
            own[rng.randrange(len(own))] = f"v{i}-{k}"
        twin = list(own)
        for k in range(3):  # and a twin of about 0.8, far from it in the order
            twin[rng.randrange(len(own))] = f"t{i}-{k}"
        texts += [" ".join(own), " ".join(twin)]
    texts = texts[::2] + texts[1::2] + ["", " ", "\n"]
    blocks = np.array([sh.wide_fingerprint(t, 5, 2) for t in texts])
    shared, want = set(), set()
    for i in range(len(texts)):
        apart = np.bitwise_count(blocks ^ blocks[i])
        near = (apart.min(1) <= 2) & (apart.sum(1) <= 16)
        shared |= {(i, int(j)) for j in np.nonzero(near)[0] if j > i}
    want = {(i, j) for i, j in shared if jaccard(texts[i], texts[j]) >= 0.8}
    assert len(shared) > 5 * len(want) > 500
    df = spark.createDataFrame(list(enumerate(texts)), "th long, text string")
    got = {(r.lo, r.fp) for r in sh.similar(df, blocks=2).collect()}
    assert all(jaccard(texts[i], texts[j]) >= 0.8 for i, j in got)
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in got:
        root[max(find(i), find(j))] = min(find(i), find(j))
    assert [p for p in sorted(want) if find(p[0]) != find(p[1])] == []


def test_rest_finds_all_similar_pairs(spark):
    """Of texts of different components all similar pairs come by their rarest shingles, few others, and none of one component."""
    rng = random.Random(13)
    texts = []
    for _ in range(30):
        base = rng.choices([f"w{i}" for i in range(60)], k=rng.randint(1, 120))
        for _ in range(4):
            own = base[: rng.randint(max(1, len(base) - 8), len(base))]
            own[rng.randrange(-8, 0) if len(own) > 8 else 0] = rng.choice("abc")
            texts.append(" ".join(own))
    texts += ["", " ", base[0], base[0].upper()]
    comp = [rng.randrange(8) for _ in texts]
    alike = {(i, j) for j in range(len(texts)) for i in range(j) if comp[i] != comp[j] and jaccard(texts[i], texts[j]) >= 0.8}
    df = spark.createDataFrame(list(enumerate(texts)), "th long, text string")
    asked = spark.createDataFrame(list(enumerate(comp)), "th long, comp long")
    got = [(r.lo, r.fp) for r in sh.rest(df, asked).collect()]
    assert alike <= set(got) and len(got) == len(set(got)) < len(texts) ** 2 / 10
    assert all(comp[i] != comp[j] for i, j in got) and len(alike) > 20


def test_equal_blocks_meet_once(spark):
    """Blocks of one value meet once, not in each head and variant that they share; each pair of a variant is still there."""
    rng = random.Random(5)
    base = [rng.getrandbits(32) for _ in range(2)]
    rows = [(i + 1, [b for b in base]) for i in range(200)]
    met = sh._meetings(sh._block_variants(spark.createDataFrame(rows, "fp long, blocks array<long>")), 16, 1, sh.LIMIT, True)
    assert met.count() <= 2 * 2 * 200
    assert {(r.fp, r.lo) for r in met.collect()} == {(i, j) for i in range(2, 201) for j in (1, i - 1)}
    rows = [(rng.getrandbits(40), [b ^ sum(1 << k for k in rng.sample(range(32), rng.choice([0, 0, 1, 1, 2]))) for b in base]) for _ in range(60)]
    for limit in (sh.LIMIT, 100):
        sent = sh._block_variants(spark.createDataFrame(rows, "fp long, blocks array<long>"))
        got = {(r.fp, r.lo) for r in sh._meetings(sent, 16, 1, limit, True).collect()}
        for block in range(2):
            at = {}
            for fp, values in sorted(rows):
                for k in range(-1, 32):
                    at.setdefault(values[block] ^ (1 << k if k >= 0 else 0), []).append(fp)
            for own in at.values():
                assert {p for i in range(1, len(own)) for p in ((own[i], own[0]), (own[i], own[i - 1]))} <= got


def test_wide_fingerprint():
    """Each block pair is the majority of mixed hashes of all shingles."""
    text = " ".join(f"w{i % 37}" for i in range(300))
    hashes = [int(x) for h in sh.shingle_hashes(text, 5, block=64) for x in h]
    assert len(hashes) == 296
    got = sh.wide_fingerprint(text, 5, 4)
    for k in range(2):
        mixed = []
        for h in hashes:
            x = (h ^ k * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
            x = (x ^ x >> 29) * 0x94D049BB133111EB & (1 << 64) - 1
            mixed.append(x ^ x >> 32)
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > len(mixed))
        assert int(got[2 * k]) << 32 | int(got[2 * k + 1]) == want


def test_odd_rows(spark, odd, none):
    rows = sh.near_groups(odd).collect()
    assert len(rows) == odd.count()
    comp = {(r.id, r.fp): r.component for r in rows}
    assert {r.component for r in rows if r.id is None} == {0, None}  # the null text's group has ids, the other text's none
    assert comp[0, 0] == comp[1, 0] == comp[2, 0] == 0
    kept = sh.drop_near_duplicates(odd)
    # texts without a word, one word many times, and one line twice: each group keeps its smallest id
    assert {r.doc_id for r in kept.collect()} == {0, 3, 4, 5, 6, 7, 9, None}
    assert kept.columns == odd.columns and {9} == {r.doc_id for r in kept.where("text = 'same text here'").collect()}
    assert kept.where("doc_id is null").count() == 1
    assert sh.near_groups(none).count() == 0 and sh.drop_near_duplicates(none).count() == 0

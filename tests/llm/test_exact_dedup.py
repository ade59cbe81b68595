import hashlib
import random
import re

import pytest

from wayloom.llm import exact_dedup as ex


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), t in zip(rows, norm):
        ids = [j for (j, _), u in zip(rows, norm) if u == t]
        least = min((j for j in ids if j is not None), default=None)
        out.append((i, least, len(ids), least is None or i == least, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def corpus(rng, n):
    texts = ["", " ", "a b", "a  b", "a\tb ", " a b", "a\x0bb", "a\x1cb", "ab", None, "é" * 9, "long " * 500] + [f"text {i}" for i in range(20)]
    hot = "the same in a third of all rows"
    return [(rng.choice([i, i, i, None, i // 2]), hot if rng.random() < 0.34 else rng.choice(texts)) for i in range(n)]


@pytest.mark.parametrize("fan,held", [(256, 64 << 20), (2, 1000), (256, 0)])
def test_against_brute_force(spark, fan, held):
    rows = corpus(random.Random(5), 400)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    assert result(ex.groups(df, fan=fan, held=held)) == brute(rows)


def test_trie_with_splits_and_spills():
    rng = random.Random(8)
    for held in (10**9, 3000, 0):
        trie, want, got = ex.Trie(), {}, {}

        def merge(entries):
            for key, least, rows in entries:
                a = got.get(key, (least, 0))
                got[key] = (min(a[0], least), a[1] + rows)

        keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9))) for _ in range(500)]
        for i, key in enumerate(keys):
            if trie.root.held > held:
                merge(trie.spill(keys[i]))
            trie.insert(key, -i, 1)
            want[key] = (-i, want.get(key, (0, 0))[1] + 1)
        merge(trie.spill())
        assert got == want and trie.root.held == 0 and not trie.root.under


def test_equal_hashes_of_different_texts(spark, monkeypatch):
    """The trie compares whole texts: length and hash only deal them out."""
    monkeypatch.setattr(ex.xxhash, "xxh64_intdigest", lambda key: 7)
    rows = [ex.Trie(), ex.Trie()]
    for trie in rows:
        for i, t in enumerate((b"abcd", b"abce", b"abcd")):
            trie.insert(ex._prefix(4, -1) + t, i, 1)
    assert sorted(rows[0].spill()) == [(ex._prefix(4, -1) + b"abcd", 0, 2), (ex._prefix(4, -1) + b"abce", 1, 1)]


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    clashing = odd.selectExpr("*", "'clash' as length", "'clash' as sha", "'clash' as least", "'clash' as rows", "'clash' as kept", "'clash' as keep_id")
    assert result(ex.groups(clashing)) == brute(rows)
    assert ex.groups(none).count() == 0 and ex.drop_copies(none).count() == 0
    left = ex.drop_copies(clashing)
    assert left.columns == clashing.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(((i, t) for (i, t) in rows if any(b[0] == i and b[3] and b[4] == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for b in brute(rows))), key=str)

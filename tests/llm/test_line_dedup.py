import random

from wayloom.llm import line_dedup as ld


def brute(rows, min_words):
    """All runs of lines that have the words, against all that begin earlier."""
    docs = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0]))
    seen, gone = set(), {}
    for r in docs:
        lines = r[1].split("\n")
        n = [len(x.split()) for x in lines]
        for a in range(len(lines)):
            runs = [tuple(lines[a : b + 1]) for b in range(a, len(lines))]
            for w in runs:
                if w in seen and sum(n[a : a + len(w)]) >= min_words:
                    gone.setdefault(r, set()).update(range(a, a + len(w)))
            seen.update(runs)
    return {r: (None if r[1] is None else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone.get(r, ()))) for r in rows}


def check(spark, rows, min_words):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ld.dedup_lines(df.withColumn("was", df.text), min_words).collect()
    want = brute(rows, min_words)
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[r.doc_id, r.was], (r.doc_id, r.was)


def test_random_documents(spark):
    rng = random.Random(4)
    pool = ["a b c", "d e", "f", "", "g h i j k l", "m n"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    for min_words in (1, 4, 9):
        check(spark, rows, min_words)


def test_self_overlap_and_order(spark):
    check(spark, [(1, "\n".join(["one two three"] * 9)), (2, "one two three\nx\none two three\none two three"), (0, "zz")], 6)


def test_odd_rows(spark, odd, none):
    out = ld.dedup_lines(odd, 3)
    assert out.count() == odd.count() and out.columns == [*[c for c in odd.columns if c not in ("n_lines", "n_deleted")], "n_lines", "n_deleted"]
    kept = {(r.doc_id, r.text) for r in out.collect()}
    assert (9, "same text here") in kept and (10, "") in kept and (0, None) in kept
    assert ld.dedup_lines(none).count() == 0


def test_whole_runs_go(spark):
    run = "\n".join([" ".join(f"{c}{i}" for i in range(n)) for c, n in zip("xyz", (40, 10, 10))])
    rows = [(1, run), (2, "new\n" + run + "\nend"), (3, run), (4, run.replace("z0", "q"))]
    check(spark, rows, 30)
    got = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 30).collect()
    assert {r.doc_id: r.text.split(" ")[0] for r in got} == {1: "x0", 2: "new\nend", 3: "", 4: "q"}


def test_suffix_array(spark):
    """Ranks order the suffixes as plain comparison of the lines' numbers does."""
    rng = random.Random(3)
    docs = [[rng.choice([0, 0, 1, 2]) for _ in range(rng.randint(1, 40))] for _ in range(12)]
    docs += [docs[0], docs[1] + docs[2]]
    rows = [(i, 0, k, 1, 1, x) for i, d in enumerate(docs) for k, x in enumerate(d)]
    got = ld.suffix_ranks(spark.createDataFrame(rows, "_id long, _th long, pos int, words int, depth int, r0 long")).collect()
    assert len(got) == len(rows)
    own = {(r._id, r.pos): r.ranks for r in got}
    plain = {(i, k): d[k:] for i, d in enumerate(docs) for k in range(len(d))}
    order = sorted(own, key=own.get)
    assert [plain[x] for x in order] == sorted(plain.values())
    for x, y in zip(order, order[1:]):
        assert (own[x] == own[y]) == (plain[x] == plain[y])

import random

from wayloom.llm import rules


def brute(text):
    text = text or ""
    w = [x for x in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").split(" ") if x]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(rules.SPACES)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in rules.SYMBOLS), len(lines) - len(set(lines)), len(covered)


def test_measurements(spark):
    rng = random.Random(6)
    bits = ["a", "b", "c d", "a b c", "#", "*$%&|<>", "\n", " ", "\t", "\x0b", "\r", " ", "é", "Long"]
    texts = [None, "", "\n\n", "a b", "a b c", "a b c a b c", "x " * 300] + ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.m for r in rules.ledger(df).collect()}
    for i, t in enumerate(texts):
        m = got[i]
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == brute(t), t


def test_policies_and_ablations(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = rules.ledger(spark.createDataFrame([(1, good), (2, good + " ##########"), (3, "few"), (4, None)], "doc_id long, text string")).cache()
    assert [r.doc_id for r in rows.where(rules.kept("base")).orderBy("doc_id").collect()] == [1, 2]
    assert [r.doc_id for r in rows.where(rules.kept("v1")).collect()] == [1]
    table = {r.rule: (r.n_failed, r.n_alone) for r in rules.ablations(rows, "v2").collect()}
    assert table["symbols"] == (1, 1) and table["few_words"][0] == 2
    # the ledger's bits give what evaluating each rule again gives
    for name, fails in rules.rules().items():
        assert rows.where(fails).count() == rows.where(f"failed & {rules.mask((name,))} != 0").count()


def test_odd_rows(spark, odd, none):
    out = rules.ledger(odd)
    assert out.count() == odd.count() and rules.ledger(none).count() == 0
    assert [c for c in odd.columns if c not in out.columns] == [] and {r.w for r in out.collect()} == {"clash"}

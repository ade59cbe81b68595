import random
import re
from collections import Counter
from itertools import permutations

from wayloom.llm import filter_audit as fa

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(rows):
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, s, t in rows:
        t = t or ""
        w = WORD.findall(t)
        mine = ("A" * (len(w) < 200)) + ("B" * (100 * len(set(w)) < 50 * len(w))) + ("C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t))) + ("D" * bool(re.search(r"[#$%&*|]", t)))
        yield i, s or "", mine + "E" * (t in least and (i is None or i > least[t]))


def brute(rows, labels):
    out, shapley = Counter(), Counter()
    seen = list(fails(rows))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    for order in map("".join, permutations("ABCDE")):
        for i, part, f in seen:
            gone = next((x for x in order if x in f), None)
            for step, x in enumerate(order):
                key = (part, order, step + 1)
                out[(*key, "kept")] += gone is None or order.index(gone) > step
                out[(*key, "removed")] += gone == x
                out[(*key, "redundant")] += x in f and gone != x
                out[(*key, "unique_fails")] += f == x
                out[(*key, "good_lost")] += gone == x and i in good
                out[(*key, "toxic_lost")] += gone == x and i in toxic
                shapley[part, x] += gone == x
    return {k: v for k, v in out.items()}, shapley


def check(df, rows, labels):
    want, shapley = brute(rows, labels)
    got = df.collect()
    assert len(got) == 600 * len({s or "" for _, s, _ in rows})
    for r in got:
        for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[c] == want[r.part, r.filter_order, r.step, c], (r, c)
        assert r.shapley == shapley[r.part, r.filter_order[r.step - 1]]


def run(df, labels):
    return fa.audit(fa.counters(fa.masked(df), labels))


def test_against_brute_force(spark):
    rng = random.Random(13)
    bits = [" ".join(f"w{i}" for i in range(200)), "a b " * 150, "SHOUT", "#", "plain", "é", "\x1c", "", None]
    rows = [(rng.randint(0, 150), rng.choice(["x", "y", None, ""]), rng.choice(bits) if rng.random() < 0.5 else " ".join(str(rng.choice(bits)) for _ in range(3))) for _ in range(200)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    check(run(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), rows, labels)


def test_a_group_over_many_ranges(spark):
    """A hot text fills several ranges; only its smallest identifier passes E."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = [(i, "hot", "one text that all have") for i in range(400, 0, -1)] + [(1000 + i, "cold", f"text {i}") for i in range(20)] + [(None, "hot", "one text that all have")] * 3
        df = spark.createDataFrame(rows, "doc_id long, source string, text string")
        masks = fa.masked(df).collect()
        assert len(masks) == len(rows)
        assert [r.doc_id for r in masks if r.part == "hot" and not r["mask"] & fa.E] == [1]
        assert not any(r["mask"] & fa.E for r in masks if r.part == "cold")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.source, r.text) for r in odd.collect()]
    labels = spark.createDataFrame([(1, 1, 0, "clash")], "doc_id long, quality int, toxic int, mask string")
    clashing = odd.selectExpr("*", "'clash' as mask", "'clash' as part", "'clash' as sha", "'clash' as print", "'clash' as edge", "'clash' as n")
    check(run(clashing, labels), rows, [(1, 1, 0)])
    assert run(none, labels).count() == 0
    check(run(odd, labels.where("false")), rows, [])

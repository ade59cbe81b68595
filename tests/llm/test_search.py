import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from wayloom.llm import search
from wayloom.llm.bloom import bloom_filter

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def found(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [(i, Counter(found(t)), len(found(t))) for i, t in docs]
    bags = [b for b in bags if b[2]]
    n, length = len(bags), sum(b[2] for b in bags)
    df = Counter(t for b in bags for t in b[1])
    out = []
    for item, text in items:
        ranked = []
        for doc, bag, size in bags:
            m = 25 + (75 * size * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in found(text) if bag[t])
            if score > 0:
                ranked.append((-score, doc is None, doc))
        out += [(item, r + 1, x[2], -x[0]) for r, x in enumerate(sorted(ranked, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return sorted(out, key=str)


def corpus(rng, n):
    words = ["the", "THE", "été", "Été", "naïve", "x1", "42", "don't", "a_b", "日本", "\x00", "é", "end."]
    return [(i, None if i % 50 == 7 else rng.choice([" ", "\n", ", "]).join(rng.choice(words + ["the"] * 9 + [f"w{rng.randint(0, 60)}"] * 9) for _ in range(rng.randint(0, 40)))) for i in range(n)]


def run(spark, docs, items, **options):
    asked = search.asked_terms(spark.createDataFrame(items, "item_id long, text string"))
    postings = search.index(spark.createDataFrame(docs, "doc_id long, text string"))
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in search.search(postings, asked, **options).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(11)
    docs, items = corpus(rng, 300), corpus(rng, 30)
    assert (want := brute(docs, items)) and run(spark, docs, items) == want
    # asked terms that are too many to be broadcast give the same rows
    assert run(spark, docs, items, broadcast_rows=0) == want
    assert run(spark, docs, items, k=3) == brute(docs, items, 3)


def test_filtered_index_gives_the_same(spark):
    rng = random.Random(12)
    docs, items = corpus(rng, 200), corpus(rng, 5)
    asked = search.asked_terms(spark.createDataFrame(items, "item_id long, text string"))
    only = bloom_filter(asked.select(F.xxhash64("term").alias("hash")).distinct())
    postings = search.index(spark.createDataFrame(docs, "doc_id long, text string"), only)
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in search.search(postings, asked).collect()), key=str) == brute(docs, items)


def test_ties_repeats_and_nulls(spark):
    docs = [(3, "alpha beta"), (1, "alpha beta"), (1, "alpha beta"), (None, "alpha beta"), (7, "gamma"), (8, None), (9, " .,;")] + [(20 + i, "delta delta") for i in range(9)]
    items = [(1, "Alpha"), (1, "gamma gamma"), (2, None), (3, "unknown"), (None, "beta")]
    got = run(spark, docs, items)
    assert got == brute(docs, items)
    assert [r[2] for r in sorted((x for x in got if x[0] is None), key=lambda x: x[1])] == [1, 1, 3, None]


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "word a same TEXT"), (2, "É no id")], "item_id long, text string")
    asked = search.asked_terms(items.withColumns({"row": F.lit("clash"), "n": F.lit("clash"), "term": F.lit("clash"), "bucket": F.lit("clash"), "tf": F.lit("clash")}))
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in search.search(search.index(odd), asked).collect()), key=str)
    assert got == brute(texts, [(1, "word a same TEXT"), (2, "É no id")])
    assert search.search(search.index(none), asked).count() == 0
    empty = search.asked_terms(spark.createDataFrame([], "item_id long, text string"))
    assert search.search(search.index(odd), empty).count() == 0

import random

import numpy as np

from wayloom.llm import fm_quality as fm


def test_linear_time_pairs_equal_the_plain_sum():
    rng = np.random.default_rng(0)
    m = fm.Machine()
    m.v = rng.normal(0, 1, m.v.shape).astype(np.float32)
    at, x = np.array([3, 50, 700, 65537]), np.array([0.5, 1.0, -2.0, 0.25])
    pairs = sum(float(m.v[a] @ m.v[b]) * x[i] * x[j] for i, a in enumerate(at) for j, b in enumerate(at) if i < j)
    assert abs(m.raw(at, x) - pairs) < 1e-4


def corpus(spark, n=400):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice("the of and river stone light carry moves slowly under".split()) for _ in range(60))
    bad = lambda: "!!! ".join(rng.choice("BUY NOW CHEAP $$$ ### CLICK".split()) for _ in range(40))
    rows = [(i, good() if i % 3 else bad(), 10) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    return docs, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(n)], "doc_id long, quality int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    got = fm.predictions(docs, labels).withColumn("held", fm.held_out()).where("held").collect()
    assert len(got) > 50 and np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in got]) > 0.97


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = corpus(spark, 120)
    held = {r.doc_id for r in labels.where(fm.held_out()).collect()}
    assert held and not held & {r.doc_id for r in fm.sample(docs, labels).collect()}
    assert fm.sample(docs, labels, 10).count() == 10


def test_odd_rows(spark, odd, none):
    docs, labels = corpus(spark, 120)
    model = fm.train(docs, labels)
    out = fm.score(odd, model, "p").collect()
    assert len(out) == odd.count() and all(0 <= r.p <= 1 for r in out)
    assert fm.predictions(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    odd_labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, quality int")
    assert fm.predictions(odd, odd_labels, out="_a", predicted="_b").count() == odd.count()


def test_sample_is_bounded_where_ids_repeat(spark):
    docs, labels = corpus(spark, 40)
    many = docs.union(docs.where("doc_id < 5").crossJoin(spark.range(50)).select("doc_id", "text", "n_chars"))
    rows = fm.sample(many, labels).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == fm.sample(docs, labels).count()
    at, x = np.arange(fm.WORD_BUCKETS + fm._STATS), np.linspace(1, 2, fm.WORD_BUCKETS + fm._STATS)
    some, values = fm._largest(at, x)
    assert len(some) == fm.FIT_FEATURES and set(at[-fm._STATS :]) <= set(some.tolist()) and fm.WORD_BUCKETS - 1 in some

"""Filter interaction audit: what each filter removes in every order of five filters.

Copies are found by a sort: rows are range-partitioned and sorted by text
fingerprint, full text and identifier, so a hot group of copies is dealt over as many
ranges as it fills, and each row is compared with its predecessor.  (Range bounds go
through the driver, so they hold the text's SHA-256 in place of the text; within a
range the text itself is sorted and compared.)  A range tells the smallest identifier
of its last text; a range that begins with that text takes it over, which is all that
crosses a boundary.  In the same pass each text's failures become a mask of five bits.

Counts of rows, and of good and toxic labels, by part and mask are additive: they are
merged wherever they were made, at most 32 rows a part, and hold all that any order of
the filters needs.  Orders and steps are then worked out from those rows alone.

A row fails E if a row with a smaller identifier has its text, in whatever part.  A
null identifier is larger than all others and null ones don't precede each other; rows
that repeat identifier and text don't either.  Null texts are empty; an empty text
fails A only, and E.  A null part is the empty string.  Labels count by identifier; of
several for one, any that is 1.  Texts of any length are read as a whole, in memory that
grows with the text.  An empty table gives no rows, and without labels the lost counts
are zero.  Further columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wayloom.session import arrow_batches, written

FILTERS = "ABCDE"
# fixed values: symbols that fail D
SYMBOLS = b"#$%&*|"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
A, B, C, D, E = (1 << i for i in range(5))


def failures(text: bytes, points: int) -> int:
    """The bits of A to D; ``points`` are the text's code points."""
    words = text.split()
    n, size = len(words), len(text)
    mask = A * (n < 200) | B * (100 * len(set(words)) < 50 * n)
    mask |= C * (100 * (size - len(text.translate(None, _CAPITALS))) > 2 * points)
    return mask | D * (len(text.translate(None, SYMBOLS)) < size)


def masked(docs: DataFrame, id_col: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """``doc_id, part, mask`` of every row."""
    arrow_batches(docs.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), t.alias("text"))
    rows = rows.withColumns({"print": F.xxhash64("text"), "sha": F.unhex(F.sha2(F.encode("text", "utf-8"), 256))})
    last = F.asc_nulls_last("doc_id")
    ranges = rows.repartitionByRange("print", "sha", last).sortWithinPartitions("print", "sha", "text", last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows, and at the end the range's last text with its smallest identifier.  ``edge`` marks rows of the first text."""
        text_before, least, head, sha, mask = None, None, False, None, 0
        names = ["doc_id", "part", "mask", "sha", "edge"]
        for b in batches:
            masks, shas, edges = [], [], []
            points = pc.fill_null(pc.utf8_length(b.column(2)), 0).to_pylist()
            for own, value, n, print_ in zip(b.column(0).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), points, b.column(3).to_pylist(), strict=True):
                if value != text_before:
                    head, text_before, least, sha, mask = text_before is None, value, own, print_, failures(value, n)
                copy = least is not None and (own is None or own > least)
                masks.append(mask | E * copy)
                shas.append(sha if head else None)
                edges.append(head)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(masks, pa.int32()), pa.array(shas, pa.binary()), pa.array(edges, pa.bool_())], names)
        if text_before is not None:
            yield pa.RecordBatch.from_arrays([pa.array([least], pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), pa.array([sha], pa.binary()), pa.array([True], pa.bool_())], names)

    schema = "doc_id long, part string, mask int, sha binary, edge boolean"
    seen = written(ranges.select("doc_id", "part", "text", "sha").mapInArrow(run, schema), "masked")
    # of each text that ends a range, the smallest identifier of all ranges that it ends; one row a range at most
    ends = seen.where("part is null").groupBy("sha").agg(F.min("doc_id").alias("least"))
    own = seen.where("part is not null")
    inner = own.where("not edge").select("doc_id", "part", "mask")
    first = own.where("edge").join(F.broadcast(ends), "sha", "left")
    copy = F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least")))
    return inner.union(first.select("doc_id", "part", F.when(copy, F.col("mask").bitwiseOR(F.lit(E))).otherwise(F.col("mask"))))


def counters(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: additive counts."""
    own = labels.where("quality = 1 or toxic = 1").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    own = own.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    marked = rows.join(own, "doc_id", "left")
    return marked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def audit(counts: DataFrame) -> DataFrame:
    """All orders and steps of each part, from its at most 32 counters."""
    total = lambda which, value="n": F.sum(F.when(which, F.col(value)).otherwise(0))
    orders = map("".join, permutations(FILTERS))
    steps = [(p, i + 1, 1 << FILTERS.index(x), sum(1 << FILTERS.index(y) for y in p[:i])) for p in orders for i, x in enumerate(p)]
    grid = counts.sparkSession.createDataFrame([(k, *x) for k, x in enumerate(steps)], "k int, filter_order string, step int, bit int, before int")  # 600 rows
    has = lambda c: F.col("mask").bitwiseAND(F.col(c)) != 0
    removed = has("bit") & ~has("before")
    share: Column = F.col("n") * (F.lit(120) / F.greatest(F.bit_count("mask"), F.lit(1))).cast("long")
    return (
        counts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))
        .join(F.broadcast(grid), "k")
        .groupBy("part", "filter_order", "step")
        .agg(
            total(~has("bit") & ~has("before")).alias("kept"),
            total(removed).alias("removed"),
            total(has("bit") & has("before")).alias("redundant"),
            total(F.col("mask") == F.col("bit")).alias("unique_fails"),
            total(removed, "good").alias("good_lost"),
            total(removed, "toxic").alias("toxic_lost"),
            F.sum(F.when(has("bit"), share).otherwise(0)).alias("shapley"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents by source."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(written(counters(masked(docs), labels), "counters"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (SELECT doc_id, part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
  + 4 * CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS INT) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
  + 16 * CAST(doc_id > min(doc_id) OVER (PARTITION BY text) AS INT) AS mask FROM d),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x AS (SELECT letter, CAST(1 << (pos - 1) AS INT) AS bit FROM (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) v(letter, pos)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before FROM o, (VALUES (1), (2), (3), (4), (5)) v(step)),
r AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""

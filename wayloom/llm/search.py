"""Ranked lexical search over term-bucketed postings.

``index`` turns documents into postings ``row, doc_id, n, term, tf`` in folders by
``bucket``, a hash of the term, so that a search reads the buckets of its terms only;
rows of one bucket are dealt over many writers by document, so a term that a third of
all documents have is no single task.  Bucket -1 has a row for each document with a
term, from which the corpus' sizes are summed.  An index for a stated query set may
leave out terms that nobody asks for: a Bloom filter of a bounded size drops them
where documents are read, and the join drops the filter's false positives.

``search`` weighs each asked term by its document frequency, deals postings by
document, joins the asked terms, scores each match in integers and sums by item and
document.  Postings of a document are in one partition, so where the asked terms are
few enough to be broadcast (``BROADCAST_ROWS``) matches are summed where they are made
and only each partition's best ``k`` of an item move.  More asked terms are met in a
shuffle join by term, and their matches are shuffled by item and document.

Every row of documents is a document of its own, also where ids or rows repeat; each
takes a rank.  Rows with a null id take part and come last among equal scores.  Null
and empty texts, and such without a term, are no documents: neither counted nor
ranked.  Items without a term, or with terms that no document has, have no rows; items
that repeat an id are ranked one by one.  Texts of any length are read as a whole, in
memory that grows with the text.  Empty tables give no rows.  Further columns of
either table are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wayloom.llm.bloom import bloom_filter
from wayloom.session import arrow_batches, written

TOP = 10
BUCKETS = 16
#: Into how many parts the rows of a bucket are dealt.
SPREAD = 64
#: Most rows of asked terms that are broadcast, of some 60 bytes each.
BROADCAST_ROWS = 1 << 18
_SEEDED = 42
#: Bytes to bytes: what parts terms becomes a space, capitals become small; letters beyond ASCII stay.
_FOLD = bytes(b + 32 if chr(b).isascii() and chr(b).isupper() else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


class _Asked(dict):
    """Whether a term may be in the filter; one for each task, renewed when it has grown."""

    def __init__(self, packed: np.ndarray) -> None:
        self.packed, self.mask = packed.tobytes(), len(packed) * 8 - 1

    def __missing__(self, term: bytes) -> bool:
        h = xxhash.xxh64_intdigest(term, _SEEDED)
        x, y = h & self.mask, (h >> 32) & self.mask
        if len(self) > 1_000_000:
            self.clear()
        found = self[term] = bool((self.packed[x >> 3] >> (x & 7)) & (self.packed[y >> 3] >> (y & 7)) & 1)
        return found


def terms(rows: DataFrame, id_col: str = "doc_id", text: str = "text", only: np.ndarray | None = None) -> DataFrame:
    """``row, <id_col>, n, term, tf``: terms of each text, and one row without a term for each text that has any."""
    spark = rows.sparkSession
    arrow_batches(spark)
    kept = None if only is None else spark.sparkContext.broadcast(only)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None if kept is None else _Asked(kept.value)
        for b in batches:
            at, sizes, found, times = [], [], [], []
            for i, value in enumerate(b.column(2).cast(pa.binary()).to_pylist()):
                words = value.translate(_FOLD).split() if value else ()
                if not words:
                    continue
                counts = Counter(words)
                own = [*counts] if asked is None else [t for t in counts if asked[t]]
                at.append(np.full(len(own) + 1, i))
                sizes.append(np.full(len(own) + 1, len(words)))
                found += [None, *own]
                times += [0, *[counts[t] for t in own]]
            if at:
                where = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(where), b.column(1).take(where), pa.array(np.concatenate(sizes), pa.int64()), pa.array(found, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())],
                    ["row", id_col, "n", "term", "tf"],
                )

    plain = rows.select(F.monotonically_increasing_id().alias("row"), id_col, text)
    return plain.mapInArrow(run, f"row long, `{id_col}` {kind}, n long, term string, tf long")


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")))


def index(docs: DataFrame, only: np.ndarray | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The written postings of ``docs (doc_id, text)``; ``only`` is a filter of the terms to keep, if not all."""
    rows = _bucketed(terms(docs, only=only), buckets)
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("row"), F.lit(SPREAD)))
    return written(dealt, "postings", by=("bucket",))


def asked_terms(items: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The written ``item, item_id, bucket, term, times`` of ``items (item_id, text)``."""
    rows = _bucketed(terms(items, "item_id").where("term is not null"), buckets)
    return written(rows.select(F.col("row").alias("item"), "item_id", "bucket", "term", F.col("tf").alias("times")), "asked")


def search(postings: DataFrame, asked: DataFrame, k: int = TOP, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item of ``asked_terms``, by an ``index`` of as many buckets."""
    small = asked.count() <= broadcast_rows
    some = F.broadcast if small else lambda x: x
    total = postings.where("bucket < 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n, length = total["docs"], max(total["terms"] or 0, 1)
    own = postings.where("bucket >= 0")
    key = ["bucket", "term"]
    df = own.join(some(asked.select(key).distinct()), key, "left_semi").groupBy(key).agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.ln((2 * F.lit(n) + 2) / (2 * F.col("df") + 1))).cast("long")
    # a term that nearly all documents have weighs nothing
    weighted = written(asked.join(df.withColumn("weight", weight).where("weight > 0"), key).drop("item_id", "df"), "weights")
    m = F.lit(25) + F.expr(f"(75 * n * {n}L) div {length}L")
    one = F.expr("(1000000000 * tf) div (1000 * tf + 8 * m)")
    dealt = own.withColumn("m", m).select(*key, "row", "doc_id", one.alias("one")).repartition("row")
    hits = dealt.join(some(weighted), key)
    scores = hits.groupBy("item", "row").agg(F.sum(F.col("times") * F.col("weight") * F.col("one")).alias("score"), F.min("doc_id").alias("doc_id"))
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    best = scores.where("score > 0").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    names = asked.select("item", "item_id").distinct()
    return best.join(some(names), "item").select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each item of the benchmark."""
    asked = asked_terms(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    only = bloom_filter(asked.select(F.xxhash64("term").alias("hash")).distinct())
    return search(index(spark.read.parquet(f"{sf_dir}/documents.parquet"), only), asked)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark),
tot AS (SELECT count(*) AS nd, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
q AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(t) AS term FROM b) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, tot GROUP BY term),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term), tot GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

"""WARC archives: written with revisit records, read back by boundary chains.

Archives are written by Spark's text writer, one record a row, so any store that
Spark writes to will do.  They are read with the record magic as line separator:
tasks read splits of files in parallel and every magic, real or inside a
payload, begins a segment.  Each segment whose header parses is a candidate: its
offset comes from the lengths of the segments before it, its successor from its
content length.  Per file, pointer jumping from the file's start over these
offsets retains only reachable records, which rejects magic inside payloads; a
record's content is its own segment and the rejected ones that follow it.  Only
offsets and lengths of a file meet in a task, never contents.

Payloads: a null html is empty.  Among rows with equal payloads of at least
``MIN_BYTES`` the one with the largest page_id is the response, the others are
revisits of it; equal rows that tie for it are all responses.  Rows with a null
page_id are responses.  A file that doesn't begin with a record has none.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wayloom.session import shared_dir, written

MIN_BYTES = 1000
MAGIC = "WARC/1.0\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_BLANK = "\r\n\r\n"


def plan_records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: what each page's record is."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.encode("payload", "utf-8")))
    same = rows.where((F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    groups = same.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    # written, so that its size is known: a small one is broadcast by Spark's own threshold, else pages are shuffled
    revisits = written(same.join(groups, "digest").where("page_id < refers_to").distinct(), "revisits")
    return rows.join(revisits, ["page_id", "digest"], "left")


def record(page_id: Column, url: Column, payload: Column, digest: Column, refers_to: Column, date: str) -> Column:
    """A record without its last line break, which the writer adds."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    is_revisit = refers_to.isNotNull()
    block = F.when(is_revisit, F.lit("")).otherwise(F.concat(F.lit(_HTTP), payload))
    return F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(page_id)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "%20")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(is_revisit, F.concat(line("WARC-Profile", F.lit(_REVISIT)), line("WARC-Refers-To", urn(refers_to)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block, F.lit("\r\n"),
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str = "2000-01-01T00:00:00Z", per_file: int = 50_000, compression: str = "gzip") -> None:
    """Write a record per row of ``pages (page_id, url, html)`` into the files of a new folder.

    Compressed archives are smaller but each is read by one task; with ``none`` files are read in splits.
    """
    rows = plan_records(pages, min_bytes)
    cols = [F.col(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
    rows.select(record(*cols, date).alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", per_file).option("compression", compression).text(path)


def chain(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which candidates are reached from offset 0, by pointer jumping; successors below 0 are none."""
    n = len(offsets)
    if not n or offsets[0] != 0:
        return np.zeros(n, bool)
    at = np.minimum(np.searchsorted(offsets, successors), n - 1)
    nxt = np.r_[np.where(offsets[at] == successors, at, n), n]
    reached = np.zeros(n + 1, bool)
    reached[0] = True
    while True:
        more = reached.copy()
        more[nxt[np.nonzero(reached)[0]]] = True
        more[n] = False
        if (more == reached).all():
            return reached[:n]
        reached, nxt = more, nxt[nxt]


def _owners(segments: pd.DataFrame) -> pd.DataFrame:
    """Of a file's segments those that are not a whole record: the segment that begins their record, or -1."""
    s = segments.sort_values(["block", "seq"], kind="stable")
    size = s["size"].to_numpy(np.int64) + len(MAGIC)
    start = np.cumsum(size) - size  # of the segment; the first one has no magic before it
    offset = start - len(MAGIC)
    content = s["content"].to_numpy(float)
    good = ~np.isnan(content)
    good[0] = False
    succ = np.where(good, start + s["head"].to_numpy(np.int64) + np.nan_to_num(content).astype(np.int64) + len(_BLANK), -1)
    cand = np.nonzero(good)[0]
    heads = cand[chain(offset[cand], succ[cand])]
    own = np.searchsorted(heads, np.arange(len(s)), side="right") - 1
    kept = own >= 0
    # what lies behind a record's end, as after a broken chain, is nobody's
    kept &= np.where(kept, offset < succ[heads[np.maximum(own, 0)]] if len(heads) else False, False)
    seq = s["seq"].to_numpy(np.int64)
    owner = np.full(len(s), -1)
    owner[kept] = seq[heads[own[kept]]] if kept.any() else -1
    parts = pd.Series(owner).map(pd.Series(owner).value_counts()).to_numpy()
    odd = (owner != seq) | (parts > 1)
    return pd.DataFrame({"seq": seq[odd], "owner": owner[odd]})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``header, block`` (string, binary) of every record in the archives of a folder."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    header = F.substring_index("value", _BLANK, 1)
    whole = F.instr("value", _BLANK) > 0
    length = F.regexp_extract(header, r"(?i)(?:^|\r\n)Content-Length:[ \t]*([0-9]{1,18})[ \t]*(?:\r\n|$)", 1)
    segments = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value"
    )
    segments = written(
        segments.select(
            "*", F.octet_length("value").cast("long").alias("size"), (F.octet_length(header) + len(_BLANK)).cast("long").alias("head"),
            F.when(whole & (length != ""), length.cast("long")).alias("content"),
        ), "segments",
    )
    odd = segments.select("file", "block", "seq", "size", "head", "content").groupBy("file").applyInPandas(_owners, "seq long, owner long")
    odd = written(odd, "parts")  # few: its size is known when the joins are planned
    single = segments.join(odd, "seq", "left_anti").select("value", "head", "content")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "value", "head", "content")))
    split = segments.join(odd.where("owner >= 0"), "seq").groupBy("owner").agg(ordered.alias("s"))
    split = split.select(F.array_join(F.col("s.value"), MAGIC).alias("value"), F.col("s")[0]["head"].alias("head"), F.col("s")[0]["content"].alias("content"))
    cut_out = F.expr("substring(cast(value AS binary), CAST(head AS int) + 1, CAST(content AS int))")
    return single.union(split).select(F.substring_index("value", _BLANK, 1).alias("header"), cut_out.alias("block"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A row a record: ``page_id, record_type, refers_to, declared, payload`` (binary; null for revisits)."""
    field = lambda name, what: F.regexp_extract("header", rf"(?:^|\r\n){name}: {what}", 1)
    number = lambda name: field(name, "<urn:page:([^>]*)>").try_cast("long")
    kind = field("WARC-Type", "([a-z]+)")
    body = F.expr(r"substring(block, locate('\r\n\r\n', CAST(block AS string)) + 4, 2147483647)")
    return read_records(spark, path).select(
        number("WARC-Record-ID").alias("page_id"), kind.alias("record_type"), number("WARC-Refers-To").alias("refers_to"),
        field("WARC-Payload-Digest", "sha1:([0-9a-f]+)").alias("declared"), F.when(kind == "response", body).alias("payload"),
    )


def resolved(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``; revisits take theirs from what they refer to."""
    full = records.select("page_id", "record_type", "refers_to", "declared", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha"))
    own = full.where("record_type = 'response'")
    known = own.where("page_id is not null").groupBy(F.col("page_id").alias("refers_to"), F.col("sha").alias("declared")).agg(F.max("n").alias("payload_bytes"))
    again = full.where("record_type = 'revisit'").join(known, ["refers_to", "declared"], "left")
    return own.select("page_id", F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")).union(
        again.select("page_id", "payload_bytes", F.col("declared").alias("payload_digest"), "record_type", "refers_to")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return resolved(read_pages(spark, path))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= {MIN_BYTES} AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_BYTES} AND page_id < top THEN top END AS refers_to
FROM g
"""

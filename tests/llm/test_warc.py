import hashlib
import tempfile

import numpy as np

from wayloom.llm import warc

SCHEMA = "page_id long, url string, html string, extra string"


def run(spark, rows, **how):
    path = tempfile.mkdtemp(prefix="spark-") + "/w"
    warc.write_archives(spark.createDataFrame([(*r, "e") for r in rows], SCHEMA), path, **how)
    return sorted(map(tuple, warc.resolved(warc.read_pages(spark, path)).collect()), key=str)


def brute(rows):
    out, best = [], {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= warc.MIN_BYTES:
            best[h] = max(best.get(h, i), i)
    for i, _, h in rows:
        raw = (h or "").encode()
        top = best.get(h)
        again = i is not None and top is not None and i < top
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [
    (1, "http://a", "x" * 1000), (2, "u", "x" * 1000), (3, None, "x" * 1000), (4, "u", "y" * 999), (5, "u", "y" * 999), (6, "bad\r\nurl", None), (7, "u", ""),
    (8, "u", FAKE * 3), (9, "u", "WARC/1.0\r\n" * 40), (10, "u", "é" * 600), (11, "u", "\r\n\r\n"), (None, "u", "z" * 2000), (12, "u", "z" * 2000), (13, "u", FAKE + "tail"),
    (14, "u", "q" * 300_000), (15, "u", "dup" * 500), (15, "u", "dup" * 500),
]


def test_round_trip(spark):
    assert run(spark, PAGES) == brute(PAGES)


def test_splits_of_plain_files(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert run(spark, PAGES, compression="none", per_file=1000) == brute(PAGES)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty_table(spark):
    assert run(spark, []) == []


def test_chain_keeps_only_what_is_reached():
    offsets, succ = np.array([0, 10, 14, 20, 30]), np.array([10, 20, 30, 99, -1])
    assert warc.chain(offsets, succ).tolist() == [True, True, False, True, False]
    assert not warc.chain(np.array([5]), np.array([9])).any()
    n = 5000
    assert warc.chain(np.arange(n), np.arange(1, n + 1)).all()

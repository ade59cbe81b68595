"""Bloom filters of a bounded size over 64-bit hashes.

A filter saves rows before they are shuffled and never decides a result: what
passes it is joined with the rows that it stands for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Most bits of a filter, a power of two; 8 MB.
MOST_BITS = 1 << 26
#: Bytes of a filter that are one row when tasks' filters are put together.
PAGE = 1 << 14


def _bits(h: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(n_bits - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def passes(packed: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which unsigned hashes may be in a filter."""
    x, y = _bits(h, len(packed) * 8)
    out = ((packed[x >> 3] >> (x & 7).astype(np.uint8)) & 1).astype(bool)
    some = np.nonzero(out)[0]  # few are left where most are not there
    y = y[some]
    out[some] = (packed[y >> 3] >> (y & 7).astype(np.uint8)) & 1
    return out


def add(packed: np.ndarray, h: np.ndarray) -> None:
    """Put unsigned hashes into a filter."""
    for at in _bits(h, len(packed) * 8):
        np.bitwise_or.at(packed, at >> 3, (1 << (at & 7)).astype(np.uint8))


def n_bytes(rows: int, most_bits: int = MOST_BITS) -> int:
    """Bytes of a filter with 16 bits a row, within bounds."""
    n_bits = 1 << 16
    while n_bits < min(most_bits, 16 * rows):
        n_bits *= 2
    return n_bits >> 3


def bloom_filter(items: DataFrame, col: str = "hash", most_bits: int = MOST_BITS, rows: int | None = None) -> np.ndarray:
    """The filter's bytes.  Each task sends the pages in which it set bits, whatever the number of its rows.

    ``rows`` saves counting them, if it is known.
    """
    size = n_bytes(items.count() if rows is None else rows, most_bits)
    page = min(size, PAGE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed = np.zeros(size, np.uint8)
        for b in batches:
            add(packed, b["hash"].to_numpy(np.int64).view(np.uint64))
        pages = packed.reshape(-1, page)
        some = np.nonzero(pages.any(1))[0]
        yield pd.DataFrame({"page": some.astype(np.int32), "bits": pd.Series([pages[i].tobytes() for i in some], dtype=object)})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pages: dict[int, np.ndarray] = {}
        for b in batches:
            for i, bits in zip(b["page"], b["bits"]):
                own = pages.setdefault(i, np.zeros(page, np.uint8))
                own |= np.frombuffer(bits, np.uint8)
        yield pd.DataFrame({"page": np.array(list(pages), np.int32), "bits": pd.Series([x.tobytes() for x in pages.values()], dtype=object)})

    schema = "page int, bits binary"
    got = items.select(F.col(col).alias("hash")).mapInPandas(run, schema).repartition("page").mapInPandas(merge, schema).toArrow()
    packed = np.zeros(size, np.uint8)
    for i, bits in zip(got["page"].to_pylist(), got["bits"].to_pylist()):
        packed[i * page : (i + 1) * page] = np.frombuffer(bits, np.uint8)
    return packed

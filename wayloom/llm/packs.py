"""Arrays as compressed bytes, so that a shuffle moves a few rows of packed numbers instead of a row a number."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", compression_level=1)


def pack(*arrays: np.ndarray) -> bytes:
    """Each array as planes of bytes, as the high bytes of most numbers are alike."""
    out = []
    for x in arrays:
        planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
        packed = _CODEC.compress(planes, asbytes=True) if planes else b""
        out += [b"%c%c" % (ord(x.dtype.kind), x.itemsize), len(x).to_bytes(4, "little"), len(packed).to_bytes(4, "little"), packed]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, size = chr(data[at]), data[at + 1]
        n, m = (int.from_bytes(data[at + k : at + k + 4], "little") for k in (2, 6))
        at += 10
        planes = np.frombuffer(_CODEC.decompress(data[at : at + m], n * size), np.uint8) if n else np.zeros(0, np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(size, n).T).view(f"{kind}{size}").reshape(n))
        at += m
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    """Differences of unsigned keys; small ones if the keys are sorted, right in any order."""
    return np.diff(keys, prepend=np.uint64(0))


def whole(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=np.uint64)


def n_buckets(rows: int, each: int = 1 << 20) -> int:
    """A power of two of buckets with about as many rows each; it grows with the rows, so that a bucket doesn't."""
    n = 1
    while n * each < rows:
        n *= 2
    return n


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The highest bits of unsigned hashes: sorted keys have sorted buckets."""
    bits = n.bit_length() - 1
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)

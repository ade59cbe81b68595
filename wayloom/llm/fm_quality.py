"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Features of a text: its words hashed into ``WORD_BUCKETS`` (weight: log count,
scaled to unit length together), structure statistics cut into bins, and the
binned length that the metadata column ``n_chars`` states.  The score is the
logistic of ``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``, whose pair sum
is computed in linear time as ``(|sum v_i x_i|^2 - sum |v_i|^2 x_i^2) / 2``.

The model is fitted on at most ``SAMPLE`` labelled texts, one an id, those with the
smallest hash of their id, by mini-batch AdaGrad.  Of a text that it is fitted on, at
most ``FIT_FEATURES`` features count, those with the largest values; scores use all.  It has a fixed size
(``BUCKETS * (1 + RANK)`` floats), so it is sent to all tasks.

Nulls and empty texts get the score of a text without words; texts of any length are
scored as a whole; a null ``n_chars`` is taken from the text.  Null labels and ids are
not learnt from; of an id's several labels the highest counts, of its several texts the
one with the smallest hash, so ties and repeated rows change nothing; repeated rows are
scored alike.  Without labels every score is about a half.  An empty table gives none.
Columns of the input are kept, but for those that have the names of the results.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wayloom.session import arrow_batches

#: Bound of the labelled rows that the model is fitted on.
SAMPLE = 12_000
#: Features of a text that the model is fitted on; with ``SAMPLE`` it bounds what the driver holds.
FIT_FEATURES = 4096
WORD_BUCKETS = 1 << 16
RANK = 6
_STATS = 12
_BINS = 16
BUCKETS = WORD_BUCKETS + _STATS * _BINS
_SYMBOLS = b"#*$%&|<>{}[]\\^~=_@+"


def statistics(raw: bytes, words: list[bytes], n_distinct: int, n_chars: float) -> list[float]:
    """Structure statistics of a text, each from 0 to 1."""
    n, size = max(1, len(words)), max(1, len(raw))
    lines = raw.split(b"\n")
    count_of = lambda chars: size - len(raw.translate(None, chars)) if raw else 0
    ends = sum(raw.count(x) for x in (b".", b"!", b"?"))
    return [
        count_of(_SYMBOLS) / size,
        count_of(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size,
        count_of(b"0123456789") / size,
        min(1.0, ends / n),
        min(1.0, raw.count(b"!") / n),
        n_distinct / n if words else 0.0,
        len(set(lines)) / len(lines),
        min(1.0, size / n / 20),
        min(1.0, math.log1p(len(words)) / 12),
        min(1.0, raw.count(b"|") / n),
        min(1.0, len(lines) / n * 4),
        min(1.0, math.log1p(max(0.0, n_chars)) / 14),
    ]


_RATE = np.array([1, 1, 1, 1, 1, 0, 0, 0, 0, 1, 0, 0], bool)  # shares that are small: binned by their root


def features(texts: list[str | None], n_chars: list[float | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers and values of each text."""
    known: dict[bytes, int] = {}
    for text, stated in zip(texts, n_chars):
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.split()
        tf = Counter(words)
        for w in tf:
            if w not in known:
                known[w] = crc32(w.lower()) % WORD_BUCKETS
        at = np.fromiter(map(known.__getitem__, tf), np.int64, len(tf))
        x = np.log1p(np.fromiter(tf.values(), np.float64, len(tf)))
        if len(x):
            at, inverse = np.unique(at, return_inverse=True)
            x = np.bincount(inverse, x)
            x *= 1 / np.sqrt((x * x).sum())
        stats = np.array(statistics(raw, words, len(tf), len(text or "") if stated is None or stated != stated else float(stated)))
        cut = np.minimum(_BINS - 1, (np.where(_RATE, np.sqrt(stats), stats) * _BINS).astype(np.int64))
        own = WORD_BUCKETS + np.arange(_STATS) * _BINS + cut
        yield np.r_[at, own], np.r_[x, np.full(_STATS, 0.5)]
        if len(known) > 1_000_000:
            known.clear()


class Machine:
    """The model: bias, weights and factors."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w0 = 0.0
        self.w = np.zeros(BUCKETS, np.float32)
        self.v = rng.normal(0, 0.01, (BUCKETS, RANK)).astype(np.float32)

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[at] * x[:, None]
        s = vx.sum(0)
        return float(self.w0 + self.w[at] @ x + 0.5 * (s @ s - (vx * vx).sum()))

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.raw(at, x)))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.08, decay: float = 1e-5, seed: int = 7) -> None:
        """Mini-batch AdaGrad on the logistic loss."""
        rng = np.random.default_rng(seed)
        share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
        self.w0 = math.log(share / (1 - share))
        g0, gw, gv = 1e-6, np.full(BUCKETS, 1e-6, np.float32), np.full((BUCKETS, RANK), 1e-6, np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for b in range(0, len(order), batch):
                some = order[b : b + batch]
                lens = np.array([len(rows[i][0]) for i in some])
                at, x = (np.concatenate([rows[i][k] for i in some]) for k in (0, 1))
                seg = np.repeat(np.arange(len(some)), lens)
                heads = np.cumsum(lens) - lens
                vx = self.v[at] * x[:, None]
                s = np.add.reduceat(vx, heads)
                z = self.w0 + np.add.reduceat(self.w[at] * x, heads) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), heads))
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) / len(some)
                dw = (err[seg] * x).astype(np.float32)
                dv = (dw[:, None] * (s[seg] - vx)).astype(np.float32)
                own, inverse = np.unique(at, return_inverse=True)
                dw = np.bincount(inverse, dw).astype(np.float32) + decay * self.w[own]
                dv = np.stack([np.bincount(inverse, dv[:, k]) for k in range(RANK)], 1).astype(np.float32) + decay * self.v[own]
                d0 = float(err.sum())
                g0 += d0 * d0
                gw[own] += dw * dw
                gv[own] += dv * dv
                self.w0 -= rate * d0 / math.sqrt(g0)
                self.w[own] -= rate * dw / np.sqrt(gw[own])
                self.v[own] -= rate * dv / np.sqrt(gv[own])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """At most ``bound`` labelled rows to learn from: the smallest by a hash of their id."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(bound)
    own = docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")).join(picked, "doc_id")
    return own.groupBy("doc_id", "quality").agg(F.min_by(F.struct("text", "n_chars"), F.struct(F.xxhash64("text"), "n_chars")).alias("t")).select("doc_id", "quality", "t.text", "t.n_chars")


def _largest(at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text that it is fitted on: its statistics, and the words with the largest values."""
    if len(at) <= FIT_FEATURES:
        return at, x
    some = np.r_[np.argsort(-x[:-_STATS], kind="stable")[: FIT_FEATURES - _STATS], np.arange(len(at) - _STATS, len(at))]
    return at[some], x[some]


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Machine:
    """Fit the model on the bounded sample; its features are made in the tasks."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [_largest(at, x) for at, x in features(b["text"].tolist(), b["n_chars"].tolist())]
            yield pd.DataFrame({"id": b["doc_id"], "y": b["quality"], "at": [a.astype(np.int32) for a, _ in both], "x": [x.astype(np.float32) for _, x in both]})

    arrow_batches(docs.sparkSession)
    # as Arrow, so that the driver holds flat arrays instead of a Python number a feature
    got = sample(docs, labels, bound).mapInPandas(extract, "id long, y int, at array<int>, x array<float>").toArrow()
    at, x = (got[c].combine_chunks() for c in ("at", "x"))
    ends = np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    at, x = (c.flatten().to_numpy(zero_copy_only=False) for c in (at, x))
    rows = list(zip(np.split(at, ends[:-1]), np.split(x, ends[:-1]))) if len(ends) else []
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    model = Machine()
    model.fit([rows[i] for i in order], got["y"].to_numpy().astype(np.float32)[order])
    return model


def score(docs: DataFrame, model: Machine, out: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.w0, model.w, model.v))

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = Machine.__new__(Machine)
        m.w0, m.w, m.v = shared.value
        for texts, stated in batches:
            yield pd.Series([m.score(at, x) for at, x in features(texts.tolist(), stated.tolist())], dtype=float)

    arrow_batches(docs.sparkSession)
    return docs.withColumn(out, run(F.col("text"), F.col("n_chars").cast("double")))


def predictions(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, out: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with the score and the prediction, 1 from a score of 0.7; columns of these names are replaced."""
    return score(docs, train(docs, labels, bound), out).withColumn(predicted, (F.col(out) >= 0.7).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = predictions(docs.select("doc_id", "text", "n_chars"), labels)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")

"""Exact duplicates by owners in Patricia tries.

A text's key is its length, its content hash and the whole of its bytes, after runs
of white space have become one space.  Tasks insert the keys of their documents into
a compressed radix trie whose terminal nodes hold the smallest identifier and the
number of rows, and give each terminal node once: copies within a task are one row
from here on, so a group with a third of all rows sends no more than a row a task.
Keys whose length and hash only one task has end here.  The others are dealt by
length and hash; the owning task inserts them, byte by byte, into its own trie and
names each text's owner.  Where a length and hash come from more than ``FAN`` tasks,
rounds over salted parts of them merge tries before, so no owner reads more than that.

A trie that holds more than ``HELD`` bytes spills by subtree: a task that reads
documents gives away whole subtrees as partial rows, which merge later like those of
another task; an owner reads its rows sorted by length and hash, so every subtree but
the one at hand is complete and leaves memory.

Rows that repeat id and text stay or go together.  Rows with a null id count in their
group; the smallest other id stays, and where all ids are null all rows stay and
``keep_id`` is null.  Null texts are empty; an empty text is a text like any other.
Texts of any length are read as a whole, in memory that grows with the text.  An empty
table gives no rows.  ``groups`` looks at id and text only; ``drop_copies`` keeps all
columns of its input, and replaces those that have the name of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from wayloom.session import arrow_batches, written

#: Bytes that a trie holds before it spills, and those of a node besides its label.
HELD = 64 << 20
NODE = 400
#: Most rows of one length and hash that an owner reads.
FAN = 256
_WHITE = frozenset(b" \t\n\x0b\f\r")
KEY = ["length", "hash"]


def normalised(text: bytes) -> bytes:
    """Runs of white space as one space, also at the ends."""
    inner = b" ".join(text.split())
    if not text or not inner:
        return b" " if text else b""
    return b" " * (text[0] in _WHITE) + inner + b" " * (text[-1] in _WHITE)


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Node:
    __slots__ = ("held", "label", "least", "rows", "under")

    def __init__(self, label: bytes) -> None:
        self.label, self.under = label, {}
        self.rows, self.least, self.held = 0, None, 0


class Trie:
    """Byte strings with the smallest identifier and the number of rows of each.

    Edges have labels of any length; ``held`` are the bytes of a subtree.
    """

    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, key: bytes, least, rows: int) -> None:
        node, at, path = self.root, 0, [self.root]
        while at < len(key):
            child = node.under.get(key[at])
            if child is None:
                child = node.under[key[at]] = Node(key[at:])
                child.held = NODE + len(child.label)
                self._grow(path, child.held)
                at = len(key)
            elif key.startswith(child.label, at):
                at += len(child.label)
            else:
                n = _common(child.label, key[at : at + len(child.label)])
                upper = node.under[key[at]] = Node(child.label[:n])
                child.label = child.label[n:]
                upper.under[child.label[0]] = child
                upper.held, child.held = child.held + NODE, child.held - n
                self._grow(path, NODE)
                child, at = upper, at + n
            node = child
            path.append(node)
        node.least = least if node.least is None else node.least if least is None else min(node.least, least)
        node.rows += rows

    @staticmethod
    def _grow(path: list[Node], n: int) -> None:
        for x in path:
            x.held += n

    def spill(self, keep: bytes | None = None) -> Iterator[tuple[bytes, object, int]]:
        """Give away the subtrees under the root, but for the one that begins like ``keep``."""
        for first in [*self.root.under]:
            if keep is None or first != keep[0]:
                yield from self._leave(self.root, first, b"")
        if keep is not None and keep[0] in self.root.under:
            yield from self._others(self.root, keep, 0)

    def _others(self, node: Node, keep: bytes, at: int) -> Iterator[tuple[bytes, object, int]]:
        """Along the path of ``keep``, all that branches off."""
        path = [self.root]
        while at < len(keep) and (child := node.under.get(keep[at])):
            gone = 0
            for first in [x for x in node.under if x != keep[at]]:
                gone += node.under[first].held
                yield from self._leave(node, first, keep[:at], count=False)
            self._grow(path, -gone)
            if not keep.startswith(child.label, at):
                return
            node, at = child, at + len(child.label)
            path.append(node)

    def _leave(self, node: Node, first: int, prefix: bytes, count: bool = True) -> Iterator[tuple[bytes, object, int]]:
        top = node.under.pop(first)
        if count:
            node.held -= top.held
        stack = [(top, prefix + top.label)]
        while stack:
            x, key = stack.pop()
            if x.rows:
                yield key, x.least, x.rows
            stack += [(y, key + y.label) for y in x.under.values()]


def _prefix(length: int, hash_: int) -> bytes:
    return length.to_bytes(8, "big") + (hash_ + (1 << 63)).to_bytes(8, "big")


_PARTIAL = "length long, hash long, sha binary, text binary, least {kind}, rows long"


def _batch(entries: list[tuple[bytes, object, int]], kind: pa.DataType, with_text: bool = True) -> pa.RecordBatch:
    """Terminal nodes as rows."""
    texts = [e[0][16:] for e in entries]
    columns = [
        pa.array([int.from_bytes(e[0][:8], "big") for e in entries], pa.int64()),
        pa.array([int.from_bytes(e[0][8:16], "big") - (1 << 63) for e in entries], pa.int64()),
        pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()),
        pa.array(texts if with_text else [None] * len(texts), pa.binary()),
        pa.array([e[1] for e in entries], kind),
        pa.array([e[2] for e in entries], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["length", "hash", "sha", "text", "least", "rows"])


def _batches(entries: Iterator[tuple[bytes, object, int]], kind: pa.DataType, with_text: bool = True, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    some, size = [], 0
    for e in entries:
        some.append(e)
        size += len(e[0]) + 64
        if size > most:
            yield _batch(some, kind, with_text)
            some, size = [], 0
    if some:
        yield _batch(some, kind, with_text)


def partial_owners(docs: DataFrame, id_col: str = "doc_id", text: str = "text", held: int = HELD) -> DataFrame:
    """A row without a text for each document, and a row for each different text of a task."""
    arrow_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for b in batches:
            lengths, hashes, shas = [], [], []
            ids = b.column(0)
            for own, value in zip(ids.to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                key = normalised(value or b"")
                lengths.append(len(key))
                hashes.append(xxhash.xxh64_intdigest(key) - (1 << 63))
                shas.append(hashlib.sha256(key).digest())
                trie.insert(_prefix(lengths[-1], hashes[-1]) + key, own, 1)
            n = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lengths, pa.int64()), pa.array(hashes, pa.int64()), pa.array(shas, pa.binary()), pa.nulls(n, pa.binary()), ids, pa.array([1] * n, pa.int64())],
                ["length", "hash", "sha", "text", "least", "rows"],
            )
            if trie.root.held > held:
                yield from _batches(trie.spill(), ids.type)
            ids_type = ids.type
        if trie.root.held or trie.root.rows:
            yield from _batches(trie.spill(), ids_type)

    return docs.select(id_col, text).mapInArrow(run, _PARTIAL.format(kind=kind))


def merged(partial: DataFrame, with_text: bool, held: int = HELD) -> DataFrame:
    """Terminal nodes of the tries of partitions that are sorted by length and hash."""
    kind = partial.schema["least"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for b in batches:
            ids_type = b.column(3).type
            for length, hash_, text, least, rows in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                prefix = _prefix(length, hash_)
                if trie.root.held > held:
                    yield from _batches(trie.spill(prefix), ids_type, with_text)
                trie.insert(prefix + text, least, rows)
        if trie.root.held:
            yield from _batches(trie.spill(), ids_type, with_text)

    return partial.select(*KEY, "text", "least", "rows").mapInArrow(run, _PARTIAL.format(kind=kind))


def owners(partial: DataFrame, fan: int = FAN, held: int = HELD) -> DataFrame:
    """``length, hash, sha, least, rows`` of every different text, from the rows with texts of ``partial_owners``."""
    out = ["length", "hash", "sha", "least", "rows"]
    texts = partial.where("text is not null")
    met = written(texts.groupBy(*KEY).agg(F.count("*").alias("tasks")).where("tasks > 1"), "met")
    lone = texts.join(met, KEY, "left_anti").select(out)
    shared = texts.join(met, KEY)
    while (most := met.agg(F.max("tasks")).first()[0] or 0) > fan:
        # hot keys only, in parts of ``fan`` rows; the others wait
        salt = F.when(F.col("tasks") > fan, F.floor(F.rand(7) * F.ceil(F.col("tasks") / fan))).otherwise(F.lit(-1))
        hot = shared.where(F.col("tasks") > fan).withColumn("salt", salt).repartition(*KEY, "salt").sortWithinPartitions(*KEY)
        cold = shared.where(F.col("tasks") <= fan).drop("tasks")
        again = written(merged(hot, True, held).select(cold.columns).union(cold), "merged")
        met = written(again.groupBy(*KEY).agg(F.count("*").alias("tasks")), "met")
        if (met.agg(F.max("tasks")).first()[0] or 0) >= most:
            raise RuntimeError("different texts have one length and hash")
        shared = again.join(met, KEY)
    own = merged(shared.repartition(*KEY).sortWithinPartitions(*KEY), False, held)
    return lone.union(own.select(out))


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", fan: int = FAN, held: int = HELD) -> DataFrame:
    """``<id_col>, keep_id, group_size, kept, text_sha256`` of every row."""
    partial = written(partial_owners(docs, id_col, text, held), "partial")
    own = owners(partial, fan, held)
    rows = partial.where("text is null").select(*KEY, "sha", F.col("least").alias(id_col))
    every = rows.join(own, [*KEY, "sha"])
    kept = F.col("least").isNull() | F.coalesce(F.col(id_col) == F.col("least"), F.lit(False))
    return every.select(id_col, F.col("least").alias("keep_id"), F.col("rows").alias("group_size"), kept.alias("kept"), F.hex("sha").alias("sha")).withColumn("text_sha256", F.lower("sha")).drop("sha")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that are not kept, by id and normalised text."""
    white = r"[\x20\x09-\x0D]+"
    sha = F.sha2(F.encode(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), white, " "), "utf-8"), 256)
    gone = groups(docs, id_col, text).where("not kept").select(F.col(id_col).alias("__gone"), F.col("text_sha256").alias("__text")).distinct()
    rows = docs.withColumn("__sha", sha)
    return rows.join(gone, rows[id_col].eqNullSafe(gone["__gone"]) & (rows["__sha"] == gone["__text"]), "left_anti").drop("__sha")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its group that stays."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER q AS keep_id, count(*) OVER q AS group_size, doc_id = min(doc_id) OVER q AS kept, sha256(t) AS text_sha256 FROM d WINDOW q AS (PARTITION BY t)
"""

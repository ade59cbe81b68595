"""Byte-level BPE by a pair occurrence index.

A text is cut before each space, so that the pieces repeat; within a batch each
distinct piece is encoded once.  All distinct pieces of a batch form one array
of symbols with walls between pre-tokens.  An index maps each adjacent pair that
the vocabulary merges to all its positions; active ranks are applied in
ascending order, each to all its positions at once, and the positions of the
pairs that a merge makes are added to the lists of their own ranks, which are
always higher.  Texts then gather their pieces' tokens.

Nulls and empty texts give no tokens; texts of any length are encoded as a whole.
Memory is bounded by the Arrow batch and by ``MAX_PIECES`` cached pieces; nothing
depends on other rows, so a lost task is simply run again and repeated rows give
the same.  An empty table gives none.  Columns of the input are kept, but for those
that have the names of a function's results, which are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from wayloom.session import arrow_batches

MAX_PIECES = 1_000_000
_MARK = "\x00"
# fixed value: the published byte-level pre-token pattern
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# fixed values: letters and numbers, by code point, that are too new for the published splitter, which takes them for signs
_NEWER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb "
    "11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 16ff4-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 "
    "18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed "
    "1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f "
)
_NEW = "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in _NEWER.split())
#: The pattern for texts with characters from the first of these on.
WIDE = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{_NEW}]]+| ?[\p{{N}}--[{_NEW}]]+| ?[[^\s\p{{L}}\p{{N}}]||[{_NEW}]]+|\s+(?!\S)|\s+"
_PLAIN = chr(int(_NEWER[:3], 16))


def _byte_names() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary file: merges as arrays, tokens as bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names, model = _byte_names(), spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*ids.values(), *self.special.values()])
        self.tokens = [b""] * self.size
        for token, i in ids.items():
            self.tokens[i] = bytes(names[c] for c in token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in names.items():
            self.byte_ids[b] = ids[c]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.left, self.right = left, right
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = left * self.size + right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


_find, _find_wide = regex.compile(PATTERN).findall, regex.compile(WIDE).findall


def pretokens(piece: str) -> list[str]:
    return _find(piece) if not piece or max(piece) < _PLAIN else _find_wide(piece)


def _alternate(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of positions whose pairs may overlap (x x x), every other one of each run, from its left."""
    new = np.r_[True, following[:-1] != at[1:]]
    head = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    return (np.arange(len(at)) - head) % 2 == 0


def merge_all(sym: np.ndarray, wall: np.ndarray, voc: Vocabulary) -> np.ndarray:
    """Apply all merges in ``sym`` in place; returns which positions are left.

    ``wall[i]`` is true where a pre-token begins, so that no pair ends there.
    """
    n = len(sym)
    alive = np.ones(n, bool)
    if n < 2:
        return alive
    after = np.arange(1, n + 1)
    before = np.arange(-1, n - 1)
    joined = np.r_[~wall[1:], False]  # the pair that starts here is inside a pre-token
    at = np.nonzero(joined)[0]
    rank = voc.ranks(sym[at], sym[at + 1])
    at, rank = at[rank >= 0], rank[rank >= 0]
    by = np.argsort(rank, kind="stable")
    at, rank = at[by], rank[by]
    edges = np.nonzero(np.diff(rank, prepend=-1))[0]
    index: dict[int, list[np.ndarray]] = {int(rank[s]): [x] for s, x in zip(edges, np.split(at, edges[1:]))}
    active = list(index)
    heapq.heapify(active)
    ends = np.zeros(n, bool)  # a pre-token ends after this symbol
    ends[np.nonzero(~joined)[0]] = True
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        a, b, c = voc.left[r], voc.right[r], voc.made[r]
        p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        p = p[alive[p] & (sym[p] == a) & ~ends[p]]
        q = after[p]
        fits = sym[q] == b
        p, q = p[fits], q[fits]
        if a == b and len(p) > 1:
            some = _alternate(p, q)
            p, q = p[some], q[some]
        if not len(p):
            continue
        sym[p] = c
        alive[q] = False
        ends[p] = ends[q]
        nxt = after[q]
        after[p] = nxt
        inner = nxt < n
        before[nxt[inner]] = p[inner]
        right = p[~ends[p]]
        prev = before[p]
        left = prev[prev >= 0]
        left = left[~ends[left]]
        starts = np.unique(np.concatenate((left, right)))
        rank = voc.ranks(sym[starts], sym[after[starts]]) if len(starts) else starts
        starts, rank = starts[rank > r], rank[rank > r]
        if not len(starts):
            continue
        by = np.argsort(rank, kind="stable")
        starts, rank = starts[by], rank[by]
        edges = np.nonzero(np.diff(rank, prepend=-1))[0]
        for s, x in zip(rank[edges].tolist(), np.split(starts, edges[1:])):
            if s in index:
                index[s].append(x)
            else:
                index[s] = [x]
                heapq.heappush(active, s)
    return alive


class _Index(dict):
    """Numbers of pieces in the order in which they come."""

    def __init__(self) -> None:
        self.words: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self.words)
        self.words.append(piece)
        return n


class Encoder:
    """Encodes batches of texts; keeps the pieces that it has met."""

    def __init__(self, voc: Vocabulary, max_pieces: int = MAX_PIECES):
        self.voc, self.max_pieces = voc, max_pieces
        self.reset()

    def reset(self) -> None:
        self.pieces = _Index()
        self.spaced = np.zeros(0, bool)  # pieces at whose rim white space meets the cut
        self.start = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.int32)

    def learn(self) -> None:
        """Encode the pieces that came since the last call."""
        new = self.pieces.words[len(self.spaced) :]
        if not new:
            return
        # "\n" or a lone space next to the cut: the pieces depend on each other, so such texts are not cut
        spaced = np.array([len(p) > 0 and (p[-1].isspace() or p[1:2].isspace()) for p in new], bool)
        parts = [pretokens(p) for p in new]
        raw = [x.encode("utf-8", "surrogatepass") for part in parts for x in part]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.voc.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        wall = np.zeros(len(sym) + 1, bool)
        heads = np.cumsum(lens) - lens
        wall[heads] = True
        alive = merge_all(sym, wall[: len(sym)], self.voc)
        per_part = np.fromiter(map(len, parts), np.int64, len(parts))
        tops = np.r_[heads, len(sym)][np.r_[0, np.cumsum(per_part)]]
        kept = np.r_[0, np.cumsum(alive)]
        self.flat = np.concatenate((self.flat, sym[alive].astype(np.int32)))
        self.start = np.concatenate((self.start, self.start[-1] + kept[tops[1:]]))
        self.spaced = np.concatenate((self.spaced, spaced))

    def _segments(self, text: str) -> list[str | int]:
        """Text between special tokens, and their ids."""
        if self.voc.special_pattern is None or not any(s in text for s in self.voc.special):
            return [text]
        out: list[str | int] = []
        at = 0
        for m in self.voc.special_pattern.finditer(text):
            out += [text[at : m.start()], self.voc.special[m.group()]]
            at = m.end()
        return [*out, text[at:]]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text."""
        if len(self.pieces) > self.max_pieces:
            self.reset()
        known = self.pieces.__getitem__
        plans: list[list] = []
        for text in texts:
            plan: list = []
            for seg in self._segments(text or ""):
                if isinstance(seg, str) and seg:
                    cut = [seg] if _MARK in seg else seg.replace(" ", _MARK + " ").split(_MARK)
                    plan.append((seg, np.fromiter(map(known, cut), np.int64, len(cut))))
                elif not isinstance(seg, str):
                    plan.append((None, seg))
            plans.append(plan)
        self.learn()
        whole = False
        for plan in plans:
            for k, (seg, at) in enumerate(plan):
                if seg is not None and len(at) > 1 and self.spaced[at].any():
                    plan[k] = (seg, np.array([known(seg)]))
                    whole = True
        if whole:
            self.learn()
        out = []
        for plan in plans:
            ids = [np.array([at], np.int32) if seg is None else self._gather(at) for seg, at in plan]
            out.append(ids[0] if len(ids) == 1 else np.concatenate(ids) if ids else np.zeros(0, np.int32))
        return out

    def _gather(self, at: np.ndarray) -> np.ndarray:
        start = self.start[at]
        lens = self.start[at + 1] - start
        begin = np.cumsum(lens) - lens
        return self.flat[np.repeat(start - begin, lens) + np.arange(int(lens.sum()))]


def decode(ids: np.ndarray, voc: Vocabulary) -> str:
    """The text of token ids, special tokens included; broken UTF-8 becomes U+FFFD."""
    return b"".join(map(voc.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids (array of int)."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = Encoder(vocabulary(path))
        for texts in batches:
            yield pd.Series(enc.encode(texts.tolist()), dtype=object)

    arrow_batches(docs.sparkSession)
    return docs.withColumn(out, run(F.col(text)))


def decoded(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of a column of token ids."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        voc = vocabulary(path)
        for rows in batches:
            yield pd.Series([decode(np.asarray(x if x is not None else [], np.int64), voc) for x in rows])

    arrow_batches(docs.sparkSession)
    return docs.withColumn(out, run(F.col(ids)))


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens, ids_sha256, decoded_sha256``, encoded and decoded in one pass; columns of these names are replaced.

    The token ids stay in the task, so a digest costs no transfer of them.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        voc = vocabulary(path)
        enc, sha = Encoder(voc), hashlib.sha256
        for texts in batches:
            rows = [
                (len(ids), sha(ids.astype("<u4").tobytes()).hexdigest(), sha(decode(ids, voc).encode("utf-8", "surrogatepass")).hexdigest())
                for ids in enc.encode(texts.tolist())
            ]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    arrow_batches(docs.sparkSession)
    own = [f"`{c}`" for c in docs.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    return docs.withColumn("__d", run(F.col(text))).select(*own, "__d.*")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, vocabulary_path()).drop("text")

"""Language-model scoring by a probabilistic suffix tree.

Tokens are lower-cased (A-Z) words and one end a text.  Contexts are strings of
one to ``DEPTH`` words.  One that occurs ``MIN_COUNT`` times is a candidate, and
is kept if its next-word distribution diverges from that of its longest kept
suffix: if coding all that follows it by its own distribution saves ``GAIN``
nats.  A context lists the words that follow it ``LISTED`` times or more.  They
and the rest share its mass: what the listed ones leave, plus ``KAPPA`` tokens,
is spread as the suffix's distribution, down to the additive unigram model over
all words.  A text is scored by the longest kept suffix before each token.

Texts are split once: a written table holds, a batch of texts, the hashes of its words
and their numbers in order, packed.  Everything is counted over the whole training
corpus by shuffles: what follows one word in a first pass of that table, two words in
a second, and more in a third, so the tree is a written table that grows with the
corpus.  A context of more than three words is counted only where each three of them
next to each other are a candidate, which every candidate's are.  Tasks sort and add
up what they count and send it packed, in buckets whose number grows with the corpus;
look-ups and answers go the same way, a batch of texts at a time.  Filters of bounded
size save look-ups and counts before they are shuffled and decide nothing.  Counts of
at most ``HEAD`` words and at most ``HEAD_GRAMS`` rows of the
tree, those with the highest counts, are broadcast; what a batch needs besides, it
looks up in the tables.

Words and contexts are told apart by 64-bit hashes alone.  Nulls and empty texts hold the end only;
texts of any length are read as a whole.  Rows with a null id are learnt from.
Repeated rows each count and are each scored; ties of counts at the rim of what
is broadcast change no result.  An empty table gives no rows, an empty training
corpus a model of the end alone.  Only the id and the text are read, so further
columns of any name don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wayloom.llm.bloom import add, bloom_filter, n_bytes, passes
from wayloom.llm.packs import bucket_of, n_buckets, pack, steps, unpack, whole
from wayloom.session import arrow_batches, release, standing, written

DEPTH = 5
#: Occurrences from which a context is a candidate, and from which it lists a word.
MIN_COUNT, LISTED = 16, 3
GAIN = 10.0
#: Weight of the suffix's distribution in smoothing, in tokens.
KAPPA = 2.0
HEAD = 1 << 18
HEAD_GRAMS = 1 << 22
_ADD = 0.1
_FLUSH = 1_000_000
#: MB of texts in a batch, which are encoded and scored together.
BATCH_MB = 4
#: Stands for the end among the words, none of which has white space.
END = b"\n"


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


_END = int(np.uint64(_word_hash(END)).view(np.int64))


class _Index(dict):
    """Numbers of words in the order in which they come."""

    def __init__(self) -> None:
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n


def encoded(texts: DataFrame) -> DataFrame:
    """Batches of texts as numbers of words, of a table ``(id, text, train)``; texts to learn from and others apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch = TaskContext.get().partitionId() << 32
        for b in batches:
            flag = b["train"].to_numpy(bool)
            for train in (True, False):
                own = b[flag == train]
                if not len(own):
                    continue
                index, nums, sizes = _Index(), [], []
                index[END]
                for text in own["text"]:
                    split = words_of(text)
                    split.append(END)
                    sizes.append(len(split))
                    nums += map(index.__getitem__, split)
                data = pack(np.array(nums, np.uint32), np.array(sizes, np.uint32), _hashes(index.words))
                yield pd.DataFrame({"batch": [batch], "train": [train], "n": [len(nums)], "ids": [own["id"].tolist()], "data": [data]})
                batch += 1

    # ids go as strings, so that nulls don't turn them into floats
    return texts.mapInPandas(run, "batch long, train boolean, n long, ids array<string>, data binary")


def symbols_of(texts: DataFrame, id_col: str | None = None, text: str = "text", train: Column | None = None) -> DataFrame:
    """The written table of encoded texts."""
    arrow_batches(texts.sparkSession, BATCH_MB)
    key = F.lit(None).cast("string") if id_col is None else F.col(id_col).cast("string")
    rows = texts.select(key.alias("id"), F.col(text).alias("text"), (F.lit(True) if train is None else train).alias("train"))
    out = written(encoded(rows), "symbols")
    arrow_batches(texts.sparkSession, 2)  # of its rows, a few at once
    return out


def _decoded(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' hashes of a batch, all tokens as numbers of words on end (number 0 is the end), and the number of tokens of each text."""
    nums, sizes, words = unpack(data)
    return words, nums.astype(np.int64), sizes.astype(np.int64)


def token_counts(symbols: DataFrame, tokens: int) -> DataFrame:
    """``(w, c)`` of all tokens, by hash; ``tokens`` tells how many buckets are needed."""
    n = n_buckets(tokens)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def flush() -> pd.DataFrame:
            w, c = _added(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            out = [(int(bucket_of(w[s : s + 1], n)[0]), pack(steps(w[s:e]), c[s:e])) for s, e in _slices(bucket_of(w, n))]
            return pd.DataFrame(out, columns=["bucket", "data"])

        for b in batches:
            for data in b["data"]:
                words, nums, _ = _decoded(data)
                held.append((words, np.bincount(nums, minlength=len(words))))
            if sum(len(w) for w, _ in held) > _FLUSH:
                yield flush()
        if held:
            yield flush()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(x) for x in rows["data"]]
        w, c = _added(np.concatenate([whole(w) for w, _ in parts]), np.concatenate([c for _, c in parts]))
        return pd.DataFrame({"w": w.view(np.int64), "c": c})

    got = symbols.select("data").mapInPandas(run, "bucket int, data binary")
    return got.repartition(n, "bucket").groupBy("bucket").applyInPandas(merge, "w long, c long")


def _added(w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of equal words, sorted."""
    order = np.argsort(w)
    w = w[order]
    at = np.nonzero(np.r_[True, w[1:] != w[:-1]])[0]
    return w[at], np.add.reduceat(c[order], at)


@dataclass
class Tree:
    """The model; all of bounded size but the table ``grams``, which is not broadcast."""

    n: int  # training tokens
    v: int  # distinct ones
    words: np.ndarray  # hashes of head words, sorted
    counts: np.ndarray
    end_count: int
    depth: int = 0
    grams: DataFrame | None = None  # the tree: (level, ctx, w, v, c); w is null in a context's own row, which holds the rest's share
    near: dict[int, np.ndarray] = field(default_factory=dict)  # sorted keys of its broadcast rows by kind: 2 * level, and 1 more for a context's own
    logs: dict[int, np.ndarray] = field(default_factory=dict)  # their values
    filters: dict[int, np.ndarray] = field(default_factory=dict)  # of all rows of the kinds that are not broadcast in whole
    far: DataFrame | None = None  # the rows that are not broadcast: (kind, key, v)

    @property
    def total(self) -> float:
        return self.n + _ADD * (self.v + 1)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_word_hash, words), np.uint64, len(words))


def _ranks(words: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Places of words' hashes among those of the head words, or -1."""
    if not len(head):
        return np.full(len(words), -1, np.int32)
    p = np.minimum(np.searchsorted(head, words), len(head) - 1)
    return np.where(head[p] == words, p, -1).astype(np.int32)


def _turned(key: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Keys of contexts and the word that follows each."""
    return ((key << np.uint64(13)) | (key >> np.uint64(51))) ^ h


def _longer(ctx: Column, w: Column) -> Column:
    """The same on columns."""
    return F.shiftleft(ctx, 13).bitwiseOR(F.shiftrightunsigned(ctx, 51)).bitwiseXOR(w)


def context_keys(h: np.ndarray, length: int) -> np.ndarray:
    """Keys of the ``length`` words up to each position, from the ``length``-th on."""
    key = h[: max(0, len(h) - length + 1)]
    for k in range(1, length):
        key = _turned(key, h[k : len(h) - length + 1 + k])
    return key


def _summed(level: int, ctx: np.ndarray, rank: np.ndarray, w: np.ndarray, n: int) -> Iterator[tuple]:
    """``(level, bucket, data)`` of what a task counted, equal ones beside each other added up."""
    # a context's rows are dealt over a sixteenth of the buckets, so none holds all of a very common one
    bucket = bucket_of(ctx, n) ^ (w & np.uint64(max(1, n // 16) - 1)).astype(np.int64)
    # sorted enough to add up and to pack well; what is parted here meets in its bucket
    rest = 46 - (n.bit_length() - 1)
    order = np.argsort((bucket.astype(np.uint64) << np.uint64(64 - (n.bit_length() - 1)) if n > 1 else np.uint64(0)) | (ctx >> np.uint64(64 - rest) << np.uint64(18)) | (rank.astype(np.uint64) & np.uint64(0x3FFFF)))
    ctx, rank, w, bucket = ctx[order], rank[order], w[order], bucket[order]
    new = np.nonzero(np.r_[True, (ctx[1:] != ctx[:-1]) | (w[1:] != w[:-1])])[0]
    c = np.diff(np.r_[new, len(w)]).astype(np.uint32)
    ctx, rank, w, bucket = ctx[new], rank[new], w[new], bucket[new]
    for s, e in _slices(bucket):
        yield level, int(bucket[s]), pack(steps(ctx[s:e]), rank[s:e], w[s:e][rank[s:e] < 0], c[s:e])


def _slices(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """Ends of runs of equal values."""
    if not len(sorted_values):
        return []
    at = np.nonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1], True])[0].tolist()
    return list(zip(at[:-1], at[1:]))


def _totals(ctx: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of equal contexts and words."""
    key = _turned(ctx, w)
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, (ctx[order[1:]] != ctx[order[:-1]]) | (w[order[1:]] != w[order[:-1]])]
    if (new[1:] & (key[1:] == key[:-1])).any():  # two with the same key, which may lie mixed
        order = np.lexsort((w, ctx))
        new = np.r_[True, (ctx[order[1:]] != ctx[order[:-1]]) | (w[order[1:]] != w[order[:-1]])]
    at = np.nonzero(new)[0]
    return ctx[order[at]], w[order[at]], np.add.reduceat(c[order].astype(np.int64), at)


def gram_counts(symbols: DataFrame, levels: range, tree: Tree, contexts: np.ndarray, listed: np.ndarray, strings: np.ndarray | None = None, least: int = LISTED) -> DataFrame:
    """``(level, ctx, w, c)``: how often, from ``least`` times on, words follow contexts of each length.

    The filters hold the words of contexts, the words that may be listed, and the
    contexts of the first of the levels, which longer ones are made of.
    """
    shared = symbols.sparkSession.sparkContext.broadcast((tree.words, contexts, listed, strings))
    n = n_buckets(tree.n, 1 << 21)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, first, second, strings = shared.value
        held: dict[int, list[tuple]] = {level: [] for level in levels}
        size = 0

        def flush() -> Iterator[pd.DataFrame]:
            for level, some in held.items():
                counted = [np.concatenate(x) for x in zip(*some)]
                some.clear()
                if counted and len(counted[0]):
                    out = _summed(level, *counted, n)
                    yield pd.DataFrame(out, columns=["level", "bucket", "data"])

        for b in batches:
            for data in b["data"]:
                own, num, _ = _decoded(data)
                ranks = _ranks(own, head)
                use, end = passes(first, own), passes(second, own)
                use[0] = False
                h, inner, may, rank = own[num], use[num], end[num], ranks[num]
                key, ok = h, inner
                for level in range(1, levels[-1] + 1):
                    if level > 1:  # a context that ends here goes on from one that ended a word before
                        key = np.r_[np.zeros(1, np.uint64), _turned(key[:-1], h[1:])]
                        ok = np.r_[False, ok[:-1]] & inner
                    if level == levels[0] and strings is not None:
                        at = np.nonzero(ok)[0]
                        ok[at] = passes(strings, key[at])
                        inner = ok
                    if level in levels:
                        at = np.nonzero(ok[:-1] & may[1:])[0]
                        held[level].append((key[at], rank[at + 1], h[at + 1]))
                        size += len(at)
                if size > _FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    def merge(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        known, parts = shared.value[0], []
        for data in rows["data"]:
            ctx, rank, others, c = unpack(data)
            w = known[rank] if len(known) else np.zeros(len(rank), np.uint64)
            w[rank < 0] = others
            parts.append((whole(ctx), w, c))
        ctx, w, c = _totals(*(np.concatenate(x) for x in zip(*parts)))
        some = c >= least
        return pd.DataFrame({"level": np.int8(group[0]), "ctx": ctx[some].view(np.int64), "w": w[some].view(np.int64), "c": c[some].astype(np.int32)})

    got = symbols.select("data").mapInPandas(run, "level byte, bucket int, data binary")
    return got.repartition(n, "bucket").groupBy("level", "bucket").applyInPandas(merge, "level byte, ctx long, w long, c int")


def head_of(vocab: DataFrame, head: int = HEAD) -> Tree:
    """Totals, and the words with the highest counts, as many as surely fit."""
    n, v = vocab.agg(F.sum("c"), F.count("*")).first()
    n, v = int(n or 0), int(v or 0)
    rest = vocab.where(F.col("w") != _END)
    least = _least(rest, head)
    # as Arrow, so that the driver holds no object a value
    top = rest.where(F.col("c") >= least if least is not None else F.lit(False)).toArrow()
    words = top["w"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    ends = vocab.where(F.col("w") == _END).first()
    return Tree(n, v, words[order], top["c"].to_numpy()[order], int(ends["c"]) if ends else 0)


def _least(rows: DataFrame, most: int) -> int | None:
    """The count from which there are at most ``most`` rows, or None."""
    # counts in steps of a quarter octave: a histogram of a few hundred rows
    steps = rows.groupBy(F.floor(F.log2("c") * 4).alias("step")).agg(F.count("*").alias("k"), F.min("c").alias("least")).orderBy(F.desc("step")).collect()
    taken, least = 0, None
    for s in steps:
        if taken + s["k"] > most:
            break
        taken, least = taken + s["k"], s["least"]
    return least


def grow(symbols: DataFrame, vocab: DataFrame, tree: Tree, depth: int = DEPTH, min_count: int = MIN_COUNT, listed: int = LISTED, gain: float = GAIN, kappa: float = KAPPA, head_grams: int = HEAD_GRAMS) -> Tree:
    """Add the contexts of each length that pass the divergence test."""
    if listed > min_count:
        raise ValueError("a context has to occur as often as a word that it lists")
    if not tree.n or not depth:
        return tree
    known = vocab.select("w", "c", (F.col("w") == _END).alias("end"))
    p0 = known.where(F.col("c") >= listed).select("w", ((F.col("c") + _ADD) / tree.total).alias("up"))
    cand = known.where((F.col("c") >= min_count) & ~F.col("end")).select(F.col("w").alias("ctx"), F.lit(0).cast("long").alias("suffix"), F.col("c").alias("n"))
    blooms = bloom_filter(cand, "ctx"), bloom_filter(p0, "w")
    since = standing(symbols.sparkSession)
    counts = written(gram_counts(symbols, range(1, 2), tree, *blooms, least=listed), "pairs")
    below, each = None, Window.partitionBy("ctx")
    levels: list[DataFrame] = []
    for level in range(1, depth + 1):
        # some word or the end follows each occurrence of a context, so its total is its own count, found a level before
        rows = counts.select("ctx", "w", "c").join(cand, "ctx")
        # what the longest kept suffix says of the word; all that a context lists, its suffix lists too
        rows = rows.join(p0.withColumn("root", F.col("up")), "w") if below is None else rows.join(below, ["suffix", "w"])
        # one shuffle by contexts: what their rows share, and what coding by them saves
        rest = (F.col("n") - F.sum("c").over(each)).alias("rest")
        own, share = (F.col("c") + (kappa + F.col("rest")) * F.col("up")) / (F.col("n") + kappa), (kappa + F.col("rest")) / (F.col("n") + kappa)
        saved = F.sum(F.col("c") * F.log(own / F.col("up"))).over(each) + F.col("rest") * F.log(share)
        rows = rows.select("*", rest).select("*", (saved >= gain).alias("in"), (F.min("w").over(each) == F.col("w")).alias("first"))
        rows = written(rows, "grams")
        listing = rows.where("in").select("ctx", "w", F.log10(own / F.col("root")).alias("v"), "c")
        kept = rows.where("in and first").select("ctx", F.lit(None).cast("long").alias("w"), F.log10(share).alias("v"), F.col("n").alias("c"))
        levels.append(listing.union(kept).select(F.lit(level).alias("level"), "*"))
        if level < depth:
            cand = rows.where((F.col("c") >= min_count) & (F.col("w") != _END)).select(_longer(F.col("ctx"), F.col("w")).alias("ctx"), _longer(F.col("suffix"), F.col("w")).alias("suffix"), F.col("c").alias("n"))
            below = rows.select(F.col("ctx").alias("suffix"), "w", F.when(F.col("in"), own).otherwise(F.col("up")).alias("up"), "root")
            if level < 3:  # contexts of two words alone, as they are many, then all longer ones
                last = min(depth, 2) if level == 1 else depth
                some = written(gram_counts(symbols, range(level + 1, last + 1), tree, *blooms, bloom_filter(cand, "ctx"), least=listed), "longer")
            counts = some.where(F.col("level") == level + 1)
    table = levels[0]
    for more in levels[1:]:
        table = table.union(more)
    tree.grams, tree.depth = written(table, "tree", by=("level",)), depth
    release(symbols.sparkSession, since, 1)  # what the tree was made of
    return _near(tree, head_grams)


def _kind(level: Column, w: Column) -> Column:
    return (2 * level + w.isNull().cast("int")).cast("int")


def _near(tree: Tree, head_grams: int) -> Tree:
    """Take the rows with the highest counts to be broadcast; contexts' own rows, which every word that they don't list needs, first."""
    rows = tree.grams.select("level", _kind(F.col("level"), F.col("w")).alias("kind"), F.when(F.col("w").isNull(), F.col("ctx")).otherwise(_longer(F.col("ctx"), F.col("w"))).alias("key"), F.col("v").cast("float").alias("v"), "c")
    own, listing = rows.where("kind % 2 = 1"), rows.where("kind % 2 = 0")
    some = [(part, _least(part, most)) for part, most in ((own, head_grams // 4), (listing, head_grams - head_grams // 4))]
    some = [(part, least if least is not None else 1 << 62) for part, least in some]
    top = [part.where(F.col("c") >= least) for part, least in some]
    far = [part.where(F.col("c") < least) for part, least in some]
    tree.far = far[0].union(far[1]).select("kind", "key", "v")
    got = top[0].union(top[1]).select("kind", "key", "v").toArrow()
    kinds, keys, logs = (got[c].to_numpy() for c in ("kind", "key", "v"))
    have = rows.groupBy("kind").count().collect()
    for k in have:
        mine = np.nonzero(kinds == k["kind"])[0]
        order = mine[np.argsort(keys[mine].view(np.uint64))]
        tree.near[k["kind"]], tree.logs[k["kind"]] = keys[order].view(np.uint64), logs[order]
    part = {k["kind"]: k["count"] for k in have if len(tree.near[k["kind"]]) < k["count"]}
    # a level is a folder of the tree's table, so each reads its own
    tree.filters = {k: bloom_filter(rows.where((F.col("level") == k // 2) & (F.col("kind") == k)), "key", rows=n) for k, n in part.items()}
    return tree


def fit_symbols(symbols: DataFrame, head: int = HEAD, **params) -> tuple[Tree, DataFrame]:
    """The tree and the table of token counts ``(w, c)`` of encoded texts."""
    vocab = written(token_counts(symbols, int(symbols.agg(F.sum("n")).first()[0] or 0)), "tokens")
    return grow(symbols, vocab, head_of(vocab, head), **params), vocab


def fit(texts: DataFrame, head: int = HEAD, **params) -> tuple[Tree, DataFrame]:
    """The same of a table with a column ``text``."""
    return fit_symbols(symbols_of(texts), head, **params)


def _sieve(keys: np.ndarray) -> np.ndarray:
    """A small filter of sorted keys: most that are looked for are not there, and a search costs far more."""
    packed = np.zeros(n_bytes(len(keys)), np.uint8)
    add(packed, keys)
    return packed


def _at(keys: np.ndarray, sieve: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in sorted keys, or -1."""
    out = np.full(len(wanted), -1, np.int64)
    if len(keys):
        some = np.nonzero(passes(sieve, wanted))[0]
        own = wanted[some]
        p = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        out[some] = np.where(keys[p] == own, p, -1)
    return out


def _singles(tree: Tree, sieves: dict[int, np.ndarray], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words may be contexts, and their places among the broadcast ones, once a word."""
    if 3 not in tree.near:
        return np.zeros(len(words), bool), np.zeros(len(words), np.int64)
    return passes(tree.filters[3], words) if 3 in tree.filters else np.ones(len(words), bool), _at(tree.near[3], sieves[3], words)


def _gains(tree: Tree, sieves: dict[int, np.ndarray], words: np.ndarray, single: tuple[np.ndarray, np.ndarray], num: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """What contexts add to the unigram score at each position, as far as it is known here, and what is to be looked up.

    Look-ups are arrays of position, kind and key, and of what longer contexts add if
    the word turns out to be listed by this one.
    """
    h, inner = words[num], num > 0
    gain = np.zeros(len(h))
    levels: list[tuple] = []
    key, ok = h, inner
    for level in range(1, tree.depth + 1):
        if level > 1:
            key = np.r_[np.zeros(1, np.uint64), _turned(key[:-1], h[1:])]
            ok = np.r_[False, ok[:-1]] & inner
        own, listing = 2 * level + 1, 2 * level
        if own not in tree.near:
            continue
        at = np.nonzero(ok[:-1])[0]
        if level == 1:
            at = at[single[0][num[at]]]
            place = single[1][num[at]]
        else:
            if own in tree.filters:
                at = at[passes(tree.filters[own], key[at])]
            place = _at(tree.near[own], sieves[own], key[at])
        if own not in tree.filters:  # all kept contexts are here
            at, place = at[place >= 0], place[place >= 0]
        ctx, wide = key[at], _turned(key[at], h[at + 1])
        found = _at(tree.near[listing], sieves[listing], wide)
        there = found >= 0
        v = np.where(there, tree.logs[listing][found] if len(tree.logs[listing]) else 0.0, 0.0)
        # a word that the context doesn't list takes its share of the rest
        rest = np.where((place >= 0) & ~there, tree.logs[own][place] if len(tree.logs[own]) else 0.0, 0.0)
        ask = ~there & passes(tree.filters[listing], wide) if listing in tree.filters else np.zeros(len(at), bool)
        gain[at + 1] = np.where(there, v, gain[at + 1] + rest)
        levels.append((level, at + 1, ctx, wide, there, rest, ask, (place < 0) & ~there))
    asks = []
    over, settled = np.zeros(len(h)), np.zeros(len(h), bool)
    for level, at, ctx, wide, there, rest, ask, unsure in reversed(levels):
        free = ~settled[at]
        for kind, keys, some in ((2 * level, wide, ask & free), (2 * level + 1, ctx, unsure & free)):
            if some.any():
                asks.append((at[some], kind, keys[some], over[at[some]]))
        over[at] += rest
        settled[at] |= there
    return gain, asks


def _pieces(ends: np.ndarray, most: int = 1 << 17) -> list[tuple[int, int]]:
    """Whole texts of about so many tokens together."""
    last = np.nonzero(np.r_[ends[:-1] // most != ends[1:] // most, True])[0]
    at = ends[last].tolist()
    return list(zip([0, *at[:-1]], at))


#: What a row of the shuffle to buckets holds, and what tells kinds of keys apart.
_FACTS, _ASKS, _STATE = 0, 1, 2
_KIND = 0x9E3779B97F4A7C15


def _marks(kind: np.ndarray | int) -> np.ndarray:
    return np.asarray(kind, np.uint64) * np.uint64(_KIND)


def _facts(rows: DataFrame, n: int) -> DataFrame:
    """Rows ``(kind, key, v)`` packed by buckets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def flush() -> pd.DataFrame:
            key, v = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(key)
            key, v = key[order], v[order]
            out = [(int(bucket_of(key[s : s + 1], n)[0]), 0, _FACTS, None, pack(steps(key[s:e]), v[s:e])) for s, e in _slices(bucket_of(key, n))]
            return pd.DataFrame(out, columns=["bucket", "batch", "what", "ids", "data"])

        for b in batches:
            held.append((b["key"].to_numpy(np.int64).view(np.uint64) ^ _marks(b["kind"].to_numpy(np.int64)), b["v"].to_numpy(np.float64)))
            if sum(len(k) for k, _ in held) > _FLUSH:
                yield flush()
        if held:
            yield flush()

    return rows.select("kind", "key", "v").mapInPandas(run, _ROW)


_ROW = "bucket int, batch long, what byte, ids array<string>, data binary"


def _answers(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """What a bucket's keys are worth (NaN: not there), to each batch that asks; the batches' own rows pass."""
    what = rows["what"].to_numpy()
    facts = [unpack(x) for x in rows["data"][what == _FACTS]]
    keys = np.concatenate([whole(k) for k, _ in facts]) if facts else np.zeros(0, np.uint64)
    v = np.concatenate([v for _, v in facts]) if facts else np.zeros(0)
    order = np.argsort(keys)
    keys, v = keys[order], v[order]
    out = rows[what != _FACTS].copy()

    def found(data: bytes) -> bytes:
        wanted = whole(unpack(data)[0])
        if not len(keys):
            return pack(np.full(len(wanted), np.nan))
        p = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return pack(np.where(keys[p] == wanted, v[p], np.nan))

    out["data"] = [found(d) if k == _ASKS else d for k, d in zip(out["what"], out["data"])]
    return out


def score_symbols(symbols: DataFrame, tree: Tree, vocab: DataFrame) -> DataFrame:
    """``(id, n_tokens, n_known, base_score, score)`` of every text of encoded ones; ids are strings."""
    sieves = {k: _sieve(keys) for k, keys in tree.near.items()}
    shared = symbols.sparkSession.sparkContext.broadcast((replace(tree, grams=None, far=None), sieves))
    n = n_buckets(int(symbols.agg(F.sum("n")).first()[0] or 0) + tree.v)
    total = tree.total

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, sieves = shared.value
        logs = np.log10((np.r_[tree.counts, tree.end_count] + _ADD) / tree.total)
        for b in batches:
            for batch, ids, data in zip(b["batch"], b["ids"], b["data"]):
                own, num, sizes = _decoded(data)
                ranks = _ranks(own, tree.words)
                ranks[0] = len(tree.counts)
                h, rank, ends = own[num], ranks[num], np.cumsum(sizes)
                starts = ends - sizes
                gain, asks, single = [], [], _singles(tree, sieves, own)
                for s, e in _pieces(ends):
                    some, more = _gains(tree, sieves, own, single, num[s:e])
                    gain.append(some)
                    asks += [(at + s, *rest) for at, *rest in more]
                gain = np.concatenate(gain)
                base = np.add.reduceat(np.where(rank >= 0, logs[rank], 0.0), starts)
                more = np.add.reduceat(gain, starts)
                known = np.add.reduceat(((rank >= 0) & ((num > 0) | (tree.end_count > 0))).astype(np.int64), starts)
                # words that are not broadcast, once a text: what is kept of each is its number there
                miss = np.nonzero(rank < 0)[0]
                word, tf = np.unique(np.searchsorted(ends, miss, side="right") * len(own) + num[miss], return_counts=True)
                parts = [(own[word % len(own)], np.zeros(len(word), np.uint8), starts[word // len(own)].astype(np.uint32), tf.astype(np.float64))]
                for p, kind, keys, over in asks:
                    # a word that this context lists gets that instead of what is known so far
                    instead = over - gain[p] if kind % 2 == 0 else np.zeros(len(p))
                    parts.append((keys ^ _marks(kind), np.full(len(p), kind, np.uint8), p.astype(np.uint32), instead.astype(np.float32).astype(np.float64)))
                key, kind, pos, extra = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(key)
                key = key[order]
                bucket = bucket_of(key, n)
                out = [(int(bucket[s]), batch, _ASKS, None, pack(steps(key[s:e]))) for s, e in _slices(bucket)]
                state = pack(sizes.astype(np.uint32), known.astype(np.uint32), base, base + more, kind[order], pos[order], extra[order])
                out.append((n + int(batch % (1 << 20)), batch, _STATE, ids, state))
                yield pd.DataFrame(out, columns=["bucket", "batch", "what", "ids", "data"])

    def final(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["what", "bucket"])
        asked = rows["what"].to_numpy() == _ASKS
        state = rows[~asked].iloc[0]
        sizes, known, base, score, kind, pos, extra = unpack(state["data"])
        v = np.concatenate([unpack(x)[0] for x in rows["data"][asked]]) if asked.any() else np.zeros(0)
        told = ~np.isnan(v)
        ends, texts = np.cumsum(sizes.astype(np.int64)), len(sizes)
        of = np.searchsorted(ends, pos, side="right")
        # words: a count, or none
        w = kind == 0
        rest = np.bincount(of[w], extra[w] * np.log10((np.where(told, v, 0.0)[w] + _ADD) / total), texts)
        seen = np.bincount(of[w & told], extra[w & told], texts).astype(np.int64)
        # the longest context that lists the word, and the contexts that turned out to be kept and are longer
        level = (kind >> 1).astype(np.uint8)
        listed, shares = told & ~w & (kind % 2 == 0), told & (kind % 2 == 1)
        best = np.zeros(int(ends[-1]), np.uint8)
        np.maximum.at(best, pos[listed], level[listed])
        listed &= level == best[pos]
        shares &= level > best[pos]
        gain = np.bincount(of[listed], v[listed] + extra[listed], texts) + np.bincount(of[shares], v[shares], texts)
        return pd.DataFrame({"id": list(state["ids"]), "n_tokens": sizes.astype(np.int64), "n_known": known.astype(np.int64) + seen, "base_score": base + rest, "score": score + rest + gain})

    facts = vocab.select(F.lit(0).alias("kind"), F.col("w").alias("key"), F.col("c").cast("double").alias("v"))
    if tree.filters:
        facts = facts.union(tree.far.select("kind", "key", F.col("v").cast("double")))
    asks = symbols.select("batch", "ids", "data").mapInPandas(run, _ROW)
    met = asks.union(_facts(facts, n)).repartition(n, "bucket").groupBy("bucket").applyInPandas(_answers, _ROW)
    return met.groupBy("batch").applyInPandas(final, "id string, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, tree: Tree, vocab: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The same of every row of a table."""
    scored = score_symbols(symbols_of(docs, id_col, text), tree, vocab)
    return scored.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    symbols = symbols_of(docs, "doc_id", train=~held_out())
    tree, vocab = fit_symbols(symbols.where("train"))
    scored = score_symbols(symbols, tree, vocab).withColumn("doc_id", F.col("id").cast("long"))
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(tree.n).cast("long").alias("train_tokens"), "base_score", "score")

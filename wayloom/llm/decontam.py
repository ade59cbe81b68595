"""Benchmark decontamination by template windows.

Words are made canonical: folded in case, without punctuation at their rims.
Numbers, numbers with a unit, units after a number, and names (capitalised words
inside a sentence, not all in capitals) are slots with a type.  Every window of
``WINDOW`` words of an item has up to three forms: a template with a placeholder
for every slot; one with placeholders for numbers and units only, so that names
in other case don't matter; and the folded words themselves.  A template needs
``LITERALS`` words that are no slots.  Windows of documents pass a Bloom filter
that holds the items' windows; what passes is hash-joined with them in Spark,
and false positives end there.

Matches of a text and an item on one alignment form a group, which counts if the
words that it covers are enough.  Windows of folded words, and templates whose
slots have the item's own values, always count.  Other templates count if the
group's slots are consistent: a value of the item always meets the same value of
the text, while two values of the item may meet one.  A question with new numbers
or names is therefore caught, different uses of one value are not.

An item with fewer words than a window is one window as a whole.  With fewer than
``LEAST`` words it has to be the whole text.

A window that several items have, such as a fixed preamble or a template's words, is met
in each of them: every item that a text holds is found, however many share its windows.
Rows on the way are those of texts' windows and the items that have them: a long passage
of many items costs a row for each of its windows and each item that has it.

Texts are keyed by id and text, items by text: null ids take part, ids that repeat
with other texts are told apart, and rows that repeat both share their result.
``item_ids`` has all non-null ids of an item's text.  Nulls and empty texts have no
windows, so such rows stay; very long texts are read as a whole.  An empty
benchmark leaves all rows.  Further columns of any name are kept by
``decontaminate``; columns used on the way exist in tables apart only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wayloom.llm.bloom import bloom_filter, passes
from wayloom.session import arrow_batches, written

WINDOW = 8
LITERALS = 4
#: Words of an item that one alignment has to cover, if the item has that many.
COVER = 13
#: Items of fewer words have to be a whole text.
LEAST = 3
_BASE = np.uint64(0x9E3779B97F4A7C15)
# fixed values: measuring units that count as such after a number
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet mile miles meter meters metre metres mg g kg t lb lbs oz gram grams kilogram kilograms ton tons "
    "ml l liter liters litre litres s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent mph kmh kph kb mb gb tb hz khz mhz ghz v w kw kwh j kj cal kcal c f k".split()
)
_RIM = re.compile(r"^[^\w$€£%+\-]+|[^\w%$€£]+$")
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*[%$€£]?")
_MEASURE = re.compile(r"([$€£]?[+-]?\d[\d.,]*)([^\W\d]+)")
PLAIN, NUMBER, MEASURE, UNIT, CAPITAL = range(5)
_SLOT = np.array([0, 0xA5A5A5A5A5A5A5A5, 0x5BD1E9955BD1E995, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
TEMPLATE, NUMBERS, WORDS = range(3)


def canonical(word: str) -> tuple[int, bool, str]:
    """Kind, whether a sentence ends here, and the folded word."""
    if word.isalpha():
        low = word.casefold()
        if low in UNITS:
            return UNIT, False, low
        return (CAPITAL if word[0].isupper() and not word.isupper() else PLAIN), False, low
    bare = _RIM.sub("", word)
    ends = word[-1:] in ".!?:;" or word[-2:-1] in ".!?"
    low = bare.casefold()
    if _NUMBER.fullmatch(bare):
        return NUMBER, ends, low
    if (m := _MEASURE.fullmatch(bare)) and m[2].casefold() in UNITS:
        return MEASURE, ends, low
    if low in UNITS:
        return UNIT, ends, low
    return (CAPITAL if bare[:1].isupper() and bare != bare.upper() else PLAIN), ends, low


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width`` words on end."""
    acc = np.full(max(0, len(h) - width + 1), width, np.uint64)
    for k in range(width):
        acc *= _BASE
        acc += h[k : len(h) - width + 1 + k]
    acc ^= acc >> np.uint64(31)
    acc *= np.uint64(0x94D049BB133111EB)
    acc ^= acc >> np.uint64(29)
    return acc


class _Index(dict):
    """Numbers of words in the order in which they come."""

    def __init__(self) -> None:
        self.words: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n


class Words:
    """Canonical words by number; one for each task, renewed when it has grown."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.index = _Index()
        self.kind = np.zeros(0, np.int8)
        self.hash = np.zeros(0, np.uint64)
        self.ends = np.zeros(0, bool)
        self.values: list[str] = []

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All words of some texts on end, and how many each has."""
        if len(self.values) > 1_000_000:
            self.reset()
        flat: list[str] = []
        sizes = []
        for text in texts:
            own = (text or "").split()
            sizes.append(len(own))
            flat += own
        at = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        new = self.index.words[len(self.values) :]
        if new:
            kind, ends, values = zip(*map(canonical, new))
            self.kind = np.r_[self.kind, np.array(kind, np.int8)]
            self.ends = np.r_[self.ends, np.array(ends, bool)]
            self.hash = np.r_[self.hash, np.fromiter((xxhash.xxh64_intdigest(v.encode("utf-8", "surrogatepass"), 42) for v in values), np.uint64, len(values))]
            self.values += values
        return at, np.array(sizes, np.int64)

    def kinds(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The kinds of words in their texts."""
        kind = self.kind[at]
        if len(at):
            first, numeric = np.r_[True, self.ends[at[:-1]]], np.r_[False, kind[:-1] == NUMBER]
            heads = (np.cumsum(sizes) - sizes)[sizes > 0]
            first[heads], numeric[heads] = True, False
            kind[((kind == CAPITAL) & first) | ((kind == UNIT) & ~numeric)] = PLAIN
        return kind

    def slots(self, at: np.ndarray, kind: np.ndarray, p: int, width: int, form: int) -> list[str]:
        """The values in a window's slots, with their kinds."""
        if form == WORDS:
            return []
        return [f"{kind[i]}:{self.values[at[i]]}" for i in range(p, p + width) if kind[i] != PLAIN and not (form == NUMBERS and kind[i] == CAPITAL)]


def _forms(h: np.ndarray, kind: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Form, hashes of all windows, and which of them exist: a form that equals a plainer one is left out."""
    n = max(0, len(h) - width + 1)

    def slots(of: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(of)]
        return (total[width:] - total[: len(total) - width])[:n]

    some, named = slots((kind != PLAIN) & (kind != CAPITAL)), slots(kind == CAPITAL)
    yield WORDS, _rolled(h, width), np.ones(n, bool)
    if some.any():
        yield NUMBERS, _rolled(np.where((kind != PLAIN) & (kind != CAPITAL), _SLOT[kind], h), width), (some > 0) & (width - some >= LITERALS)
    if named.any():
        yield TEMPLATE, _rolled(np.where(kind != PLAIN, _SLOT[kind], h), width), (named > 0) & (width - some - named >= LITERALS)


def windows(rows: DataFrame, keys: list[str], bloom: np.ndarray | None = None, short: tuple[int, ...] | None = None, text: str = "text") -> DataFrame:
    """``(*keys, hash, width, form, pos, slots, n_words)`` of every window, or of those that pass the filter.

    ``short`` has the widths besides ``WINDOW``; with None, a shorter text is one window.
    """
    shared = rows.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed, words = shared.value, Words()
        for b in batches:
            at, sizes = words.numbers(b[text].tolist())
            kind, h = words.kinds(at, sizes), words.hash[at]
            ends = np.cumsum(sizes)
            of = np.repeat(np.arange(len(sizes)), sizes)
            got: list[tuple] = []
            for width in (WINDOW, *(range(1, WINDOW) if short is None else short)):
                if width > len(at):
                    continue
                last = len(at) - width + 1
                inside = of[:last] == of[width - 1 :]
                if width < (WINDOW if short is None else LEAST):
                    inside &= sizes[of[:last]] == width
                if not inside.any():
                    continue
                for form, hashes, real in _forms(h, kind, width):
                    real = real & inside
                    if packed is not None:
                        real &= passes(packed, hashes)
                    p = np.nonzero(real)[0]
                    starts = ends[of[p]] - sizes[of[p]]
                    got += [
                        (d, v, width, form, i - s, words.slots(at, kind, i, width, form), n)
                        for d, v, i, s, n in zip(of[p].tolist(), hashes[p].view(np.int64).tolist(), p.tolist(), starts.tolist(), sizes[of[p]].tolist())
                    ]
            out = pd.DataFrame(got, columns=["row", "hash", "width", "form", "pos", "slots", "n_words"])
            for k in keys:
                out[k] = b[k].to_numpy()[out.pop("row") if k == keys[-1] else out["row"]]
            yield out[[*keys, "hash", "width", "form", "pos", "slots", "n_words"]]

    arrow_batches(rows.sparkSession)
    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.where(F.col(text).isNotNull()).select(*keys, text).mapInPandas(run, f"{types}, hash long, width int, form int, pos int, slots array<string>, n_words int")


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Key and text: the id as a string, so that nulls don't turn numbers into floats, and a hash of the text."""
    return docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))


_ALIGNED = ("id", "th", "item", "shift")


def _aligned(found: DataFrame, items: DataFrame) -> DataFrame:
    """Windows of texts that meet windows of items: the alignment, the place in the item and what is in the slots."""
    right = items.select("hash", "width", "form", "item", F.col("pos").alias("at"), F.col("slots").alias("wants"), F.col("n_words").alias("item_words"))
    return found.join(right, ["hash", "width", "form"]).select(
        "id", "th", "item", (F.col("pos") - F.col("at")).alias("shift"), "item_words", "form", "at",
        ((F.col("form") == WORDS) | (F.col("wants") == F.col("slots"))).alias("same"), F.arrays_zip(F.col("wants").alias("want"), F.col("slots").alias("have")).alias("pairs"),
    )


def _covered(ats: Column) -> Column:
    """Words under the windows that begin at sorted places of an item."""
    begin = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    step = lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n"))
    return F.aggregate(ats, begin, step)["n"]


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, th, item, words)``: items, by the hash of their text, that a text holds, and the words that the best alignment covers."""
    texts = benchmark.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("item"), F.col(text).alias("text")).dropDuplicates(["item"])
    items = written(windows(texts, ["item"]), "items")
    short = tuple(sorted(r["width"] for r in items.where(F.col("width") < WINDOW).select("width").distinct().collect()))
    found = written(windows(_keyed(docs, id_col, text), ["id", "th"], bloom_filter(items), short), "found")
    met = _aligned(found, items)
    # a group is at most the windows of one item
    at = lambda cond: F.collect_set(F.when(cond, F.col("at")))
    pairs = lambda form: F.array_distinct(F.flatten(F.collect_set(F.when(F.col("form") == form, F.col("pairs")))))
    groups = met.groupBy(*_ALIGNED, "item_words").agg(
        at(F.col("same")).alias("literal"), *[x.alias(f"{n}{f}") for f in (TEMPLATE, NUMBERS) for n, x in (("at", at(F.col("form") == f)), ("pairs", pairs(f)))]
    )
    side = lambda f: F.size(F.array_distinct(F.transform(f"pairs{f}", lambda p: p["want"])))
    ats = F.col("literal")
    for f in (TEMPLATE, NUMBERS):
        ats = F.when(side(f) == F.size(f"pairs{f}"), F.array_union(ats, F.col(f"at{f}"))).otherwise(ats)
    # a shorter item is one window, which has to be there as a whole
    need = F.least(F.col("item_words"), F.greatest(F.lit(WINDOW), F.least(F.lit(COVER), F.col("item_words") - 4)))
    good = groups.withColumn("words", F.least(F.col("item_words"), _covered(F.array_sort(ats)))).where(F.col("words") >= need)
    return good.groupBy("id", "th", "item").agg(F.max("words").alias("words"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text: str = "text") -> DataFrame:
    """``(id, th, item_ids, words)`` of texts that hold items: the id as a string and the hash of the text are the key."""
    ids = benchmark.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("item"), F.col(item_col).alias("item_id"))
    found = matches(docs, benchmark, id_col, text).join(ids, "item")
    return found.groupBy("id", "th").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("words").alias("words"))


def _with(docs: DataFrame, found: DataFrame, how: str, id_col: str, th: Column) -> DataFrame:
    # written, so that its size is known: a small one is broadcast by Spark's own threshold, else both sides are shuffled
    right = written(found.withColumnsRenamed({"id": "__id", "th": "__th"}), "contaminated")
    return docs.join(right, docs[id_col].cast("string").eqNullSafe(F.col("__id")) & (th == F.col("__th")), how)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold an item of the benchmark."""
    return _with(docs, contaminated(docs, benchmark, id_col, text=text).select("id", "th"), "left_anti", id_col, F.xxhash64(docs[text]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    keys = docs.select("doc_id", F.xxhash64("text").alias("_own"))
    return _with(keys, contaminated(docs, benchmark), "left", "doc_id", F.col("_own")).select(
        "doc_id", F.col("__th").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("words", F.lit(0)).alias("words")
    )

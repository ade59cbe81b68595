"""SimHash near-duplicates by ball hashing that meets in the middle.

Two fingerprints that differ in at most ``radius`` bits have a point in between
that is within ``radius // 2`` bits of both.  Every fingerprint therefore has its
whole ball of half the radius as variants (2081 for 64 bits and radius 4), and
fingerprints that meet in a variant are linked to the smallest one there: any two
that meet are within the radius, so a star of links keeps the component and no
group is expanded into pairs.

A variant is not shuffled as a row of its own: variants are shuffled by their
first ``PREFIX`` bits, so a fingerprint goes once to each prefix that any of its
variants has (137 rows for 16 bits), and where it arrives, its variants with that
prefix are made, sorted and compared, ``LIMIT`` at a time.  A prefix with more is
worked off by further digits, so no group has to fit in memory as variants.

Only distinct fingerprints are dealt.  Nulls and empty texts have fingerprint zero
and are linked like any other; long texts are read as a whole.  A row's component
is the smallest non-null id among all rows that its fingerprint reaches, so rows
with a null id get that of their group, and null if the group has no other.
Repeated rows get the same result.  An empty table gives none.  Of the input only
id and text are read, so further columns of any name don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wayloom.functions.arrays import let
from wayloom.operators.components import components
from wayloom.session import arrow_batches, cut, written

#: Bits by which variants are shuffled, and variants that a task compares at once.
PREFIX, LIMIT = 16, 1 << 21
#: Blocks of 32 bits of a wide fingerprint, an even number.
BLOCKS = 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_LANE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def shingle_hashes(text: str | None, shingle: int, seed: int = 42, block: int = 1 << 16) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles, repeats included, some at a time; of the whole text if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    last = max(1, len(words) - shingle + 1)
    starts = (ends - lens)[:last].tolist()
    ends = ends[-last:].tolist()
    for i in range(0, last, block):
        yield np.array([hashed(joined[s:e], seed) for s, e in zip(starts[i : i + block], ends[i : i + block])], np.uint64)


def _ones(h: np.ndarray) -> np.ndarray:
    """How many hashes have each byte value in each place, from the highest byte on."""
    return np.bincount((h.astype(">u8").view(np.uint8).reshape(-1, 8) + _LANE).ravel(), minlength=2048)


def _majority(ones: np.ndarray, n: int) -> bytes:
    return np.packbits((ones.reshape(8, 256) @ _BITS).ravel() * 2 > n).tobytes()


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42, block: int = 1 << 16) -> int:
    """SimHash of a text's word shingles, as an unsigned 64-bit number."""
    ones, n = np.zeros(2048, np.int64), 0
    for h in shingle_hashes(text, shingle, seed, block):
        ones += _ones(h)
        n += len(h)
    return int.from_bytes(_majority(ones, n), "big")


def wide_fingerprint(text: str | None, shingle: int, blocks: int) -> np.ndarray:
    """SimHash of ``32 * blocks`` bits, as blocks of 32: each two come from hashes mixed in another way."""
    ones, n = np.zeros((blocks // 2, 2048), np.int64), 0
    for h in shingle_hashes(text, shingle):
        n += len(h)
        for k in range(blocks // 2):
            x = (h ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0x94D049BB133111EB)
            ones[k] += _ones(x ^ x >> np.uint64(32))
    return np.frombuffer(b"".join(_majority(row, n) for row in ones), ">u4").astype(np.uint32)


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4) -> DataFrame:
    """``docs`` with a column ``fp``: the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).astype(np.int64))

    arrow_batches(docs.sparkSession)
    return docs.withColumn("fp", fp(F.col(text)))


def _spread(rows: DataFrame) -> DataFrame:
    """Few small rows that become many: dealt over all tasks first."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")


@lru_cache(maxsize=64)
def _masks(bits: int, flips: int) -> np.ndarray:
    """Every change of at most ``flips`` of the lowest ``bits`` bits."""
    return np.array([sum(1 << b for b in some) for n in range(min(flips, bits) + 1) for some in combinations(range(bits), n)], np.uint64)


def _pairs(group: np.ndarray, own: np.ndarray, chain: bool) -> np.ndarray:
    """Pairs within groups: each with the smallest, and with ``chain`` with the one before it too."""
    order = np.lexsort((own, group))
    group, own = group[order], own[order]
    first = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], np.arange(len(group)), 0))
    pairs = np.stack([order, order[first]], 1)
    if chain:
        pairs = np.concatenate([pairs, np.stack([order[1:], order[:-1]], 1)[group[1:] == group[:-1]]])
    return pairs


def _met(fp: np.ndarray, base: np.ndarray, left: np.ndarray, bits: int, limit: int, value: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Pairs ``(fp, lo)`` of fingerprints that meet in a variant: each with the smallest, and where blocks have a ``value`` with the one before it too.

    ``base`` is a variant whose lowest ``bits`` bits may change in ``left`` more places.
    Too many variants at once are worked off by the next digit of eight bits.
    Equal values have all their variants in common; such pairs are left to ``_same``,
    which gives them once.
    """
    sizes = np.array([len(_masks(bits, k)) for k in range(int(left.max()) + 1)]) if len(left) else np.zeros(1, int)
    if len(fp) < 2:
        return
    if bits > 8 and sizes[left].sum() > limit:
        low = np.uint64(bits - 8)
        digit = (base >> low) & np.uint64(255)
        for j in range(256):
            d = np.bitwise_count(digit ^ np.uint64(j)).astype(left.dtype)
            ok = d <= left
            if ok.sum() > 1:
                yield from _met(fp[ok], base[ok] ^ ((digit[ok] ^ np.uint64(j)) << low), left[ok] - d[ok], bits - 8, limit, None if value is None else value[ok])
        return
    parts = [(np.nonzero(left == k)[0], _masks(bits, k)) for k in range(len(sizes))]
    variants = np.concatenate([(base[at][:, None] ^ masks[None, :]).ravel() for at, masks in parts])
    ordered = np.sort(variants)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return
    owner = np.concatenate([np.repeat(at, len(masks)) for at, masks in parts])
    # a bitmap first: few variants occur twice
    seen = np.zeros(1 << 22, bool)
    seen[(twice & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
    some = np.nonzero(seen[(variants & np.uint64((1 << 22) - 1)).astype(np.int64)])[0]
    at = np.minimum(np.searchsorted(twice, variants[some]), len(twice) - 1)
    hit = twice[at] == variants[some]
    own = owner[some[hit]]
    pairs = own[_pairs(at[hit], fp[own], value is not None)]
    if value is not None:
        pairs = pairs[value[pairs[:, 0]] != value[pairs[:, 1]]]
    yield np.unique(fp[pairs[pairs[:, 0] != pairs[:, 1]]], axis=0)


def _same(fp: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Pairs ``(fp, lo)`` of one value: each with the smallest and the one before it.

    If in a variant the smallest, or the one before, has the same value, it is the same one here.
    """
    pairs = fp[_pairs(value, fp, True)]
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def _meetings(sent: DataFrame, low: int, half: int, limit: int, blocks: bool) -> DataFrame:
    """``(fp, lo)`` that meet, some more than once: rows ``(fp, head, base, mask)`` have a variant, with the changes ``mask`` above its lowest ``low`` bits, which may change in as many places as are left of ``half``.

    Blocks of other fingerprints can have one value; distinct fingerprints are their own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        n = 0

        def flush(fp: np.ndarray, head: np.ndarray, base: np.ndarray, mask: np.ndarray) -> Iterator[pd.DataFrame]:
            left = half - np.bitwise_count(mask).astype(np.int64)
            cost = np.cumsum(np.array([len(_masks(low, k)) for k in range(half + 1)])[left])
            fp, base = fp.view(np.uint64), base.view(np.uint64)
            value = base ^ (mask.astype(np.uint64) << np.uint64(low)) if blocks else None
            edges = np.r_[np.nonzero(np.r_[True, head[1:] != head[:-1]])[0], len(head)]
            start = 0
            while start < len(edges) - 1:  # as many groups of one head as go at once
                done = cost[edges[start] - 1] if edges[start] else 0
                end = max(start + 1, int(np.searchsorted(cost[edges[1:] - 1], done + limit, side="right")))
                s, e = edges[start], edges[end]
                found = _met(fp[s:e], base[s:e], left[s:e], low, limit, value[s:e] if blocks else None)
                if blocks:
                    own = s + np.nonzero(mask[s:e] == 0)[0]
                    found = chain([_same(fp[own], base[own])], found)
                for pairs in found:
                    yield pd.DataFrame({c: np.ascontiguousarray(pairs[:, k]).view(np.int64) for k, c in enumerate(("fp", "lo"))})
                start = end

        for b in batches:
            rows = tuple(b[c].to_numpy() for c in ("fp", "head", "base", "mask"))
            if not len(rows[0]):
                continue
            held.append(rows)
            n += len(rows[0])
            if n > limit // 8 and held[0][1][0] != rows[1][-1]:
                rows = tuple(np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(rows[1], rows[1][-1]))  # the last head may go on in the next batch
                yield from flush(*(x[:cut] for x in rows))
                held, n = [tuple(x[cut:] for x in rows)], n - cut
        if n:
            yield from flush(*(np.concatenate(x) for x in zip(*held)))

    parts = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(parts, "head").sortWithinPartitions("head").mapInPandas(run, "fp long, lo long")


def _columns(masks: np.ndarray) -> Column:
    return F.array(*[F.lit(int(m)).cast("long") for m in masks])


def links(fps: DataFrame, radius: int = 4, prefix: int = PREFIX, limit: int = LIMIT) -> DataFrame:
    """Links ``(fp, lo)`` between distinct fingerprints that span all components within ``radius``."""
    if radius % 2 or radius < 0:
        raise ValueError("the radius has to be even")
    half, low = radius // 2, 64 - prefix
    # a variant is sent by its first bits; how its other bits vary is worked out where it arrives
    sent = _spread(fps.select("fp")).select("fp", F.explode(_columns(_masks(prefix, half))).alias("mask"))
    sent = sent.withColumn("base", F.col("fp").bitwiseXOR(F.shiftleft("mask", low)))
    sent = sent.select("fp", F.shiftrightunsigned("base", low).alias("head"), "base", F.col("mask").cast("int").alias("mask"))
    return _meetings(sent, low, half, limit, False).distinct()


def near_groups(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """``(id, th, fp, component)``: each row's fingerprint, a hash of its text and the smallest id reachable over links."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("__text"))
    rows = cut(fingerprints(rows, "__text", shingle).select("id", "th", "fp"))
    fps = rows.groupBy("fp").agg(F.min("id").alias("least"))
    comp = components(links(fps.select("fp"), radius), "fp", "lo")
    # a component of any size: its members are dealt over salts, its one name is repeated for each
    salts = 64
    linked = fps.join(comp.withColumnRenamed("node", "fp"), "fp").select("fp", "least", F.col("component").alias("root"), F.pmod(F.hash("fp"), F.lit(salts)).alias("salt"))
    linked = cut(linked)
    roots = linked.groupBy("root").agg(F.min("least").alias("component")).select("root", "component", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    named = linked.join(roots, ["root", "salt"]).select("fp", "component")
    alone = fps.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component"))
    return rows.join(named.union(alone), "fp").select("id", "th", "fp", "component")


def _block_variants(rows: DataFrame) -> DataFrame:
    """Rows ``(fp, head, base, mask)`` of ``(fp, blocks)`` for each change of at most one of the 16 high bits of each block."""
    sent = rows.select("fp", F.posexplode("blocks").alias("block", "value")).select("fp", "block", "value", F.explode(_columns(_masks(16, 1))).alias("mask"))
    sent = sent.withColumn("base", F.shiftleft(F.col("block").cast("long"), 32).bitwiseOR(F.col("value").bitwiseXOR(F.shiftleft("mask", 16))))
    return sent.select("fp", F.shiftrightunsigned("base", 16).alias("head"), "base", F.col("mask").cast("int").alias("mask"))


def met_texts(texts: DataFrame, shingle: int = 5, blocks: int = BLOCKS, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """``(fp, blocks)`` of rows ``(th, text)``, and pairs ``(fp, lo)`` whose wide fingerprints differ in at most two bits of some block.

    In a variant each meets the smallest and the one before it; others that share it are ``rest``'s.
    """

    @F.pandas_udf("array<long>")
    def wide(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for own in batches:
            yield pd.Series([wide_fingerprint(t, shingle, blocks).astype(np.int64) for t in own], dtype=object)

    arrow_batches(texts.sparkSession)
    rows = cut(texts.select(F.col("th").alias("fp"), wide("text").alias("blocks")))
    return rows, written(_meetings(_block_variants(_spread(rows)), 16, 1, limit, True).distinct(), "met")


def candidates(rows: DataFrame, met: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Pairs of ``met`` that differ in at most a quarter of all bits.

    Texts with a similarity of 0.8 differ in about 0.15 of all bits; a quarter of 512 is
    six standard deviations more.
    """
    side = lambda name, c: rows.select(F.col("fp").alias(name), F.col("blocks").alias(c))
    apart = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return met.join(side("fp", "a"), "fp").join(side("lo", "b"), "lo").where(apart <= 8 * blocks).select("fp", "lo")


def _sets(shingle: int):
    @F.pandas_udf("array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for own in batches:
            yield pd.Series([np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(t, shingle)])).view(np.int64) for t in own], dtype=object)

    return sets


def _alike(texts: DataFrame, pairs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Those of ``pairs`` of texts whose sets of shingles have that similarity."""
    asked = pairs.select(F.explode(F.array("fp", "lo")).alias("th")).distinct()
    some = written(texts.join(asked, "th").select("th", _sets(shingle)("text").alias("set")), "sets")
    # the set of a text that many others are compared with is repeated, once for each thousand of them
    many = pairs.groupBy("lo").agg(F.ceil(F.count("*") / 1000).cast("int").alias("salts"))
    left = pairs.join(many, "lo").withColumn("salt", F.pmod(F.hash("fp"), F.col("salts"))).select("fp", "lo", "salt")
    left = left.join(some.withColumnsRenamed({"th": "fp", "set": "a"}), "fp")
    right = some.withColumnsRenamed({"th": "lo", "set": "b"}).join(many, "lo").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    both = left.join(right, ["lo", "salt"])
    common = let(F.size(F.array_intersect("a", "b")), lambda n: n / F.greatest(F.lit(1), F.size("a") + F.size("b") - n))
    return both.where((common >= similarity) | ((F.size("a") == 0) & (F.size("b") == 0))).select("fp", "lo")


def crowded(met: DataFrame, comp: DataFrame) -> DataFrame:
    """``(th, comp)`` of texts that may share a variant with others that they didn't meet, and are not yet of one component with.

    Of a variant's texts all meet the smallest; where three or more did, and not all of
    these are linked, two of them may not have met.
    """
    root = comp.select(F.col("node").alias("fp"), "component")
    ends = met.join(root, "fp", "left").select("fp", "lo", F.coalesce("component", "fp").alias("comp"))
    some = ends.groupBy("lo").agg(F.count("*").alias("n"), F.min("comp").alias("least"), F.max("comp").alias("most")).where("n > 2 and least < most")
    return ends.join(some.select("lo"), "lo", "left_semi").select(F.col("fp").alias("th"), "comp").distinct()


def rest(texts: DataFrame, asked: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """All pairs ``(fp, lo)`` of ``asked (th, comp)`` of two components that can have that similarity, by their rarest shingles.

    With shingles ordered by how many texts have them, the rarest first, the first one that
    two similar sets share has so few before it in both that the others can still be enough.
    So a text sends only its first, and only those that texts of two components have meet.
    """
    own = written(texts.join(asked, "th").select("th", "comp", _sets(shingle)("text").alias("set")), "crowded")
    # texts without a word have one set, that of a shingle of their own
    own = own.withColumn("set", F.when(F.size("set") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.col("set")))
    each = own.select("th", F.explode("set").alias("gram"))
    often = each.groupBy("gram").agg(F.count("*").alias("n"))
    # a shingle of one text alone comes first and meets none: it is counted, not sent
    shared = each.join(often.where("n > 1"), "gram").groupBy("th").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("grams"))
    size = F.col("size")
    # the epsilon: a product that is whole has to stay so
    last = (1 - similarity) * size + 1e-6
    sent = own.select("th", "comp", F.size("set").alias("size")).join(shared, "th").withColumn("alone", size - F.size("grams"))
    sent = sent.select("th", "comp", "size", "alone", F.posexplode("grams").alias("at", "gram")).select("th", "comp", "size", (F.col("at") + F.col("alone")).alias("at"), F.col("gram.gram").alias("gram"))
    sent = written(sent.where(F.col("at") <= last), "rare")
    # of a shingle's texts those of the largest component are not compared with each other
    parts = sent.groupBy("gram", "comp").agg(F.count("*").alias("n")).groupBy("gram").agg(F.max_by("comp", F.struct("n", "comp")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    at = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("th", "comp", "size", "at")]
    a = sent.join(parts, "gram").where("comp <> most").select("gram", "most", *at("a"))
    b = sent.join(parts, "gram").select("gram", *at("b"))
    need = similarity / (1 + similarity) * (F.col("size_a") + F.col("size_b")) - 1e-6
    left = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    once = (F.col("comp_b") == F.col("most")) | (F.col("th_a") > F.col("th_b"))
    both = a.join(b, "gram").where((F.col("comp_a") != F.col("comp_b")) & once & (left >= need))
    return both.select(F.greatest("th_a", "th_b").alias("fp"), F.least("th_a", "th_b").alias("lo")).distinct()


def _linked(texts: DataFrame, similarity: float, shingle: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Links ``(fp, lo)`` between similar texts, and components ``(node, component)`` of these."""
    rows, met = met_texts(texts, shingle, blocks)
    links = written(_alike(texts, written(candidates(rows, met, blocks), "pairs"), similarity, shingle), "links")
    comp = written(components(links, "fp", "lo"), "comp")
    asked = written(crowded(met, comp), "asked")
    if asked.isEmpty():
        return links, comp
    more = written(_alike(texts, written(rest(texts, asked, similarity, shingle), "rest"), similarity, shingle), "more")
    if more.isEmpty():
        return links, comp
    return links.union(more), components(comp.select(F.col("node").alias("fp"), F.col("component").alias("lo")).union(more), "fp", "lo")


def similar(texts: DataFrame, similarity: float = 0.8, shingle: int = 5, blocks: int = BLOCKS) -> DataFrame:
    """Links ``(fp, lo)`` between texts ``(th, text)`` whose sets of word shingles have that Jaccard similarity.

    Of texts that share a variant of a block, any two of that similarity are in one component of these.
    """
    return _linked(texts, similarity, shingle, blocks)[0]


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """One text of each group of similar texts: that with the smallest id, of such the one with the smallest hash; columns stay as they are.

    Texts are linked by the Jaccard similarity of their sets of word shingles.  At 0.8
    about a seventh of all bits of a SimHash differ, too many for a ball around 64 of them,
    so a fingerprint has ``blocks`` blocks of 32 bits, each with its ball: texts that
    differ in at most two bits of some block are compared.  Two texts without a word
    are the same.  Rows that repeat id and text stay or go together.  Of rows with a
    null id one text stays only if its group has no id.
    """
    key = [F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th")]
    rows = docs.select(*key, F.coalesce(text, F.lit("")).alias("text"))
    # copies of a text are one; the first row of each has the smallest id, null last
    ids = rows.groupBy("th").agg(F.min("id").alias("least"))
    texts = rows.dropDuplicates(["th"]).select("th", "text")
    comp = _linked(texts, similarity, shingle, blocks)[1]
    salts = 64
    grouped = cut(ids.join(comp.withColumnRenamed("node", "th"), "th", "left").select("th", "least", F.coalesce("component", "th").alias("root")))
    order = F.struct(F.col("least").isNull().alias("none"), "least", "th")
    first = grouped.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    # a group of any size: its members are dealt over salts, its first one is repeated for each
    many = first.where("n > 1").select("root", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    named = grouped.withColumn("salt", F.pmod(F.hash("th"), F.lit(salts))).join(many, ["root", "salt"]).where("th <> first.th").select(F.col("th").alias("__th"))
    stay = docs.join(written(named, "gone"), F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col("__th"), "left_anti")
    # of copies of one text with several ids the smallest id stays
    again = written(rows.select("id", "th").distinct().join(ids, "th").where("least IS NOT NULL AND NOT id <=> least").select(F.col("id").alias("__id"), F.col("th").alias("__th")), "copies")
    return stay.join(again, stay[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(stay[text], F.lit(""))) == F.col("__th")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )

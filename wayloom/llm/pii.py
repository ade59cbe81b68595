"""Personal data by bootstrapped contextual extraction, in built-in functions only.

Base matches (email, ip, card, phone) and tokens that are secrets by their shape
seed the extraction.  The words around an instance, to the left, to the right or
both, are its lexical patterns.  Patterns and instances form a graph that Spark
scores in rounds: a pattern is as good as the share of its distinct instances that
are known to be of one kind, an instance as good as its patterns together make it.
Instances that confident patterns discover are known in the next round; rounds end
when there is no new pattern and no new instance.  Confident patterns then name
the candidates beside them, and values that they discovered are named elsewhere
too if they are long.  Base spans always stay; the method only adds spans that
overlap none, and a secret by its shape is added only where patterns confirm it.

Matches are leftmost and don't overlap within a kind.  Possessive quantifiers
and a look-behind give the same matches as the plain patterns in linear time and
without deep recursion, however long a text or a run of digits is.  Context is
taken by offsets over neighbouring matches; words longer than ``LEFT`` or
``RIGHT`` characters count by the part that is nearer.

Nulls and empty texts have no spans.  Rows that repeat id and text get the same
result, each once; null ids are kept; equal scores of two kinds go to the later
name.  An empty table gives none.  Only id and text are read, so further columns
of any name don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wayloom.functions.arrays import let, prefix_sums
from wayloom.session import cut, written

KINDS = ("email", "ip", "card", "phone")
# fixed values: what the kinds look like
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_HINTS = {"email": "@", "phone": "+"}
#: What may turn out to be an identifier: groups of digits with separators, addresses that are written out or broken, and
#: tokens of four characters at least with a digit among them.
_TOKEN = "[A-Za-z0-9_+/=@-]"
_SEP = "[ ().:/-]"
CANDIDATE = (
    rf"(?<![A-Za-z0-9]|[0-9]{_SEP}{{1,2}})\(?[0-9](?:{_SEP}?{_SEP}?[0-9]){{4,}}+(?![A-Za-z0-9_@=+-])"
    rf"|(?<!{_LOCAL}){_LOCAL}++ ?(?:@|[\[(]at[\])]) ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)*+"
    rf"|(?<![A-Za-z0-9_+/=@.:-])(?=[A-Za-z_+/=@-]*+[0-9])(?:{_TOKEN}|[.:](?={_TOKEN})){{4,}}+"
)
SECRET = r"^(?:[0-9a-f]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,})$"
#: A pattern counts from so many distinct known instances, and from such a share of one kind among its instances,
#: in which an instance that nothing is known of weighs as much as ``UNKNOWN`` others; so much makes an instance known.
SUPPORT, CONFIDENCE, UNKNOWN = 5, 0.8, 0.1
#: Characters of context on the left and on the right, from which the nearest words are taken.
LEFT, RIGHT = 160, 80
#: A discovered value is an identifier wherever it stands from so many characters on.
LONG = 8


def _located(text: Column, pattern: str) -> Column:
    """All matches: array of start, end (code points), value, and what stands left and right of it."""

    def place(x: Column) -> Column:
        pieces, found = x["pieces"], x["found"]
        ends = prefix_sums(F.transform(found, lambda v, i: F.length(F.get(pieces, i)) + F.length(v)))
        at = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))
        # context goes on over neighbouring matches
        before = lambda i: F.concat(*[F.right(at(a, i - k), F.lit(LEFT)) for k in (2, 1) for a in (pieces, found)], F.right(at(pieces, i), F.lit(LEFT)))
        after = lambda i: F.concat(F.left(at(pieces, i + 1), F.lit(RIGHT)), *[F.left(at(a, i + k + d), F.lit(RIGHT)) for k in (1, 2) for a, d in ((found, 0), (pieces, 1))])
        return let(ends, lambda e: F.transform(found, lambda v, i: F.struct(
            (F.get(e, i) - F.length(v)).alias("start"), F.get(e, i).alias("end"), v.alias("value"),
            F.right(before(i), F.lit(LEFT)).alias("left"), F.left(after(i), F.lit(RIGHT)).alias("right"),
        )))

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return let(both, place)


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= F.when(F.ltrim(p, F.lit("0")) <= "255", 3).otherwise(2))
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


_SPAN = "array<struct<start: bigint, end: bigint, value: string, left: string, right: string>>"


def found(text: Column, kind: str) -> Column:
    """Base spans of one kind; texts that can't hold any are not searched twice."""
    hint = F.contains(text, F.lit(_HINTS[kind])) if kind in _HINTS else text.rlike({"ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][ -]?){15}[0-9]"}[kind])
    return F.when(hint, F.filter(_located(text, PATTERNS[kind]), lambda m: _passes(kind, m["value"]))).otherwise(F.array().cast(_SPAN))


def _spans(kind: Callable[[Column], Column], spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(kind(s).alias("kind"), *[s[c].alias(c) for c in ("start", "end", "value", "left", "right")]))


def base_table(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, th, base, more``: base spans of each row, and its candidates that overlap none of them."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(*[_spans(lambda s, k=k: F.lit(k), found(t, k)) for k in KINDS])
    more = F.when(t.rlike("[0-9@]|[\\[(]at[\\])]"), _located(t, CANDIDATE)).otherwise(F.array().cast(_SPAN))
    more = _spans(lambda s: F.when(s["value"].rlike(SECRET), F.lit("secret")), more)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(t).alias("th"), let(F.struct(base.alias("base"), more.alias("more")), lambda x: x).alias("x"))
    free = F.filter("x.more", lambda m: ~F.exists("x.base", lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"])))
    return rows.select("id", "th", "x.base", free.alias("more"))


def patterns_of(left: Column, right: Column) -> Column:
    """The lexical patterns of an instance: the last one and two words before it, the first after it, and both; case and digits are folded."""
    fold = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "0")
    words = lambda k: F.regexp_extract(fold(left), rf"((?:\S+\s+){{{k}}}\S*)$", 1)
    # a word that has letters or signs of its own; a number says nothing
    after = F.regexp_extract(fold(right), r"^(\S*\s+\S*[^\s0]\S*)", 1)

    def some(x: Column) -> Column:
        one, two, behind = x["one"], x["two"], x["behind"]
        has = lambda c: F.trim(c) != ""
        return F.array(
            F.when(has(one), F.concat(one, F.lit("_"))), F.when(has(two), F.concat(two, F.lit("_"))),
            F.when(has(behind), F.concat(F.lit("_"), behind)), F.when(has(one) & has(behind), F.concat(one, F.lit("_"), behind)),
        )

    return F.array_compact(let(F.struct(words(1).alias("one"), words(2).alias("two"), after.alias("behind")), some))


def instances_of(base: DataFrame) -> DataFrame:
    """``(id, th, kind, start, end, value, size, patterns)`` of all base spans and candidates; kind is null for what no seed covers."""
    rows = base.select("id", "th", F.explode(F.concat(F.transform("base", lambda b: b.withField("own", F.lit(True))), F.transform("more", lambda m: m.withField("own", F.lit(False))))).alias("m"))
    return rows.select(
        "id", "th", "m.kind", "m.start", "m.end", F.xxhash64("m.value").alias("value"), F.length("m.value").alias("size"), patterns_of(F.col("m.left"), F.col("m.right")).alias("patterns"), "m.own"
    )


def graph(instances: DataFrame) -> DataFrame:
    """Distinct edges ``(pattern, value, kind)``."""
    return instances.select(F.explode("patterns").alias("pattern"), "value", "kind").distinct()


def score_graph(edges: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, unknown: float = UNKNOWN) -> tuple[DataFrame, DataFrame]:
    """Confident patterns ``(pattern, kind, score)`` and discovered instances ``(value, kind, score)``.

    Rounds go on until neither gets any more; both only grow.
    """
    edges = written(edges, "edges")
    seeds = cut(edges.where("kind is not null").select("value", "kind").distinct().withColumn("score", F.lit(1.0)))
    pairs = cut(edges.select("pattern", "value").distinct())
    sizes = pairs.groupBy("pattern").agg(F.count("*").alias("n"))
    told = seeds.where(F.lit(False))
    patterns = edges.where(F.lit(False)).select("pattern", "kind", F.lit(0.0).alias("score"))
    had = (0, 0)
    while True:
        known = pairs.join(seeds.union(told), "value").groupBy("pattern", "kind").agg(F.sum("score").alias("good"), F.count("*").alias("known"))
        every = known.groupBy("pattern").agg(F.sum("known").alias("every"))
        share = F.col("good") / (F.col("every") + unknown * F.greatest(F.lit(0), F.col("n") - F.col("every")))
        fresh = known.join(every, "pattern").join(sizes, "pattern").withColumn("score", share).where((F.col("known") >= support) & (F.col("score") >= confidence))
        patterns = cut(patterns.union(fresh.select("pattern", "kind", "score")).groupBy("pattern", "kind").agg(F.max("score").alias("score")))
        found = pairs.join(patterns, "pattern").groupBy("value", "kind").agg(either(F.col("score")).alias("score"))
        told = cut(found.where(F.col("score") >= confidence).join(seeds.select("value"), "value", "left_anti"))
        have = (patterns.count(), told.count())
        if have == had:
            return patterns, told
        had = have


def either(score: Column) -> Column:
    """That one of several patterns is right, each with its score."""
    return 1 - F.exp(F.sum(F.log(F.greatest(1 - score, F.lit(1e-6)))))


def extract(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """``id, base, spans``: base spans of every row, and all spans (kind, start, end)."""
    base = written(base_table(docs, id_col, text), "spans")
    instances = written(instances_of(base), "instances")
    patterns, told = score_graph(graph(instances), **params)
    free = instances.where("not own")
    key = ["id", "th", "start", "end"]
    by_pattern = free.select(*key, F.explode("patterns").alias("pattern")).join(patterns, "pattern").groupBy(*key, "kind").agg(either(F.col("score")).alias("score"))
    by_value = free.where(F.col("size") >= LONG).select(*key, "value").join(told, "value").select(*key, "kind", "score")
    named = by_pattern.union(by_value).groupBy(*key).agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    new = named.groupBy("id", "th").agg(F.collect_set(F.struct("kind", "start", "end")).alias("new"))
    new = new.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "new")
    plain = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    both = base.select("id", "th", plain.alias("base")).join(new, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    order = lambda k: F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), k).cast("int"), F.lit(0))
    rank = lambda k: F.when(order(k) > 0, order(k)).otherwise(len(KINDS) + 1)
    keyed = lambda s: F.struct(rank(s["kind"]).alias("k"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    every = F.array_sort(F.transform(F.concat("base", F.coalesce("new", F.array().cast("array<struct<kind: string, start: bigint, end: bigint>>"))), keyed))
    return both.select("id", "base", F.transform(every, lambda s: F.struct(s["kind"], s["start"], s["end"])).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = extract(docs)
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return rows.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

"""Quality rules as a bitmask ledger, in built-in functions only.

Every rule is evaluated once: the ledger keeps each document's measurements and
a ``failed`` mask with one bit a rule.  A policy is a named version, a mask of
the rules that it applies, so verdicts of any version and ablations (what each
rule alone rejects, what would come back without it) are bitwise sums over the
ledger, without another look at the texts.

A null text has no words; empty texts fail the length rule; texts of any length are
measured as a whole, in memory that grows with the text.  Repeated rows are measured
alike, and each is counted.  An empty table gives an empty ledger and counts of zero.
Columns of the input are kept, but for those that have the names of the
measurements' struct and of the mask, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wayloom.functions.arrays import let
from wayloom.session import written

# fixed values: white space that parts words, and the symbols that are counted
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
_SPLIT = r"[ \t\n\x0B\f\r]+"


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeated(windows: Column) -> Column:
    """Words in windows of three that occur twice or more; ``windows`` are the windows' hashes in order."""

    def covered(at: Column) -> Column:
        """Words under the windows that begin at sorted positions."""
        gap = F.transform(at, lambda p, i: F.when(i + 1 < F.size(at), F.least(F.lit(3), F.get(at, i + 1) - p)).otherwise(F.lit(3)))
        return F.aggregate(gap, F.lit(0).cast("long"), lambda a, x: a + x)

    def twice(pairs: Column) -> Column:
        """Positions of windows that have an equal neighbour when sorted."""
        h = lambda i: F.get(pairs, i)["h"]
        same = F.filter(pairs, lambda p, i: ((i > 0) & (h(i - 1) == p["h"])) | ((i + 1 < F.size(pairs)) & (h(i + 1) == p["h"])))
        return F.sort_array(F.transform(same, lambda p: p["i"]))

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    found = let(pairs, lambda s: let(twice(s), covered))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(found)


def measurements(docs: DataFrame, text: str = "text", out: str = "m") -> DataFrame:
    """``docs`` with a struct ``out`` of everything that the rules look at."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, _SPLIT), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    windows = lambda w: F.when(F.size(w) > 2, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            let(windows(w), _repeated).alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    chars = F.length(t)
    rows = docs.withColumns({"__w": let(words, of_words), "__l": let(lines, of_lines)})
    return rows.withColumn(
        out,
        F.struct(
            "__w.n_words",
            F.length(_without(t, SPACES)).cast("long").alias("word_chars"),
            (chars - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
            "__l.n_dup_lines",
            "__w.n_repeat_words",
            "__w.n_distinct",
            "__l.n_lines",
            (chars - F.length(_without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).cast("long").alias("n_capitals"),
            (chars - F.length(_without(t, "!?"))).cast("long").alias("n_shouts"),
        ),
    ).drop("__w", "__l")


def rules(m: str = "m") -> dict[str, Column]:
    """Name to whether a document fails; the order gives the bits."""
    c = lambda name: F.col(f"{m}.{name}")
    n = c("n_words")
    return {
        "few_words": n < 50,
        "repeats": 100 * c("n_repeat_words") > 50 * n,
        "symbols": 100 * c("n_symbols") > 10 * n,
        "shouting": (100 * c("n_capitals") > 40 * c("word_chars")) | (100 * c("n_shouts") > 30 * n),
        "long_words": c("word_chars") > 14 * n,
        "short_words": c("word_chars") < 2 * n,
        "dup_lines": (c("n_lines") > 3) & (100 * c("n_dup_lines") > 30 * c("n_lines")),
        "poor_words": (n >= 50) & (100 * c("n_distinct") < 5 * n),
    }


BASE = ("few_words", "repeats")
#: Versioned policies: the rules that each applies.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "shouting", "long_words", "short_words", "dup_lines"),
    "v2": (*BASE, "symbols", "shouting", "long_words", "short_words", "dup_lines", "poor_words"),
}


def mask(names: tuple[str, ...]) -> int:
    order = list(rules())
    return sum(1 << order.index(n) for n in names)


def ledger(docs: DataFrame, text: str = "text", m: str = "m", failed: str = "failed") -> DataFrame:
    """``docs`` with the measurements ``m`` and ``failed``, the bits of the rules that each document fails."""
    bits = [F.when(fails, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, fails in enumerate(rules(m).values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measurements(docs, text, m).withColumn(failed, total)


def kept(policy: str, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """Of each rule of a policy: how many documents fail it, fail it alone, and would be kept without it."""
    whole = mask(POLICIES[policy])
    parts = []
    for name in POLICIES[policy]:
        bit = F.lit(mask((name,))).cast("long")
        fails = F.col("failed").bitwiseAND(bit) != 0
        alone = F.col("failed").bitwiseAND(F.lit(whole).cast("long")) == bit
        parts.append(F.struct(F.lit(name).alias("rule"), F.count_if(fails).alias("n_failed"), F.count_if(alone).alias("n_alone")))
    total = rows.agg(F.count("*").alias("n"), F.array(*parts).alias("rules"), F.bit_or("failed").alias("any_failed"))
    return total.select("n", F.inline("rules")).withColumn("policy", F.lit(policy))


def alone(policy: str, failed: str = "failed") -> Column:
    """The rule that alone keeps a document out of a policy, or null."""
    bits = F.col(failed).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long"))
    names = F.create_map(*[x for name in POLICIES[policy] for x in (F.lit(mask((name,))).cast("long"), F.lit(name))])
    return F.try_element_at(names, bits)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's digest; with the rule that alone rejects a document, how many documents it alone rejects."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledgers = written(ledger(docs).drop("text"), "ledger")
    counts = ablations(ledgers, "v2").select(F.col("rule").alias("only_rule"), F.col("n_alone").alias("n_only_rule"))
    rows = ledgers.withColumn("only_rule", alone("v2")).join(F.broadcast(counts), "only_rule", "left")  # a row a rule
    m = [F.col(f"m.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    base = ~kept("base")
    return rows.select("doc_id", *m, base.alias("base_failed"), kept("v2").alias("kept"), "failed", "only_rule", F.coalesce("n_only_rule", F.lit(0)).cast("long").alias("n_only_rule"))


def _oracle() -> str:
    return r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l,
             CAST(length(text) AS BIGINT) AS chars FROM d),
p AS (SELECT *, row_number() OVER () AS rid FROM w),
tri AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM p, unnest(generate_series(1, len(w) - 2)) u(i)),
rep AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, t) AS n FROM tri) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range(3) r(k) GROUP BY rid),
m AS (SELECT p.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  chars - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct, chars - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
  chars - length(regexp_replace(text, '[!?]', '', 'g')) AS n_shouts FROM p LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < 50 AS f0, 100 * n_repeat_words > 50 * n_words AS f1, 100 * n_symbols > 10 * n_words AS f2,
  100 * n_capitals > 40 * word_chars OR 100 * n_shouts > 30 * n_words AS f3, word_chars > 14 * n_words AS f4, word_chars < 2 * n_words AS f5,
  n_lines > 3 AND 100 * n_dup_lines > 30 * n_lines AS f6, n_words >= 50 AND 100 * n_distinct < 5 * n_words AS f7 FROM m),
g AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 OR f1 AS base_failed,
  NOT (f0 OR f1 OR f2 OR f3 OR f4 OR f5 OR f6 OR f7) AS kept,
  CAST(f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT + 32 * f5::INT + 64 * f6::INT + 128 * f7::INT AS BIGINT) AS failed FROM f),
o AS (SELECT *, CASE failed WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeats' WHEN 4 THEN 'symbols' WHEN 8 THEN 'shouting' WHEN 16 THEN 'long_words'
  WHEN 32 THEN 'short_words' WHEN 64 THEN 'dup_lines' WHEN 128 THEN 'poor_words' END AS only_rule FROM g)
SELECT *, CASE WHEN only_rule IS NOT NULL THEN count(*) OVER (PARTITION BY only_rule) ELSE 0 END AS n_only_rule FROM o
"""


ORACLE = _oracle()

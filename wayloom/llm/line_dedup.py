"""Line dedup: repeated runs of lines by a suffix array from prefix doubling.

Lines become line ids, documents become sequences of them; lines that occur once
end a run.  Round ``k`` of prefix doubling ranks suffixes by their first ``2^k``
lines: the pair of a suffix's rank and that of the suffix half as many lines
ahead is sorted over the cluster and numbered in that order.  Rounds go on, for
suffixes that still share a rank, until no two that go on are left; a suffix's
ranks, read one after the other, are its place in the suffix array.

A run counts from ``min_words`` words.  For every suffix, ``depth`` is the number
of lines that reach so many words.  Neighbours in the suffix array whose longest
common prefix is at least that are one interval; whether it is, is read from the
ranks of the two blocks, one from the left and one from the right, that cover
those lines.  Of an interval the suffix that comes first by (id, position) stays;
the lines that the later ones share with it are deleted.

So later copies of every maximal repeated run go as a whole, whatever its length.
A line of a run has so many words from itself on within the run, and is deleted
as the head of an interval's suffix; or it has them up to itself, so the shortest
blocks that reach the words up to a line are compared in the same way; or else it
is in the depth of the run's first line.

Only DataFrame functions are used.  Hot lines are aggregated before they are
shuffled; joins on line ids or ranks are plain equi-joins that adaptive execution
may split; neighbours are found per range of the sorted suffixes, with a row a
range for its rim.

A null text stays null and has no lines; an empty one is one empty line.  Rows
that repeat both id and text are one document and get the same result; of texts
with the same id, that with the smaller hash comes first; null ids come first of
all.  Texts of any length are split into rows, but the lines of one document that
occur elsewhere have to fit a task as a sorted window.  An empty table gives none.
Columns of the input are kept, but for those that have the names in ``counts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wayloom.functions.arrays import let
from wayloom.session import cut, written

#: Words from which a repeated run of lines is deleted.
MIN_WORDS = 30
_DOC = ("_id", "_th")


def line_table(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row a line: document key, position, line id (two hashes) and words."""
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    return rows.select(
        *_DOC, "pos", F.xxhash64("line").alias("h"), F.hash("line", F.length("line")).alias("g"), F.regexp_count("line", F.lit(r"[^ \t\n\x0B\f\r]+")).alias("words")
    )


def number(keys: DataFrame, *cols: str) -> DataFrame:
    """Distinct rows numbered in their sorted order: ranks with gaps, by range partition."""
    return cut(keys.orderBy(*cols).withColumn("rank", F.monotonically_increasing_id()))


def _again(rows: DataFrame, *cols: str) -> DataFrame:
    return rows.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1").drop("n")


def _chains(rows: DataFrame) -> DataFrame:
    """``rows`` with ``chain``, the same for lines on end, and ``upto``, the chain's words up to a line."""
    by = Window.partitionBy(*_DOC).orderBy("pos")
    chain = Window.partitionBy(*_DOC, "chain").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("chain", F.col("pos") - F.row_number().over(by)).withColumn("upto", F.sum("words").over(chain))


def _depths(rows: DataFrame, min_words: int) -> DataFrame:
    """``rows`` with ``depth``: lines from here, all repeated and on end, that reach ``min_words``."""
    rows = _chains(rows)
    # each line asks for the first line at which the running count reaches its goal
    events = rows.select(
        "*", F.explode(F.array(F.struct(F.col("upto").alias("at"), F.lit(1).alias("kind")), F.struct((F.col("upto") - F.col("words") + min_words).alias("at"), F.lit(0).alias("kind")))).alias("e")
    )
    back = Window.partitionBy(*_DOC, "chain").orderBy(F.desc("e.at"), F.desc("e.kind"), F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    reached = F.last(F.when(F.col("e.kind") == 1, F.col("pos")), ignorenulls=True).over(back)
    events = events.withColumn("reach", F.when(F.col("e.kind") == 0, reached))
    return events.where("e.kind = 0").withColumn("depth", F.col("reach") - F.col("pos") + 1).drop("e", "upto", "chain", "reach")


def _tails(rows: DataFrame, min_words: int) -> DataFrame:
    """Blocks ``(_id, _th, pos, depth)``: the shortest that reach ``min_words`` up to each line, without those of ``_depths``."""
    begin = F.col("upto") - F.col("words")
    events = _chains(rows).select(
        *_DOC, "pos", "chain", begin.alias("begin"),
        F.explode(F.array(F.struct(begin.alias("at"), F.lit(0).alias("kind")), F.struct((F.col("upto") - min_words).alias("at"), F.lit(1).alias("kind")))).alias("e"),
    )
    # each line asks for the last line from which the running count reaches its own
    upto = Window.partitionBy(*_DOC, "chain").orderBy("e.at", "e.kind", "pos").rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(F.col("e.kind") == 0, F.struct("pos", "begin")), ignorenulls=True).over(upto)
    ends = events.withColumn("start", start).where((F.col("e.kind") == 1) & (F.col("begin") - F.col("start.begin") >= min_words))
    return ends.select(*_DOC, F.col("start.pos").alias("pos"), (F.col("pos") - F.col("start.pos") + 1).alias("depth"))


def suffix_ranks(rows: DataFrame) -> DataFrame:
    """``rows (_id, _th, pos, .., r0)`` with ``ranks``: those by the first 1, 2, 4 .. lines, as far as others share them."""
    by = Window.partitionBy(*_DOC).orderBy("pos")
    rows = rows.withColumn("ranks", F.array("r0")).withColumn("tied", F.lit(True)).drop("r0")
    step = 1
    while True:
        ahead = F.when(F.lead("pos", step).over(by) == F.col("pos") + step, F.lead("ranks", step).over(by))
        rows = written(rows.withColumn("own", F.when(F.col("tied"), F.element_at("ranks", -1))).withColumn("ahead", F.when(F.col("tied"), ahead)), "suffixes")
        # suffixes at whose end nothing follows come first, and are settled with that
        pairs = rows.where("tied").groupBy("own", "ahead").agg(F.count("*").alias("n"))
        pairs = number(pairs.withColumn("tied", (F.col("n") > 1) & F.col("ahead").isNotNull()).drop("n"), "own", "ahead")
        ranked = rows.where("tied").drop("tied").alias("a").join(pairs.alias("b"), (F.col("a.own") == F.col("b.own")) & F.col("a.ahead").eqNullSafe(F.col("b.ahead")))
        ranked = ranked.select(*_DOC, "pos", "words", "depth", F.concat("ranks", F.array("rank")).alias("ranks"), "tied")
        rows = rows.where("not tied").select(ranked.columns).union(ranked)
        if pairs.where("tied").isEmpty():
            return written(rows.drop("tied"), "suffixes")
        step *= 2


def _neighbours(asked: DataFrame) -> DataFrame:
    """Suffixes in the order of the suffix array: ``here``, ``end`` and ``begin``, the number of its interval's first suffix."""
    block = F.struct("depth", "left", "right")
    # equal suffixes by their place, so that a hot interval can be more than one range
    order = asked.orderBy("ranks", "depth", "left", "right", "here").select("here", "end", block.alias("block"), F.monotonically_increasing_id().alias("i"))
    order = written(order.withColumn("range", F.shiftright("i", 33)), "order")
    by, ranges = Window.partitionBy("range").orderBy("i"), Window.orderBy("range")
    # a row a range: the last block before it
    rims = order.groupBy("range").agg(F.max_by("block", "i").alias("last")).select("range", F.lag("last").over(ranges).alias("rim"))
    order = order.join(F.broadcast(rims), "range").withColumn("before", F.coalesce(F.lag("block").over(by), "rim"))
    # the longest common prefix with the suffix before reaches the depth where the blocks are the same
    order = written(order.withColumn("first", F.when(~F.col("block").eqNullSafe(F.col("before")), F.col("i"))).drop("rim", "before"), "order")
    rims = order.groupBy("range").agg(F.max("first").alias("last")).select("range", F.last("last", ignorenulls=True).over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias("rim"))
    return order.join(F.broadcast(rims), "range").select("here", "end", F.coalesce(F.last("first", ignorenulls=True).over(by), "rim").alias("begin"))


def _later(blocks: DataFrame, *interval: str) -> DataFrame:
    """The blocks of each interval but the one that comes first: ``(_id, _th, pos, end)``."""
    first = blocks.groupBy(*interval).agg(F.min("here").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # written, so that the join has plain shuffles on both sides and adaptive execution can split a hot interval
    return blocks.join(written(first, "intervals"), list(interval)).where("here > first").select("here.*", "end")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans ``(_id, _th, spans)`` of the lines to delete: maximal runs, first and last position."""
    lines = cut(line_table(docs, id_col, text))
    ids = number(_again(lines, "h", "g"), "h", "g")
    rows = lines.join(ids, ["h", "g"]).select(*_DOC, "pos", "words", F.col("rank").alias("r0"))
    rows = rows.repartition(*_DOC).dropDuplicates([*_DOC, "pos"])
    rows = cut(_depths(rows, min_words))
    tails = written(_tails(rows, min_words), "tails")
    rows = suffix_ranks(rows)
    level = F.floor(F.log2(F.col("depth").cast("double") + 0.5)).cast("int")
    asking = rows.where("depth is not null").select(*_DOC, "pos", "depth", "ranks", F.lit(False).alias("tail"))
    asking = asking.unionByName(tails.join(rows.drop("depth", "words"), [*_DOC, "pos"]).withColumn("tail", F.lit(True)))
    asking = asking.withColumn("level", level).withColumn("left", F.get("ranks", F.col("level"))).where("left is not null")
    at = asking.withColumn("at", F.col("pos") + F.col("depth") - F.pow(F.lit(2), "level").cast("int"))
    other = rows.select(*[F.col(c).alias(f"_{c}") for c in _DOC], F.col("pos").alias("_at"), F.col("ranks").alias("_ranks"))
    same_row = F.col("_id").eqNullSafe(F.col("__id")) & (F.col("_th") == F.col("__th")) & (F.col("at") == F.col("_at"))
    blocks = at.join(other, same_row).withColumn("right", F.get("_ranks", F.col("level"))).where("right is not null")
    # keys in a struct, so that null ids take part
    blocks = blocks.select(F.struct(*_DOC, "pos").alias("here"), (F.col("pos") + F.col("depth") - 1).alias("end"), "depth", "left", "right", "ranks", "tail")
    blocks = written(blocks, "blocks")
    gone = _later(_neighbours(blocks.where("not tail")), "begin").union(_later(blocks.where("tail").drop("ranks"), "depth", "left", "right"))
    # covers that touch or overlap become one run
    by = Window.partitionBy(*_DOC).orderBy("pos")
    runs = gone.withColumn("upto", F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("run", F.sum((F.col("upto").isNull() | (F.col("pos") > F.col("upto") + 1)).cast("int")).over(by))
    spans = runs.groupBy(*_DOC, "run").agg(F.min("pos").alias("first"), F.max("end").alias("last"))
    return spans.groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))


def _without(lines: Column, spans: Column) -> Column:
    """Lines outside the spans; linear in their number."""
    def pick(i: Column) -> Column:
        begin = F.when(i > 0, F.get(spans, i - 1)["last"] + 1).otherwise(F.lit(0))
        end = F.when(i < F.size(spans), F.get(spans, i)["first"]).otherwise(F.size(lines))
        return F.slice(lines, begin + 1, end - begin)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), pick))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text: str = "text", counts: tuple[str, str] = ("n_lines", "n_deleted")) -> DataFrame:
    """``docs`` without the lines of later copies, plus the numbers of lines and of those deleted.

    Columns of ``docs`` that have the names in ``counts`` are replaced.
    """
    spans = repeats(docs, min_words, id_col, text).select(F.col("_id").alias("__id"), F.col("_th").alias("__th"), F.col("spans").alias("__spans"))
    both = docs.join(spans, docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text]) == F.col("__th")), "left")
    lines = F.split(F.col(text), "\n", -1)
    kept = let(lines, lambda x: F.array_join(_without(x, F.col("__spans")), "\n"))
    gone = F.aggregate("__spans", F.lit(0), lambda acc, s: acc + s["last"] - s["first"] + 1)
    new = {text: F.when(F.col("__spans").isNull(), F.col(text)).otherwise(kept)}
    size = F.when(F.col(text).isNotNull(), F.size(lines))
    found = zip(counts, (size, gone))
    return both.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns if c not in counts], *[F.coalesce(v, F.lit(0)).cast("long").alias(c) for c, v in found])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_deleted", "text")


#: The same by plain comparison of texts: every shortest window of lines that reaches the words from a line on or up
#: to a line, against its first occurrence.
ORACLE = rf"""
WITH d AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(generate_series(0, len(lines) - 1)) AS pos, lines FROM d),
w AS (SELECT doc_id, pos, len(regexp_extract_all(lines[pos + 1], '[^ \t\n\x0B\f\r]+')) AS n FROM l),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM w),
m AS (SELECT a.doc_id, a.pos AS a, b.pos AS b FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.n >= {MIN_WORDS}),
win AS (SELECT doc_id, a AS pos, min(b) AS last FROM m GROUP BY 1, 2 UNION SELECT doc_id, max(a), b FROM m GROUP BY doc_id, b),
k AS (SELECT win.*, md5(array_to_string(d.lines[win.pos + 1 : win.last + 1], chr(10))) AS body, last - win.pos AS len FROM win JOIN d USING (doc_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY body, len ORDER BY doc_id, pos) AS nth FROM k),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(pos, last)) AS pos FROM f WHERE nth > 1),
kept AS (SELECT l.doc_id, string_agg(l.lines[l.pos + 1], chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL) AS text,
                count(*) AS n_lines, count(gone.pos) AS n_deleted
         FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted,
       CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM documents LEFT JOIN kept USING (doc_id)
"""

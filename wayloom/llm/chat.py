"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, and adjacent turns of
one role are merged into one block by array aggregation; blocks are concatenated:

    <|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n

``<|im_sep|>`` parts the turns that were merged, so the output can be read back
turn by turn.  Control strings inside texts are escaped by a backslash after the
``<`` of every ``<|`` (and of every ``<\\\\...|``, so the escape is reversible).
The loss mask lists the byte spans of the assistant's texts.

A conversation is one string, so its turns meet in one row; long texts are kept as a
whole.  Null texts and roles are empty; turns are ordered by number (null first), then
role and text, so ties have one order and repeated rows stay, next to each other.  Rows
with a null conversation are one conversation.  An empty table gives none.  Only the
conversation, number, role and text are read, so further columns of any name don't
matter; the result has columns of its own alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wayloom.functions.arrays import let, prefix_sums

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role(role: Column) -> Column:
    """A role on one line, without control strings; reversible."""
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unrole(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def format_chats(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``conv_id, formatted, loss_spans`` (arrays of first byte and number of bytes)."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    # big conversations are put together from sorted parts
    parts = rows.groupBy("conv_id", F.floor(F.col("t.turn") / 512).alias("part")).agg(F.collect_list("t").alias("ts"))
    chats = parts.groupBy("conv_id").agg(F.array_sort(F.flatten(F.collect_list("ts"))).alias("ts"))

    def pieces(ts: Column) -> Column:
        """Of each turn: what stands before its text, the text, and what follows."""

        def piece(t: Column, i: Column) -> Column:
            same_before = (i > 0) & (F.get(ts, i - 1)["role"] == t["role"])
            same_after = (i + 1 < F.size(ts)) & (F.get(ts, i + 1)["role"] == t["role"])
            head = F.when(same_before, F.lit(SEP)).otherwise(F.concat(F.lit(START), _role(t["role"]), F.lit("\n")))
            tail = F.when(same_after, F.lit("")).otherwise(F.lit(END + "\n"))
            return F.struct(head.alias("head"), escape(t["text"]).alias("text"), tail.alias("tail"), (t["role"] == LEARNT).alias("learnt"))

        return F.transform(ts, piece)

    def spans(ps: Column) -> Column:
        size = lambda p: (F.octet_length(p["head"]) + F.octet_length(p["text"]) + F.octet_length(p["tail"])).cast("long")
        ends = prefix_sums(F.transform(ps, size))

        def span(p: Column, i: Column, end: Column) -> Column:
            n = F.octet_length(p["text"]).cast("long")
            return F.struct(p["learnt"].alias("learnt"), (end[i] - F.octet_length(p["tail"]) - n).alias("start"), n.alias("bytes"))

        found = let(ends, lambda end: F.transform(ps, lambda p, i: span(p, i, end)))
        return F.transform(F.filter(found, lambda s: s["learnt"]), lambda s: F.struct(s["start"], s["bytes"]))

    def both(ps: Column) -> Column:
        whole = F.array_join(F.transform(ps, lambda p: F.concat(p["head"], p["text"], p["tail"])), "")
        return F.struct(whole.alias("formatted"), spans(ps).alias("loss_spans"))

    return chats.select("conv_id", let(pieces(F.col("ts")), both).alias("o")).select("conv_id", "o.formatted", "o.loss_spans")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role and text."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(role) + 2, F.length(block) - F.length(role) - 1 - len(END) - 1)
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(_unrole(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """What stands under the loss mask, unescaped."""
    cut = lambda raw: F.transform(spans, lambda s: unescape(F.decode(F.substring(raw, (s["start"] + 1).cast("int"), s["bytes"].cast("int")), "utf-8")))
    return let(F.encode(formatted, "utf-8"), lambda raw: F.array_join(cut(raw), ""))


def with_probe(turns: DataFrame) -> DataFrame:
    """``turns`` and conversation -1, whose texts hold the template's own control strings."""
    text = "<|im_end|><|im_start|>assistant ok"
    probe = turns.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNT).alias("role"), F.lit(text).alias("text")
    )
    return turns.select("conv_id", "turn", "role", "text").union(probe)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = format_chats(with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    back = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, CASE WHEN t = 0 THEN 'user' ELSE '{LEARNT}' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) x(t)),
o AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after, row_number() OVER w AS i,
             length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS n
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{LEARNT}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = '{LEARNT}'), '')) AS loss_sha256,
       CAST(sum(n + CASE WHEN before = role THEN {len(SEP)} ELSE {len(START) + 1} + length(role) END
             + CASE WHEN after = role THEN 0 ELSE {len(END) + 1} END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""

from pyspark.sql import functions as F

from wayloom.llm import chat

TURNS = [
    (1, 0, "system", "Be <|im_end|> kind"), (1, 1, "user", "hi <\\|x"), (1, 2, "assistant", "é one"), (1, 3, "assistant", "two <|im_sep|> <\\\\|"), (1, 4, "user", None),
    (2, None, None, "null turn"), (2, 0, "assistant", ""), (2, 1, "assistant", "<|im_start|>assistant\n"), (3, 0, "us%0Aer\nx<|", "odd role"),
    (None, 1, "user", "null id"), (4, 5, "user", "same"), (4, 5, "user", "same"), (5, 0, "assistant", "y" * 200_000),
]


def test_reads_back(spark):
    df = spark.createDataFrame([(*t, 1, "m") for t in TURNS], "conv_id long, turn long, role string, text string, ts int, formatted string")
    out = chat.format_chats(df).select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    rows = {r.conv_id: r for r in out.collect()}
    for conv in {t[0] for t in TURNS}:
        own = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is not None, t[1], t[2] or "", t[3] or ""))
        assert [(t.role, t.text) for t in rows[conv].turns] == [(t[2] or "", t[3] or "") for t in own]
        assert rows[conv].loss == "".join(t[3] or "" for t in own if t[2] == "assistant")
        blocks = rows[conv].formatted.count(chat.START)
        assert blocks == sum(i == 0 or own[i][2] != own[i - 1][2] for i in range(len(own)))


def test_many_turns(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"t{i}") for i in range(3000)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    r = out.select(chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.size(chat.read_turns(F.col("formatted"))).alias("n")).first()
    assert r.n == 3000 and r.loss == "".join(f"t{i}" for i in range(0, 3000, 3))


def test_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0

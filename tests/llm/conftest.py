import pytest

#: Texts that every operator has to take.
ODD = [None, "", " \n\t ", "a", "x" * 50_000, "word " * 20_000, "é" * 300, "\x00", "\n" * 500, "same text here", "same text here"]


#: Names that operators give to columns of their own, in results and on the way.
CLASHES = [
    "id", "th", "fp", "lo", "head", "base", "component", "hash", "pos", "width", "form", "item", "item_id", "item_ids", "words", "m", "failed", "w", "l", "ids", "decoded", "n_tokens",
    "ids_sha256", "decoded_sha256", "predicted", "held_out", "n_lines", "n_deleted", "h", "g", "rank", "ranks", "depth", "value", "kind", "pattern", "row", "word", "info", "set", "first",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, empty and very long texts, ties, repeated rows and clashing extra columns."""
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else "s", None if i % 5 == 0 else len(t or "")) for i, t in enumerate(ODD)]
    rows += [(None, "no id", "en", "s", 5), (None, None, None, None, None), (3, "a", "en", "s", 1), (3, "other", "en", "s", 5)]
    rows = [(*r, 1, 2.0, "z", *["clash"] * len(CLASHES)) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, quality double, spans string, " + ", ".join(f"{c} string" for c in CLASHES))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

import pytest
from pyspark.sql import functions as F


@pytest.fixture
def make_docs(spark):
    """A documents table from (doc_id, text[, lang[, source]]) rows, with extra columns whose names operators use."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        extra = ("_k1", "_k2", "fp", "n", "id", "size", "score", "kept", "n_words", "lines", "words", "h", "at", "w", "key", "start", "_row", "_text")
        return df.withColumns({c: F.lit("x") for c in extra})

    return make


ODD = [
    (1, None), (2, ""), (3, " \t\n "), (None, "a row without an id that has a few words in it"), (4, None, None, None),
    (5, "word " * 3000), (6, "Same text, twice over and over again, in one table."), (6, "Same text, twice over and over again, in one table."),
    (7, "Same text, twice over and over again, in one table."), (8, "x" * 20000), (9, "Ünïcödé — 日本語 текст \x00 <|endoftext|> ½"), (None, None),
]


@pytest.fixture
def odd(make_docs):
    """Nulls, blanks, repeated rows, ties, long texts, odd characters."""
    return make_docs(ODD)


@pytest.fixture
def empty(make_docs):
    return make_docs(ODD).filter("false")

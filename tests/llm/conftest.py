import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, size string, kept string, key string"
#: Null in every column, no words, blanks alone, a repeated row, ties, a long text, other scripts, names that operators use themselves.
ODD = [
    (1, None, None, None, None, None, "x", None, "k"),
    (2, "", "en", "a", 0, 1, None, "y", None),
    (3, " \t\n", "en", "a", 3, 1, "x", "y", "k"),
    (4, "one two three", "en", "b", 1, 1, "x", "y", "k"),
    (5, "one  two\nthree", "en", "b", 1, 1, "x", "y", "k"),
    (5, "one  two\nthree", "en", "b", 1, 1, "x", "y", "k"),
    (None, "onetwothree", "en", None, 1, 1, "x", "y", "k"),
    (7, "a b c d e f g h " * 20_000, "en", "b", 1, 1, "x", "y", "k"),
    (8, "é ü 漢字 🙂🙂 İ ſ K", "fr", "c", 1, 1, "x", "y", "k"),
    (9, "é ü 漢字 🙂🙂 İ ſ K ", "fr", "c", 1, 1, "x", "y", "k"),
    (10, "text with <|endoftext|> inside  and runs \n  of blanks   x", "en", "c", 1, 1, "x", "y", "k"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]

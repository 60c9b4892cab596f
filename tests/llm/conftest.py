import pytest

#: What every operator must take: nulls, empties, repeats, ties, a long text, blanks of all kinds.
LONG = "Ab cd. " * 30_000
ODD = [(1, None, None), (2, "", "en"), (3, " \t\n ", "en"), (4, "one", "en"), (5, "One  two\tthree", None), (5, "One  two\tthree", None),
       (6, "one two three", "en"), (7, LONG, "en"), (None, "one two three", "en"), (None, None, None), (8, "été <|endoftext|> naïve\x00", "fr")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, body string, word string, row long, `keys` string"


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with columns that have names the operators use inside."""
    return spark.createDataFrame([(i, t, k, "s", 0, 9, "b", "w", 1, "k") for i, t, k in ODD], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")

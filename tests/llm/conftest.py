import pytest

LONG = " ".join(f"w{i % 997}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with the operators' own."""
    rows = [
        (1, None, "x", 1), (2, "", "x", 1), (3, "  \n ", "x", 1), (4, LONG, "x", 1), (5, "one two three", "x", 1), (5, "one two three", "x", 1),
        (6, "ONE two  three", None, 1), (None, "one two three four five six", "x", 1), (7, "🙂 é\x00 token=abcdefgh\n漢字", "x", 1), (8, "one two three", "x", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").withColumnsRenamed({"score": "n_tokens"})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n_tokens int")


@pytest.fixture(scope="session")
def some_docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]

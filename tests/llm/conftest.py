import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 3000 + "a" * 70_000 + " é漢😀 " * 500
SAME = "this line is shared by several documents of the corpus\nand so is this second line of some length"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    return [
        (1, SAME, "en", "a", 5),
        (2, SAME, None, "a", None),
        (2, SAME, None, "a", None),
        (3, None, "en", None, 0),
        (4, "", "en", "b", 0),
        (None, SAME, "en", "b", 0),
        (None, None, None, None, None),
        (5, LONG, "en", "c", len(LONG)),
        (6, LONG + " end", "en", "c", len(LONG)),
        (7, "\n\n \t\n", "en", "d", 5),
        (8, "one", "en", "d", 3),
        (9, SAME.upper(), "en", "d", 3),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["_key", "row", "n", "at", "hash", "position", "keep", "n_lines", "n_dropped", "fingerprint", "component", "block", "label", "words", "part", "length", "piece", "spans", "entities", "kept", "item", "removed", "marks", "_marks", "_kept", "_made", "_moved", "_keep", "_row", "_text_key", "first", "path", "task", "text_hash", "copies", "node", "key", "choice", "bytes", "form"]
    return odd.select("*", *[F.lit("clash").alias(c) for c in names])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some_documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

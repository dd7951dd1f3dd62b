import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Whole small test tables; the driver gives them.
SMALL = "/root/testdata/sf0.001"

LONG = "thetion of ingthe " * 3000


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows, odd characters."""
    return [
        (1, "The cat sat on the mat and the dog ran off", "en", "a", 42),
        (2, "The cat sat on the mat and the dog ran off", None, None, None),
        (2, "The cat sat on the mat and the dog ran off", None, None, None),
        (3, None, "en", "a", None),
        (4, "", "de", None, 0),
        (None, "der hund und die katze", "de", "b", 22),
        (5, LONG, "en", "b", len(LONG)),
        (6, LONG + "end", None, "b", len(LONG) + 3),
        (7, "12 34 --", "fr", "c", 8),
        (8, "  ▁ été\tnaïve\n\n中文 😀 \x01x y  ", "fr", "c", 20),
        (9, "word", "en", "c", 4),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents of (doc_id, text) pairs."""

    def docs(rows, schema=SCHEMA):
        return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], schema)

    return docs


@pytest.fixture
def odd(spark):
    """Nulls in every column, blanks, a very long text, repeated rows and ids, and clashing column names."""
    long = " ".join(f"w{i % 997} the" for i in range(60_000))
    rows = [
        (1, "the cat sat on the mat and the dog ran", "en", "a", 38),
        (1, "the cat sat on the mat and the dog ran", "en", "a", 38),
        (1, "another text under the same id", None, None, None),
        (2, None, None, None, None),
        (3, "", "fr", "b", 0),
        (4, " \n\t ", "fr", "b", 4),
        (None, "a text without an id", "en", "a", 20),
        (None, None, None, None, None),
        (5, long, "en", "a", len(long)),
        (6, "é", "fr", "b", 1),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    names = ["fp", "version", "key", "part", "row", "id", "starts", "lines", "at", "y", "score", "fold", "n", "place", "first", "nth", "_id", "h1", "stay", "filled", "a.b"]
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)

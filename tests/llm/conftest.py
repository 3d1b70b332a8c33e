import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from conftest_llm import prose  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank and very long texts, repeated rows, ties, and columns that clash."""
    long = prose(1, 60_000)
    rows = [
        (1, prose(2, 80), "en", "a", 10), (2, prose(3, 80), "en", None, None), (3, None, None, "b", 0), (4, "", "de", "b", 5), (5, "  \n\t ", "", "", -1), (6, long, "en", "a", len(long)),
        (7, prose(2, 80), "en", "a", 10), (1, prose(2, 80), "en", "a", 10), (None, prose(4, 50), "fr", "c", 3), (None, None, None, None, None), (8, "héllo ∑ 漢字 \U0001f600 !!", "x", "a", 1), (9, "one two", "x", "a", 1), (10, "one two", "x", "a", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("score", "size", "rep", "leaf", "best", "_label", "_id", "x", "tie", "bucket", "copies", "keep", "skey", "q", "key"):
        df = df.selectExpr("*", f"'clash' AS {c}")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (6, 1, 0), (1, 1, 0), (4, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")

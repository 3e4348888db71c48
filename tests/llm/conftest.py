from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def tables(spark):
    from siftlake.llm.queries import table

    return lambda name: table(spark, "/root/testdata/sf0.001", name)


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, very long and repeated texts, a null id, and columns whose names clash."""
    rows = [
        (1, None, None, None, "x"), (2, "", "en", "s", "x"), (3, " \n\t ", "en", "s", None), (4, "word", "en", "s", "x"), (5, "a b c d e f g h " * 40_000, None, "s", "x"),
        (6, "the same text again and again", "en", "s", "x"), (6, "the same text again and again", "en", "s", "x"), (None, "no id here", "en", "s", "x"), (7, "ÀÉ 中文 😀\x00", "fr", "s", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string").withColumn("_t", __import__("pyspark").sql.functions.lit(1))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)

"""Long texts go to Python few at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from siftlake.plans.bindings import Views


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    try:
        Views(spark, "")

        @F.pandas_udf("int")
        def rows_of_batch(s: pd.Series) -> pd.Series:
            return pd.Series([len(s)] * len(s))

        texts = spark.range(300, numPartitions=1).select(F.concat(F.repeat(F.lit("\u00e9"), 50_000), F.col("id").cast("string")).alias("t"))
        assert texts.select(rows_of_batch("t").alias("n")).agg(F.max("n")).first()[0] <= 21
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)

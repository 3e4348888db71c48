"""Versioned tables: commits that come again, break off, touch few buckets, or leave a bucket empty."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from siftlake.operators import merge
from siftlake.operators.versions import Versions

SCHEMA = "id long, post_id long, model_version string"


@pytest.fixture
def table(spark):
    return Versions(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t", SCHEMA, ["post_id", "model_version"], buckets=8)


def added(old, new):
    return old.unionByName(merge.new_detections(old, new, [F.asc("id")]).select(*old.columns))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_commits(spark, table):
    df = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert table.numbers() == [] and rows(table.read()) == []
    many = [(k, k, "q") for k in range(100, 120)]
    first, second = df((1, 1, "a"), *many), df((3, 1, "a"), (4, 3, "b"), (5, 3, "b"))
    assert table.commit(first, 0, added) and table.commit(second, 1, added)
    assert rows(table.read()) == [(1, 1, "a"), (4, 3, "b"), *many]
    assert not table.commit(second, 1, added) and not table.commit(second, 0, added)  # a batch that comes again
    assert rows(table.read(0)) == [(1, 1, "a"), *many]  # older versions stay readable
    again = Versions(spark, table.path, SCHEMA, table.keys, buckets=8)  # a new process
    assert rows(again.read()) == rows(table.read()) and again.numbers() == [0, 1]
    untouched = set(table.record(0).items()) & set(table.record(1).items())
    assert untouched and all(n == 0 for _, n in untouched)  # buckets the second batch did not touch were not written
    assert table.commit(df(), 2, added) and rows(table.read()) == rows(table.read(1))


def test_a_commit_that_broke_off_is_not_seen(spark, table):
    df = spark.createDataFrame([(1, 1, "a")], SCHEMA)
    table.commit(df, 0, added)

    def broken(old, new):
        new.withColumn("bucket", table.bucket_of()).write.partitionBy("bucket").parquet(f"{table.path}/data/v=1")  # files, but no record
        raise RuntimeError("lost")

    more = spark.createDataFrame([(9, 9, "z")], SCHEMA)
    with pytest.raises(RuntimeError):
        table.commit(more, 1, broken)
    assert rows(table.read()) == [(1, 1, "a")] and table.numbers() == [0]
    os.makedirs(f"{table.path}/commits/_2-draft")  # a record that was not finished
    assert table.numbers() == [0]
    assert table.commit(more, 1, added) and rows(table.read()) == [(1, 1, "a"), (9, 9, "z")]


def test_buckets_that_become_empty_and_old_files(spark, table):
    df = spark.createDataFrame([(k, k, "a") for k in range(30)], SCHEMA)
    table.commit(df, 0, added)
    table.commit(df.where("id < 25"), 1, lambda old, new: old.join(new.select("id"), "id", "left_anti"))
    assert [r[0] for r in rows(table.read())] == [25, 26, 27, 28, 29]
    table.commit(df.where("id < 3"), 2, added)
    before = rows(table.read())
    assert table.forget(keep=1) > 0 and table.numbers() == [2] and rows(table.read()) == before
    with pytest.raises(ValueError):  # rows that belong to buckets the batch does not touch
        table.commit(df.where("id = 0"), 3, lambda old, new: df)
    assert rows(table.read()) == before

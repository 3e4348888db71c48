"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of an Arrow batch: narrow rows come by the thousand, long texts few at a time.
BATCH_BYTES = 2_000_000


def session(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches small enough for long texts: a setting of the whole session, as Spark has no other."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where it is unset and the master is local (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not where:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage (a lost executor costs no recomputation of what came before), gives Spark
    true sizes in place of estimates, and lets several consumers read one result.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of the documents that no model may learn from: crc32(id as text) mod 5 = 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def texts_of(column: pa.Array) -> Iterator[str]:
    """The strings of an Arrow column one at a time; null counts as empty."""
    for value in column:
        yield value.as_py() or ""


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str) -> DataFrame:
    """``mapInArrow`` with state: ``make()`` runs once per task and returns a function batch -> columns.

    ``schema`` is a DDL string; the returned columns are converted to its Arrow types.
    """
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            made = step(batch)
            if made is not None:
                yield pa.RecordBatch.from_arrays(
                    [v if isinstance(v, pa.Array) and v.type == f.type else pa.array(v, f.type) for f, v in ((f, made[f.name]) for f in arrow)],
                    schema=arrow,
                )

    return df.mapInArrow(run, schema)

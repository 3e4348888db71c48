"""A table kept as versions: rows in hash buckets, and a record for each commit that says which files of which bucket hold.

    path/data/v=<number>/bucket=<b>/   rows of a bucket as commit <number> left them
    path/commits/<number>/             the record: bucket and the number that last wrote it

A commit reads and rewrites only the buckets its batch touches, and writes its record last, in one rename. Readers take the
newest record and the files it names, so they see a commit whole or not at all; what a broken-off commit left is written over.
Numbers are those of a stream's batches: one that is committed already is passed over, so a batch may come again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Old rows and the batch's rows of the touched buckets -> the buckets' new rows.
Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass
class Versions:
    """``keys``: a row's bucket is a hash of these; rows of one key meet in one bucket. The number of buckets is fixed for a table."""

    spark: SparkSession
    path: str
    schema: str | StructType
    keys: list[str]
    buckets: int = 64
    _fs: object = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.schema = StructType.fromDDL(self.schema) if isinstance(self.schema, str) else self.schema
        self._fs = self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, part: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}".rstrip("/"))

    def bucket_of(self, columns: list[str | Column] | None = None) -> Column:
        return F.pmod(F.xxhash64(*(columns or self.keys)), F.lit(self.buckets)).cast("int")

    def numbers(self) -> list[int]:
        """Numbers of all commits, in order."""
        where = self._at("commits")
        if not self._fs.exists(where):
            return []
        return sorted(int(n) for n in (s.getPath().getName() for s in self._fs.listStatus(where)) if n.lstrip("-").isdigit())

    def record(self, number: int) -> dict[int, int]:
        """Bucket -> the commit whose files hold it. At most ``buckets`` rows."""
        rows = self.spark.read.schema("bucket int, number long").parquet(f"{self.path}/commits/{number}").collect()
        return {r["bucket"]: r["number"] for r in rows}

    def _rows(self, record: dict[int, int], some: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/v={n}/bucket={b}" for b, n in sorted(record.items()) if some is None or b in some]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, number: int | None = None) -> DataFrame:
        """Rows as of a commit, the newest if none is given; no commit gives no rows."""
        numbers = self.numbers()
        if not numbers:
            return self.spark.createDataFrame([], self.schema)
        return self._rows(self.record(numbers[-1] if number is None else number))

    def commit(self, batch: DataFrame, number: int, merge: Merge) -> bool:
        """Merge ``batch`` in as commit ``number``; False if that is committed already.

        ``batch`` must have the key columns. One writer at a time, as a stream has.
        """
        numbers = self.numbers()
        if numbers and numbers[-1] >= number:
            return False
        record = self.record(numbers[-1]) if numbers else {}
        touched = {r[0] for r in batch.select(self.bucket_of()).distinct().collect()}  # at most ``buckets`` rows
        new = merge(self._rows(record, touched), batch).select(*self.schema.names).withColumn("bucket", self.bucket_of())
        where = f"{self.path}/data/v={number}"
        if touched:
            new.repartition(F.col("bucket"), F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets * 8))).write.mode("overwrite").partitionBy("bucket").parquet(where)
            written = {int(s.getPath().getName().split("=")[1]) for s in self._fs.listStatus(self._at(f"data/v={number}")) if s.isDirectory() and s.getPath().getName().startswith("bucket=")}
            if not written <= touched:
                raise ValueError("a merge gave rows of buckets that its batch does not touch")
            record = {b: n for b, n in record.items() if b not in touched} | dict.fromkeys(written, number)
        draft = f"commits/_{number}-{uuid.uuid4().hex}"
        self.spark.createDataFrame(sorted(record.items()), "bucket int, number long").coalesce(1).write.parquet(f"{self.path}/{draft}")
        if not self._fs.rename(self._at(draft), self._at(f"commits/{number}")):
            raise RuntimeError(f"commit {number} could not be recorded")
        return True

    def forget(self, keep: int = 1) -> int:
        """Delete all commits but the newest ``keep``, and files that none of those names; how many folders of a bucket went."""
        numbers = self.numbers()
        kept = numbers[-keep:]
        named = {(n, b) for number in kept for b, n in self.record(number).items()}
        for number in numbers[:-keep]:
            self._fs.delete(self._at(f"commits/{number}"), True)
        gone = 0
        if not self._fs.exists(self._at("data")):
            return gone
        for version in self._fs.listStatus(self._at("data")):
            n = int(version.getPath().getName().split("=")[1])
            for bucket in self._fs.listStatus(version.getPath()) if n <= (kept[-1] if kept else -1) else ():
                name = bucket.getPath().getName()
                if name.startswith("bucket=") and (n, int(name.split("=")[1])) not in named:
                    self._fs.delete(bucket.getPath(), True)
                    gone += 1
        return gone

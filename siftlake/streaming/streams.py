"""Streaming forms. Each takes a streaming (or batch) DataFrame and returns one, or a started query."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from siftlake.functions.text import content_hash
from siftlake.operators import rules
from siftlake.sources.io import with_event


def ingest(raw: DataFrame, good_path: str, corrupt_path: str, checkpoint: str, column: str = "raw") -> StreamingQuery:
    """Decode messages; good ones and corrupt ones go to folders of their own, each batch once (by batch number)."""

    def write(batch: DataFrame, number: int) -> None:
        marked = with_event(batch, column).persist()
        marked.where(~F.col("is_corrupt")).select("event.*").write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        marked.where("is_corrupt").select(column).write.mode("overwrite").parquet(f"{corrupt_path}/batch={number}")
        marked.unpersist()

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_urls(df: DataFrame, at: str = "ts", url: str = "url", ttl: str = "7 days") -> DataFrame:
    """First event of each address within ``ttl``. The time counts from the row's event time against the watermark:
    an address is let through again at the earliest ``ttl`` after its first event, and late rows may pass."""
    return df.withWatermark(at, ttl).dropDuplicatesWithinWatermark([url])


def dedup_bodies(df: DataFrame, body: str = "body", at: str | None = None, ttl: str | None = None) -> DataFrame:
    """First event of each body hash. Without ``ttl`` the state keeps every hash for ever (8 + 64 bytes each)."""
    df = df.withColumn("body_hash", content_hash(F.col(body)))
    if at and ttl:
        return df.withWatermark(at, ttl).dropDuplicatesWithinWatermark(["body_hash"])
    return df.dropDuplicates(["body_hash"])


def enrich(events: DataFrame, tiers: dict[str, str] | None = None) -> DataFrame:
    """Events to detection rows: tier and illegality of their type; a map expression, no join."""
    tier = rules.tier_of(F.col("type"), tiers) if tiers else rules.tier_of(F.col("type"))
    return events.withColumn("tier", tier).withColumn("is_illegal", rules.is_illegal(F.col("tier")))


def merge_batches(df: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a batch merge for each micro-batch. ``merge`` gets the batch number: it must skip one it has done."""
    return df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(df: DataFrame, at: str = "ts", lateness: str = "1 day") -> DataFrame:
    w = df.withWatermark(at, lateness).groupBy(F.window(at, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").cast("date").alias("day"), "n")


def latest_runs(df: DataFrame, key: str = "site_name", at: str = "ts") -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("r")).select(key, "r.*")


def daily_spend(df: DataFrame, day: str, micro: str, cap: int) -> DataFrame:
    """Spend of each day so far and whether the cap (0: none) is reached."""
    made = df.groupBy(day).agg(F.sum(micro).alias("spent"))
    return made.withColumn("held", (F.lit(cap) > 0) & (F.col("spent") >= cap))


def match_alerts(detections: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """Detections of a stream against an index of rules, of any number, as they are when the stream starts: a join with a static table."""
    return rules.match_rules(detections, rule_rows)


def depths(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("depth"))


class RetryMachine(StatefulProcessor):
    """Posts that are queued, claimed or dead letters. A claim not acknowledged in time goes back into the queue, after ``most`` such tries it is a dead letter.

    Time runs from a claim; a post that waits in the queue has no timer. Rows: ``post_id``, ``event`` (claimed, acked). Out: ``post_id``,
    ``action`` (requeue, dead_letter). By processing time; ``ordered.queue_machine`` replays a log by event time.
    """

    def __init__(self, timeout_ms: int = 300_000, most: int = 3) -> None:
        self.timeout_ms, self.most = timeout_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tries = handle.getValueState("tries", "n int")

    def _clear_timers(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  names fixed by Spark
        now = timerValues.getCurrentProcessingTimeInMs()
        for pdf in rows:
            for event in pdf["event"]:
                self._clear_timers()
                if event == "acked":
                    self.tries.clear()
                elif event == "claimed":
                    self.handle.registerTimer(now + self.timeout_ms)
        yield pd.DataFrame({"post_id": [], "action": []}, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        tries = self.tries.get()[0] if self.tries.exists() else 0
        if tries >= self.most:
            self.tries.clear()
            action = "dead_letter"
        else:
            self.tries.update((tries + 1,))
            action = "requeue"
        yield pd.DataFrame({"post_id": [key[0]], "action": [action]})

    def close(self) -> None:
        pass


def retries(events: DataFrame, timeout_ms: int = 300_000, most: int = 3) -> DataFrame:
    """Requeue and dead-letter actions of a stream of claims; needs the RocksDB state store."""
    return events.groupBy("post_id").transformWithStateInPandas(
        statefulProcessor=RetryMachine(timeout_ms, most), outputStructType="post_id string, action string", outputMode="Update", timeMode="ProcessingTime"
    )

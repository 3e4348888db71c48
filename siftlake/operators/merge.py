"""Merges: each takes the old state and a batch and returns the new state. Running one twice changes nothing more.

Built-in Parquet tables have no MERGE, so the caller writes the returned state as a new version and
switches to it; a path that is being read is never overwritten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.operators.selection import first_per_key


def upsert_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """By ``site_name``: a board name stays once it is set; the base address too."""
    new = new.groupBy("site_name").agg(F.min("board_name").alias("board_name"), F.min("base_url").alias("base_url"))
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, "site_name", "full").select(
        "site_name", F.coalesce("o.board_name", "n.board_name").alias("board_name"), F.coalesce("o.base_url", "n.base_url").alias("base_url")
    )


POST_KEY = ["site_name", "post_id_at_source"]


def upsert_posts(old: DataFrame, new: DataFrame, order: str = "ord") -> DataFrame:
    """By site and post id: body and language from the last update, the newest address given, ``crawled_at`` of the first.

    Several updates of a post in one batch are folded in ``order`` first.
    """
    folded = new.groupBy(*POST_KEY).agg(
        F.max_by("body", order).alias("body"),
        F.max_by("language", order).alias("language"),
        F.max_by("post_url", F.when(F.col("post_url").isNotNull(), F.col(order))).alias("post_url"),
        F.min_by("crawled_at", order).alias("crawled_at"),
    )
    o, n = old.alias("o"), folded.alias("n")
    fresh = F.col("n.crawled_at").isNotNull()
    return o.join(n, POST_KEY, "full").select(
        *POST_KEY,
        F.when(fresh, F.col("n.body")).otherwise(F.col("o.body")).alias("body"),
        F.when(fresh, F.col("n.language")).otherwise(F.col("o.language")).alias("language"),
        F.coalesce("o.crawled_at", "n.crawled_at").alias("crawled_at"),
        F.coalesce("n.post_url", "o.post_url").alias("post_url"),
    )


DETECTION_KEY = ["post_id", "model_version"]


def new_detections(old: DataFrame, batch: DataFrame, order: list[Column]) -> DataFrame:
    """Rows of the batch to insert: keys not in ``old``, the first row of each key."""
    return first_per_key(batch, DETECTION_KEY, order).join(old.select(*DETECTION_KEY), DETECTION_KEY, "left_anti")


def outbox_rows(inserted: DataFrame) -> DataFrame:
    """An event for each detection just inserted."""
    return inserted.select(F.lit("DETECTION_CREATED").alias("event_type"), F.col("id").alias("detection_id"), F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"))


def trace_rows(traces: DataFrame, inserted: DataFrame) -> DataFrame:
    """Traces of detections just inserted; those of refused ones are dropped."""
    return traces.join(inserted.select(*DETECTION_KEY), DETECTION_KEY, "left_semi")


def update_labels(detections: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Detections with the labels of ``updates`` (post_id, model_version, label, at, source), and the matched keys."""
    last = updates.groupBy(*DETECTION_KEY).agg(F.max_by(F.struct("label", "at", "source"), F.struct("at", "label")).alias("_u"))
    joined = detections.join(last, DETECTION_KEY, "left")
    sets = {"human_label": "label", "human_verified_at": "at", "label_source": "source"}
    made = joined.withColumns({c: F.when(F.col("_u").isNotNull(), F.col(f"_u.{f}")).otherwise(F.col(c)) for c, f in sets.items()}).drop("_u")
    return made.select(*detections.columns), detections.select(*DETECTION_KEY).join(last, DETECTION_KEY, "left_semi")


def sweep_orphans(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Jobs still running or queued become failed; ``swept`` marks them."""
    open_ = F.col("status").isin("running", "queued")
    return jobs.withColumn("swept", open_).withColumn("finished_at", F.when(open_, as_of).otherwise(F.col("finished_at"))).withColumn(
        "status", F.when(open_, "failed").otherwise(F.col("status"))
    )


def fold_updates(updates: DataFrame, key: str, fields: list[str], order: Column) -> DataFrame:
    """Last value written of each field by key; null writes nothing."""
    return updates.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields])


def outbox_outcome(events: DataFrame, attempts: DataFrame, most_attempts: int = 3) -> DataFrame:
    """``events`` (event_id, is_illegal, n_rules, attempts) with ``outcome`` and ``last_error`` from delivery attempts."""
    sent = attempts.groupBy("event_id").agg(
        F.bool_or(F.col("status") == "SUCCESS").alias("_ok"),
        F.max_by("error_message", F.when(F.col("status") != "SUCCESS", F.struct("attempted_at", "error_message"))).alias("_e"),
    )
    outcome = (
        F.when(~F.coalesce("is_illegal", F.lit(False)) | (F.coalesce("n_rules", F.lit(0)) == 0), "SKIPPED")
        .when(F.coalesce("_ok", F.lit(False)), "COMPLETED")
        .when(F.col("attempts") >= most_attempts, "FAILED")
        .otherwise("PENDING")
    )
    made = events.join(sent, "event_id", "left").withColumn("outcome", outcome)
    return made.withColumn("last_error", F.when(F.col("outcome").isin("FAILED", "PENDING"), F.col("_e"))).drop("_ok", "_e")


def delivery_log(matches: DataFrame, results: DataFrame) -> DataFrame:
    """A row for each event and rule with the outcome of its sending; without a result it failed."""
    ok = F.coalesce(F.col("response_code").between(200, 299), F.lit(False))
    return matches.join(results, ["event_id", "rule_id"], "left").select(
        "event_id", "rule_id", F.when(ok, "SUCCESS").otherwise("FAILED").alias("status"), "response_code"
    )


def claim(outbox: DataFrame, chosen: DataFrame, as_of: Column) -> DataFrame:
    """The outbox with the chosen events in work: one attempt more, error cleared, claim time set."""
    mark = chosen.select("id").distinct().withColumn("_c", F.lit(True))
    hit = F.coalesce("_c", F.lit(False))
    return (
        outbox.join(mark, "id", "left")
        .withColumn("attempts", F.col("attempts") + hit.cast("int"))
        .withColumn("status", F.when(hit, "PROCESSING").otherwise(F.col("status")))
        .withColumn("last_error", F.when(~hit, F.col("last_error")))
        .withColumn("claimed_at", F.when(hit, as_of).otherwise(F.col("claimed_at")))
        .drop("_c")
    )


def retry_schedule(attempts: DataFrame, *, retries: int = 3, base_s: float = 1.0) -> DataFrame:
    """State of each post from its attempt log: acked, dead_letter, or the delay before the next attempt.

    ``attempts``: post_id, at, event (acked, failed_transient, failed_permanent). Delay: base * 2^(failures - 1).
    """
    w = attempts.groupBy("post_id").agg(
        F.bool_or(F.col("event") == "acked").alias("_ok"),
        F.bool_or(F.col("event") == "failed_permanent").alias("_hard"),
        F.count_if(F.col("event") == "failed_transient").alias("failures"),
        F.max("at").alias("last_at"),
    )
    state = F.when(F.col("_ok"), "acked").when(F.col("_hard") | (F.col("failures") > retries), "dead_letter").otherwise("retry")
    made = w.withColumn("state", state)
    return made.withColumn("delay_s", F.when(F.col("state") == "retry", base_s * F.pow(F.lit(2.0), F.col("failures") - 1))).drop("_ok", "_hard")


def drawn(tokens: float, last: float | None, now: float | None, capacity: float, refill: float) -> tuple[float, float | None, bool, float]:
    """A request at ``now``: tokens left, time of the last refill, whether it is admitted, and how long to wait for a token if not."""
    if now is not None:
        if last is not None:
            tokens = min(capacity, tokens + (now - last) * refill)
        last = now
    admitted = tokens >= 1
    return tokens - admitted, last, admitted, 0.0 if admitted else (1 - tokens) / refill


def token_bucket(requests: DataFrame, *, key: str = "key", at: str = "at", tie: str, capacity: float = 60.0, refill: float = 1.0) -> DataFrame:
    """``key``, ``at``, ``tie``, ``admitted`` and ``wait_s``: an ordered fold of each key's requests, by time and then ``tie``.

    The bucket before a request is full unless drained; only admitted requests drain it. Rows are dealt by key and sorted
    (Spark spills what does not fit); a task carries two numbers from request to request, whatever the key's size.
    Requests of one key are one ordered stream by nature, and so one task's work. A null time is an error in the data and
    comes first.
    """
    kinds = dict(requests.dtypes)
    schema = f"{key} {kinds[key]}, {at} {kinds[at]}, {tie} {kinds[tie]}, admitted boolean, wait_s double"
    dealt = requests.select(key, at, tie, F.unix_micros(F.col(at).cast("timestamp")).alias("_us")).repartition(key).sortWithinPartitions(key, at, tie)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tokens, last = object(), capacity, None
        for batch in batches:
            admitted, waits = [], []
            for name, us in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if name != own:
                    own, tokens, last = name, capacity, None
                tokens, last, good, wait = drawn(tokens, last, us / 1e6 if us is not None else None, capacity, refill)
                admitted.append(good)
                waits.append(wait)
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(admitted, pa.bool_()), pa.array(waits, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, at, tie, "admitted", "wait_s"])

    return dealt.mapInArrow(fold, schema)


def with_reused_evidence(links: DataFrame, evidence: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """``links`` with the latest evidence of their address that is at most ``days`` old; ``to_fetch`` where there is none."""
    fresh = evidence.where(F.col("fetched_at") >= as_of - F.make_dt_interval(F.lit(days)))
    last = fresh.groupBy("url").agg(F.max_by("evidence", F.struct("fetched_at", "evidence")).alias("evidence"))
    made = links.join(last, "url", "left")
    return made.withColumn("to_fetch", F.col("evidence").isNull())



"""Streaming queries, drained over a whole table and compared with their batch meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.operators import merge, rules, versions
from siftlake.plans.bindings import TIERS, Views
from siftlake.plans.queries_stats import COST, RULES_SQL, rule_rows
from siftlake.plans.registry import query
from siftlake.session import scratch
from siftlake.streaming import streams


def source(v: Views, name: str) -> DataFrame:
    """A table as a stream of its files. The pattern lets the table be one file or a folder of files."""
    path = f"{v.sf_dir}/{name}.parquet*"
    return v.spark.readStream.schema(v.table(name).schema).parquet(path)


def events(v: Views) -> DataFrame:
    return source(v, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(v: Views, df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all there is; append mode gives all rows, complete mode those of the last batch, update mode each key's last."""
    at = scratch(v.spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
    got = v.spark.read.parquet(f"{at}/out")
    if mode == "update":  # rows of a key, its first column
        key, *rest = [c for c in got.columns if c != "batch"]
        return got.groupBy(key).agg(*[F.max_by(c, "batch").alias(c) for c in rest])
    if mode == "complete":
        got = got.where(F.col("batch") == got.agg(F.max("batch")).first()[0])
    return got.drop("batch")


@query("k01_s02_stream_ingest", "SELECT count(*) FILTER (doc_id % 3 <> 0) AS good, count(*) FILTER (doc_id % 3 = 0) AS corrupt FROM documents")
def ingest(v: Views) -> DataFrame:
    d = source(v, "documents")
    fields = [F.col("doc_id").cast("string").alias("post_id"), F.col("source").alias("source_id"), F.col("source").alias("site_name"), F.col("text").alias("raw_text"), F.col("lang").alias("language"), F.lit("x").alias("detected_at"), F.lit("c").alias("correlation_id")]
    raw = d.select(F.when(F.col("doc_id") % 3 == 0, F.lit("{")).otherwise(F.to_json(F.struct(*fields))).alias("raw"))
    at = scratch(v.spark, "ingest")
    streams.ingest(raw, f"{at}/good", f"{at}/bad", f"{at}/cp").awaitTermination()
    both = v.spark.read.parquet(f"{at}/good").select(F.lit(1).alias("g")).unionAll(v.spark.read.parquet(f"{at}/bad").select(F.lit(0).alias("g")))
    return both.agg(F.count_if(F.col("g") == 1).alias("good"), F.count_if(F.col("g") == 0).alias("corrupt"))


@query("k02_stream_url_dedup", "SELECT DISTINCT user_id AS url FROM events")
def url_dedup(v: Views) -> DataFrame:
    return drained(v, streams.dedup_urls(events(v).select(F.col("user_id").alias("url"), "ts"), ttl="60 days").select("url"), "append")


@query("k03_stream_body_dedup", "SELECT DISTINCT sha256(text) AS body_hash FROM documents")
def body_dedup(v: Views) -> DataFrame:
    return drained(v, streams.dedup_bodies(source(v, "documents"), body="text").select("body_hash"), "append")


@query("k04_stream_enrich", "SELECT tier, is_illegal, count(*) AS n FROM detections GROUP BY ALL", "detections")
def enrich(v: Views) -> DataFrame:
    rows = streams.enrich(events(v).withColumnRenamed("event_type", "type"), TIERS).select("tier", "is_illegal")
    return drained(v, rows, "append").groupBy("tier", "is_illegal").agg(F.count(F.lit(1)).alias("n"))


@query("k04_stream_cost", f"SELECT model, count(*) AS n, round(sum({COST}), 6) AS cost_usd FROM usage GROUP BY model", "usage")
def costs(v: Views) -> DataFrame:
    """Calls of a stream priced by a join with a static table."""
    calls = source(v, "lineitem").select(
        F.concat(F.lit("m"), (F.col("l_partkey") % 5).cast("string")).alias("model"), (F.col("l_quantity") * 100).cast("bigint").alias("input_tokens"), (F.col("l_linenumber") * 10).cast("bigint").alias("output_tokens")
    )
    priced = drained(v, rules.token_cost(calls, v.prices, "base"), "append")
    return priced.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


@query("k05_stream_merge", """SELECT post_id, model_version, count(*) AS n FROM (SELECT DISTINCT event_id % 300 AS post_id, 'v' || (user_id % 3) AS model_version FROM events) GROUP BY ALL""")
def merging(v: Views) -> DataFrame:
    """The stream is stopped after its first batch of files and started again, and one of its batches is given to the table twice."""
    at = scratch(v.spark, "merge")
    rows = v.table("events").select(F.col("event_id").alias("id"), (F.col("event_id") % 300).alias("post_id"), F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("model_version"))
    state = versions.Versions(v.spark, f"{at}/state", rows.schema, ["post_id", "model_version"], buckets=16)
    added = lambda old, new: old.unionByName(merge.new_detections(old, new, [F.asc("id")]).select(*old.columns))
    for half in (0, 1):
        rows.where(F.pmod(F.xxhash64("id"), F.lit(2)) == half).write.mode("append").parquet(f"{at}/in")
        stream = v.spark.readStream.schema(rows.schema).parquet(f"{at}/in")
        streams.merge_batches(stream, lambda batch, number: state.commit(batch, number, added), f"{at}/cp").awaitTermination()
    assert not state.commit(rows, state.numbers()[0], added)
    return state.read().groupBy("post_id", "model_version").agg(F.count(F.lit(1)).alias("n"))


@query("k06_stream_daily_counts", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def daily(v: Views) -> DataFrame:
    return drained(v, streams.daily_counts(events(v)), "complete")


@query("k06_stream_daily_updates", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def daily_updates(v: Views) -> DataFrame:
    """In update mode only days that a batch changed come out; the last word on each day holds."""
    return drained(v, streams.daily_counts(events(v)), "update")


@query("k07_stream_latest", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest(v: Views) -> DataFrame:
    return drained(v, streams.latest_runs(events(v).select("user_id", "event_id", "event_type"), key="user_id", at="event_id"), "complete")


@query("k11_stream_daily_spend", "SELECT CAST(l_shipdate AS DATE) AS day, CAST(sum(l_linenumber * 10) AS BIGINT) AS spent, sum(l_linenumber * 10) >= 100 AS held FROM lineitem GROUP BY 1")
def spend(v: Views) -> DataFrame:
    rows = source(v, "lineitem").select(F.to_date("l_shipdate").alias("day"), (F.col("l_linenumber") * 10).cast("bigint").alias("micro"))
    return drained(v, streams.daily_spend(rows, "day", "micro", 100), "complete")


@query("k12_stream_alerts", f"""SELECT CAST(r.id AS BIGINT) AS rule_id, count(*) AS n FROM detections d JOIN {RULES_SQL} ON (r.min_confidence IS NULL OR d.confidence >= r.min_confidence) AND (trim(coalesce(r.min_tier, '')) = '' OR d.tier <= r.min_tier)
    AND (trim(coalesce(r.detection_type, '')) = '' OR d.type = r.detection_type) AND (trim(coalesce(r.source_site_name, '')) = '' OR 'src' || (d.user_id % 5) = r.source_site_name) GROUP BY 1""", "detections")
def alerts(v: Views) -> DataFrame:
    rows = streams.enrich(events(v).withColumnRenamed("event_type", "type").withColumn("confidence", F.least(F.col("value") / 100, F.lit(1.0))), TIERS)
    found = streams.match_alerts(rows.withColumn("id", F.col("event_id")).withColumn("site_name", F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string"))), rule_rows(v))
    return drained(v, found, "append").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("k13_stream_depths", "SELECT event_type AS status, count(*) AS depth FROM events GROUP BY 1")
def depths(v: Views) -> DataFrame:
    return drained(v, streams.depths(events(v).withColumnRenamed("event_type", "status")), "complete")

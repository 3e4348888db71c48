"""Streams that fold events in order, fed late and in several micro-batches, stopped and started again in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.plans.bindings import Views
from siftlake.plans.registry import query
from siftlake.session import scratch
from siftlake.streaming import ordered

#: Rows come up to so many seconds late; a stream is stopped after so many batches of arrivals and started again.
LATE_S, BATCHES = 2 * 86_400, 3


def arrivals(v: Views, rows: DataFrame, at: str, end: dict) -> tuple[DataFrame, Callable[[int], None]]:
    """``rows`` as a stream of files, and a function that lets the files of a batch arrive.

    A row arrives up to ``LATE_S`` after its time, by a hash of itself. The last batch is a row of the values ``end`` an age later, which
    lets the watermark pass all others.
    """
    where = scratch(v.spark, "arrivals")
    kinds = dict(rows.dtypes)
    seconds = F.unix_seconds(F.col(at).cast("timestamp"))
    arrival = seconds + F.pmod(F.xxhash64(*rows.columns), F.lit(LATE_S))
    first, last = rows.agg(F.min(seconds), F.max(seconds)).first()
    width = ((last or 0) + LATE_S - (first or 0)) // BATCHES + 1
    rows.withColumn("batch", F.floor((arrival - F.lit(first or 0)) / width).cast("int")).write.partitionBy("batch").parquet(f"{where}/all")

    def arrive(batch: int) -> None:
        if batch < BATCHES:
            some = v.spark.read.schema(rows.schema).parquet(f"{where}/all/batch=[{batch}]")
        else:
            some = v.spark.range(1).select(*[(F.timestamp_seconds(F.lit((last or 0) + 100 * LATE_S)) if c == at else F.lit(end.get(c))).cast(kinds[c]).alias(c) for c in rows.columns])
        some.write.mode("append").parquet(f"{where}/in")

    arrive(BATCHES + 1)  # a stream's folder must be there
    v.spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{where}/in")
    return v.spark.readStream.schema(rows.schema).parquet(f"{where}/in"), arrive


def replayed(v: Views, rows: DataFrame, at: str, end: dict, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All that ``made`` puts out while batch after batch of ``rows`` arrives, the stream being stopped after each."""
    where, spark = scratch(v.spark, "ordered"), v.spark
    stream, arrive = arrivals(v, rows, at, end)
    wanted = ordered.settings(spark.sparkContext.defaultParallelism)
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, x in wanted.items():
        spark.conf.set(k, x)
    try:
        out = made(stream)
        for batch in range(BATCHES + 1):
            arrive(batch)
            out.writeStream.outputMode("append").format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/cp").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, x in before.items():
            spark.conf.set(k, x) if x is not None else spark.conf.unset(k)
    return spark.read.schema(out.schema).parquet(f"{where}/out")


LATE = f"{LATE_S + 86_400} seconds"
BUCKET_MS = 6 * 3_600_000

BUCKET_SQL = """WITH RECURSIVE r AS (SELECT event_type AS key, event_id, epoch_us(ts) / 1e6 AS now, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT key, event_id, n, now, CAST(4 AS DOUBLE) AS tokens, true AS admitted, CAST(0 AS DOUBLE) AS wait FROM r WHERE n = 1
    UNION ALL SELECT key, event_id, n, now, t - (t >= 1)::INT, t >= 1, CASE WHEN t >= 1 THEN 0 ELSE (1 - t) * 600 END FROM (SELECT r.*, least(5, f.tokens + (r.now - f.now) / 600) AS t FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1))
    SELECT key, event_id, admitted, round(wait, 3) AS wait_s FROM f"""


@query("k10_stream_token_bucket", BUCKET_SQL)
def token_bucket(v: Views) -> DataFrame:
    rows = v.table("events").select(F.col("event_type").alias("key"), F.col("ts").alias("at"), "event_id")
    got = replayed(v, rows, "at", {"key": "end"}, lambda df: ordered.token_bucket(df, tie="event_id", capacity=5.0, refill=1 / 600, late=LATE, bucket_ms=BUCKET_MS))
    return got.where(F.col("key") != "end").select("key", "event_id", "admitted", F.round("wait_s", 3).alias("wait_s"))


@query("k11_stream_spend_cap", """WITH c AS (SELECT CAST(ts AS DATE) AS day, ts, event_id, CAST(round(value * 1000) AS BIGINT) AS micro FROM events),
    s AS (SELECT day, ts, event_id, CAST(coalesce(sum(micro) OVER w, 0) AS BIGINT) AS before, CAST(sum(micro) OVER w2 AS BIGINT) AS after FROM c
        WINDOW w AS (PARTITION BY day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w2 AS (PARTITION BY day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
    b AS (SELECT day, min(ts) AS first_breach FROM s WHERE after >= 1500000 GROUP BY day)
    SELECT day, event_id, before AS spent_before, before < 1500000 AS admitted, CASE WHEN before >= 1500000 THEN epoch_us(first_breach) END AS breached_us FROM s LEFT JOIN b USING (day)""")
def spend_cap(v: Views) -> DataFrame:
    rows = v.table("events").select(F.to_date("ts").alias("day"), F.col("ts").alias("at"), "event_id", F.round(F.col("value") * 1000).cast("long").alias("micro"))
    got = replayed(v, rows, "at", {"event_id": -1}, lambda df: ordered.spend_cap(df, day="day", at="at", tie="event_id", micro="micro", cap=1_500_000, late=LATE, bucket_ms=BUCKET_MS))
    return got.where(F.col("event_id") >= 0).select("day", "event_id", "spent_before", "admitted", "breached_us")


TTL_S = 7 * 86_400


@query("k02_stream_exact_ttl", f"""WITH RECURSIVE e AS (SELECT user_id AS url, epoch_us(ts) AS us FROM events),
    h AS (SELECT user_id AS url, min(epoch_us(ts)) - 3 * 86400000000 AS us FROM events WHERE user_id % 3 = 0 GROUP BY 1),
    p AS (SELECT url, us, true AS old FROM h UNION ALL
        SELECT url, us, false FROM (SELECT e.url, min(e.us) AS us FROM e WHERE e.url NOT IN (SELECT url FROM h) GROUP BY 1)
        UNION ALL SELECT p.url, (SELECT min(e.us) FROM e WHERE e.url = p.url AND e.us >= p.us + {TTL_S}000000), false FROM p WHERE p.us IS NOT NULL)
    SELECT url, us FROM p WHERE us IS NOT NULL AND NOT old""")
def exact_ttl(v: Views) -> DataFrame:
    """A third of the addresses were let through before the stream began, as the stored history says."""
    events = v.table("events").select(F.col("user_id").alias("url"), F.col("ts").alias("at"))
    us = F.unix_micros(F.col("at").cast("timestamp"))
    history = events.where(F.col("url") % 3 == 0).groupBy("url").agg((F.min(us) - F.lit(3 * 86_400_000_000)).alias("first_us"))
    got = replayed(v, events, "at", {"url": -1}, lambda df: ordered.first_of_ttl(df, url="url", at="at", ttl_us=TTL_S * 1_000_000, late=LATE, history=history, bucket_ms=BUCKET_MS))
    return got.where(F.col("url") >= 0)


@query("k08_queue_machine", """WITH RECURSIVE r AS (
        SELECT user_id AS post_id, epoch_us(ts) AS us, CASE WHEN event_type IN ('click', 'error', 'view') THEN 'claimed' WHEN event_type = 'signup' THEN 'acked' ELSE 'queued' END AS event,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
        UNION ALL SELECT user_id, NULL, 'end', count(*) + 1 FROM events GROUP BY user_id),
    f AS (SELECT DISTINCT post_id, CAST(0 AS BIGINT) AS n, '' AS status, 0 AS tries, CAST(0 AS BIGINT) AS since, CAST(NULL AS BIGINT) AS us, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS INT) AS count FROM r
        UNION ALL SELECT post_id, n,
            CASE WHEN event = 'claimed' THEN 'claimed' WHEN event = 'acked' THEN CASE WHEN status = 'queued' THEN 'queued' ELSE '' END WHEN event = 'queued' AND status IN ('', 'dead') THEN 'queued' ELSE status END,
            CASE WHEN event = 'acked' OR event = 'queued' AND status IN ('', 'dead') THEN 0 ELSE tries END,
            CASE WHEN event = 'claimed' THEN now ELSE since END, due, CASE WHEN due IS NOT NULL THEN action END, count
        FROM (SELECT r.post_id, r.n, r.event, r.us AS now, f.since,
                CASE WHEN f.status = 'claimed' AND (r.us IS NULL OR f.since + 21600000000 <= r.us) THEN f.since + 21600000000 END AS due,
                CASE WHEN f.tries >= 2 THEN 'dead_letter' ELSE 'requeue' END AS action,
                CASE WHEN f.status = 'claimed' AND (r.us IS NULL OR f.since + 21600000000 <= r.us) THEN CASE WHEN f.tries >= 2 THEN f.tries ELSE f.tries + 1 END END AS count,
                CASE WHEN f.status = 'claimed' AND (r.us IS NULL OR f.since + 21600000000 <= r.us) THEN CASE WHEN f.tries >= 2 THEN 'dead' ELSE 'queued' END ELSE f.status END AS status,
                CASE WHEN f.status = 'claimed' AND (r.us IS NULL OR f.since + 21600000000 <= r.us) THEN CASE WHEN f.tries >= 2 THEN 0 ELSE f.tries + 1 END ELSE f.tries END AS tries
            FROM f JOIN r ON r.post_id = f.post_id AND r.n = f.n + 1))
    SELECT post_id, us, action, count AS tries FROM f WHERE action IS NOT NULL""")
def queue_machine(v: Views) -> DataFrame:
    """A post for each user: clicks, errors and views claim it, signups acknowledge it, purchases queue it. Six hours to a claim, two tries."""
    kinds = F.when(F.col("event_type").isin("click", "error", "view"), "claimed").when(F.col("event_type") == "signup", "acked").otherwise("queued")
    log = v.table("events").select(F.col("user_id").alias("post_id"), F.col("ts").alias("at"), kinds.alias("event"), "event_id")
    made = lambda df: ordered.queue_machine(df, tie="event_id", timeout_us=21_600_000_000, most=2, late=LATE, bucket_ms=BUCKET_MS)
    return replayed(v, log, "at", {"post_id": -1, "event": "acked"}, made).where(F.col("post_id") >= 0)

"""Filters of histories, quantiles without a task per group, sketches, late rows of a stream."""

from __future__ import annotations

import datetime as dt
import random
import tempfile

import numpy as np
from pyspark.sql import functions as F

from siftlake.operators import dedup, reports, selection
from siftlake.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def test_history_filter_holds_all_of_it_and_little_else(spark, monkeypatch):
    history = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("body_hash"))
    new = spark.range(2500, 12_500).select("id", F.sha2(F.col("id").cast("string"), 256).alias("_k"))
    for most in (1 << 27, 1 << 15):  # sized by the count; too small for it, which lets more through
        monkeypatch.setattr(dedup, "MOST_BITS", most)
        got = dedup.maybe_in(new, "_k", dedup.history_filter(history)).groupBy("_maybe", (F.col("id") < 5000).alias("known")).count().collect()
        n = {(r.known, r["_maybe"]): r["count"] for r in got}
        assert n[True, True] == 2500 and (True, False) not in n
        assert n[False, True] < 0.03 * 7500 if most > 1 << 15 else (False, False) in n
    assert dedup.maybe_in(new, "_k", dedup.history_filter(history.limit(0))).where("_maybe").count() == 0


def test_only_possible_hits_are_joined_with_the_history(spark):
    rows = spark.createDataFrame([(k, f"body {k % 700}") for k in range(1000)], "arrival long, body string").unionAll(spark.createDataFrame([(5000, " "), (5001, None)], "arrival long, body string"))
    history = spark.range(650, 90_000, 5).select(F.sha2(F.concat(F.lit("body "), F.col("id").cast("string")), 256).alias("body_hash"))
    got = dedup.body_duplicates(rows, history)
    known = {f"body {k}" for k in range(650, 700, 5)}
    assert {r.arrival for r in got.where("duplicate").collect()} == {k for k in range(1000) if k >= 700 or f"body {k % 700}" in known}
    assert got.count() == 1002
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_maybe" in plan and plan.count("Filter") >= 2


def test_quantiles_of_windows_by_interpolation(spark):
    rng = random.Random(2)
    rows = [(T0 + dt.timedelta(seconds=rng.randint(0, 3000)), rng.choice([None, 1.0, 2.5, rng.random() * 100])) for _ in range(2000)] + [(T0 + dt.timedelta(hours=5), None)]
    got = {r.window_start: r for r in reports.window_p95(spark.createDataFrame(rows, "ts timestamp, v double"), "ts", "v").collect()}
    groups = {}
    for at, v in rows:
        start = at.replace(minute=at.minute // 5 * 5, second=0)
        groups.setdefault(start, []).extend([] if v is None else [v])
    assert set(got) == set(groups)
    for start, values in groups.items():
        assert got[start].n == len(values) and (got[start].p95 is None if not values else abs(got[start].p95 - np.quantile(values, 0.95)) < 1e-9)


def test_sketches_roll_up_within_their_bound(spark):
    rng = random.Random(3)
    values = [(T0 + dt.timedelta(seconds=rng.randint(0, 7199)), rng.lognormvariate(3, 1)) for _ in range(30_000)] + [(T0, None)]
    five = reports.latency_sketches(spark.createDataFrame(values, "ts timestamp, v double"), "ts", "v")
    assert five.count() == 24
    for r in reports.sketched_quantiles(five, "1 hour", (0.5, 0.95, 0.99)).collect():
        own = np.sort([v for at, v in values if v is not None and at.hour == r.window_start.hour])
        assert r.n == len(own)
        for c, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            assert abs(np.searchsorted(own, r[c]) / len(own) - q) < 0.01


def test_ranges_are_a_binary_search(spark):
    df = spark.createDataFrame([(None,), *[(float(k),) for k in range(1000)]], "x double")
    got = df.select("x", selection.ranges_of(df, "x").alias("r")).collect()
    ordered = [r.r for r in sorted(got, key=lambda r: (r.x is not None, r.x))]
    assert ordered == sorted(ordered) and ordered[0] == 0 and len(set(ordered)) > 50
    assert spark.range(0).select(F.col("id").cast("double").alias("x")).transform(lambda d: d.select(selection.ranges_of(d, "x"))).count() == 0


def test_late_rows_of_daily_counts(spark):
    """Rows later than the lateness change no count; those within it do."""
    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    out = []
    for batch in ([T0, T0 + dt.timedelta(hours=1), T0 + dt.timedelta(days=1)], [T0 + dt.timedelta(days=5)], [T0 + dt.timedelta(hours=3), T0 + dt.timedelta(days=4, hours=12)]):
        spark.createDataFrame([(t,) for t in batch], "ts timestamp").coalesce(1).write.mode("append").parquet(f"{at}/in")
        counts = streams.daily_counts(spark.readStream.schema("ts timestamp").parquet(f"{at}/in"))
        q = counts.writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend((n, r.day.day, r.n) for r in df.collect())).option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    last = {}
    for n, day, count in sorted(out):
        last[day] = count
    assert last == {1: 2, 2: 1, 6: 1, 5: 1}

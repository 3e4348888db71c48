"""Merges, events and streams on literal rows."""

from __future__ import annotations

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from siftlake.operators import dedup, merge, reports, rules, selection
from siftlake.sources import io
from siftlake.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_posts_merge_twice_is_once(spark):
    s = "site_name string, post_id_at_source string, body string, language string, crawled_at timestamp, post_url string"
    old = spark.createDataFrame([("a", "1", "old", "ko", T0, "u"), ("a", "2", "keep", "ko", T0, None)], s)
    new = spark.createDataFrame([("a", "1", "n1", "en", T0 + dt.timedelta(1), None, 1), ("a", "1", "n2", "en", T0 + dt.timedelta(2), None, 2), ("b", "9", "x", "en", T0, "v", 1)], s + ", ord long")
    once = merge.upsert_posts(old, new)
    got = {r.post_id_at_source: r for r in once.collect()}
    assert got["1"].body == "n2" and got["1"].post_url == "u" and got["1"].crawled_at == T0 and got["2"].body == "keep" and got["9"].post_url == "v"
    assert rows(merge.upsert_posts(once, new)) == rows(once)
    empty = spark.createDataFrame([], s)
    assert rows(merge.upsert_posts(empty, new.limit(0))) == []


def test_insert_ignore(spark):
    s = "id long, post_id long, model_version string"
    old = spark.createDataFrame([(1, 1, "v1")], s)
    batch = spark.createDataFrame([(5, 1, "v1"), (6, 1, "v2"), (7, 1, "v2")], s)
    fresh = merge.new_detections(old, batch, [F.asc("id")])
    assert [r.id for r in fresh.collect()] == [6]
    assert rows(merge.new_detections(old.unionByName(fresh), batch, [F.asc("id")])) == []
    traces = spark.createDataFrame([(1, "v1", "t"), (1, "v2", "t")], "post_id long, model_version string, stage string")
    assert merge.trace_rows(traces, fresh).count() == 1 and merge.outbox_rows(fresh).first().detection_id == 6


def test_two_verdicts(spark):
    s = "post_id long, type string, confidence double, reason string, translated_text string, image_observed boolean, input_tokens int, output_tokens int, cost_usd double"
    text = spark.createDataFrame([(1, "a", 0.5, "r", "t", False, 1, 2, 0.1), (2, "a", 0.5, "r", None, False, 1, 2, 0.1)], s)
    image = spark.createDataFrame([(1, "b", 0.9, "i", "z", True, 3, 4, 0.2), (2, "b", 0.9, "i", "z", False, 3, 4, 0.2)], s)
    got = {r.post_id: r for r in rules.merge_verdicts(text, image).collect()}
    assert (got[1].type, got[1].translated_text, got[1].input_tokens) == ("b", "t", 4) and (got[2].type, got[2].translated_text) == ("a", "z")


def test_enabled_rules_and_ranges(spark):
    df = spark.createDataFrame([(2, True, "E", True, T0), (1, True, "E", True, T0), (3, False, "E", True, T0), (4, True, "X", True, T0)], "id long, enabled boolean, event_type string, channel_enabled boolean, created_at timestamp")
    assert [r.id for r in rules.enabled_rules(df, "E").collect()] == [1, 2]
    assert rules.range_days("7d") == 7
    for bad in ("0d", "366d", "x", "7"):
        with pytest.raises(ValueError):
            rules.range_days(bad)


def test_error_classes_and_labels(spark):
    df = spark.createDataFrame([("Cloudflare JS challenge",), ("HTTP 403 with HTML content",), ("Timeout 30s",), (None,)], "e string")
    assert [r[0] for r in df.select(rules.fetch_error_class(F.col("e"))).collect()] == ["cloudflare_js_challenge", "cloudflare_or_waf_403_html", "timeout", "other"]
    labels = spark.createDataFrame([("기타",), ("unknown",), ("nope",), (None,)], "human_label string")
    assert rules.valid_labels(labels).count() == 2


def test_evaluation_ratios(spark):
    data = [(True, True)] * 15 + [(False, False)] * 14 + [(False, True)]
    got = reports.binary_quality(spark.createDataFrame(data, "t boolean, p boolean"), F.col("t"), F.col("p")).first()
    assert (got.recall, round(got.specificity, 4)) == (1.0, round(14 / 15, 4))
    assert reports.binary_quality(spark.createDataFrame([], "t boolean, p boolean"), F.col("t"), F.col("p")).first().recall is None


def test_latency_index(spark):
    got = reports.latency_summary(spark.createDataFrame([(i,) for i in range(1, 21)], "v0 int"), "v0").first()
    assert (got.n, got.median, got.p95, got.maximum) == (20, 10, 20, 20)


def test_budget_ties(spark):
    df = spark.createDataFrame([("b", "u1", "P3", 5, True, [1]), ("b", "u2", "P3", 5, True, [1, 2]), ("b", "u3", "P0", 90, False, [0]), ("b", "u4", "P3", 9, False, [9])], "board_url string, url string, priority_bucket string, score int, keyword_matched boolean, numeric_key array<long>")
    got = [(r.url, r.selection_rank) for r in selection.priority_budget(df, cap=2, limit=50).orderBy("selection_rank").collect()]
    assert got == [("u3", 1), ("u1", 2), ("u2", 3)]


def test_first_seen_never_refreshed(spark):
    s = "url string, first_seen timestamp"
    got = dedup.first_seen(spark.createDataFrame([("a", T0 + dt.timedelta(5))], s), spark.createDataFrame([("a", T0), ("b", T0)], s))
    assert rows(got) == [("a", T0 + dt.timedelta(5)), ("b", T0)]


def test_evidence_reuse(spark):
    links = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    ev = spark.createDataFrame([("a", "x", T0), ("b", "y", T0 - dt.timedelta(8))], "url string, evidence string, fetched_at timestamp")
    got = {r.url: (r.evidence, r.to_fetch) for r in merge.with_reused_evidence(links, ev, F.lit(T0 + dt.timedelta(1))).collect()}
    assert got == {"a": ("x", False), "b": (None, True), "c": (None, True)}


def test_token_bucket(spark):
    df = spark.createDataFrame([("k", T0, n) for n in range(3)] + [("k", T0 + dt.timedelta(seconds=1), 3), (None, T0, 4)], "key string, at timestamp, n int")
    rows = {r.n: r for r in merge.token_bucket(df, tie="n", capacity=2.0, refill=1.0).collect()}
    assert rows[4].admitted and [rows[n].admitted for n in range(4)] == [True, True, False, True]
    got = [(r.at, r.admitted, r.wait_s) for n, r in rows.items() if n < 4]
    assert [g[1] for g in got].count(True) == 3 and max(g[2] for g in got) == 1.0


GOOD = '{"post_id":"1","source_id":"s","site_name":"s","raw_text":"t","language":"ko","detected_at":"x","correlation_id":"c"%s}'


def test_event_decode(spark):
    raw = [GOOD % "", GOOD % ',"image_urls":["a"]', GOOD % ',"nope":1', '{"post_id":"1"}', GOOD % ',"image_urls":"a"', GOOD % ',"s3_text_path":["x"]', "no json", None]
    good, bad = io.decode_events(spark.createDataFrame([(r,) for r in raw], "raw string"))
    assert good.count() == 2 and bad.count() == 6
    assert [r.image_urls for r in good.collect()] == [[], ["a"]]


def test_files(spark):
    at = folder()
    df = spark.createDataFrame([("a", "1", "text", T0), ("a", "../x", "text", T0), ("a", "2", " ", T0)], "site_name string, post_id string, body string, crawled_at timestamp")
    assert [r.post_id for r in io.write_archive(df, f"{at}/arc").collect()] == ["../x"]
    assert spark.read.json(f"{at}/arc").count() == 1
    io.write_corpus(spark.createDataFrame([("g", "x"), (None, "y")], "game_key string, text string"), f"{at}/c")
    io.write_corpus(spark.createDataFrame([("h", "x")], "game_key string, text string"), f"{at}/c")
    assert [r.game_key for r in spark.read.json(f"{at}/c").collect()] == ["h"]
    with open(f"{at}/l.csv", "w") as f:
        f.write('post_id,text,label,type\n1,"a ""q""\nb",clean,\n')
    assert io.read_labels(spark, f"{at}/l.csv").first().text == 'a "q"\nb'
    with open(f"{at}/x.jsonl", "w") as f:
        f.write('{"a": 1}\n\n{"a": "x"}\n')
    with pytest.raises(Exception, match=r'x\.jsonl: \{"a": "x"\}'):  # noqa: B017  the file and the line
        io.read_jsonl(spark, f"{at}/x.jsonl", "a int").collect()
    with open(f"{at}/y.jsonl", "w") as f:
        f.write('{"a": 1, "more": 2}\n  \n{"a": null}\n{}\n')
    assert [r.a for r in io.read_jsonl(spark, f"{at}/y.jsonl", "a int").collect()] == [1, None, None]


def test_repo_document_and_events(spark):
    s = "full_name string, html_url string, description string, topics array<string>, stargazers_count int, language string, readme string, release struct<body:string,assets:array<struct<name:string>>>"
    got = io.assemble_repo_document(spark.createDataFrame([("o/r", None, None, ["x", "y"], None, None, "R", (None, [("f.zip",)]))], s)).first()
    assert got.post_id == "o__r" and "Topics: x, y" in got.body and "- f.zip" in got.body and "Description: (none)" in got.body
    posts = spark.createDataFrame(
        [("s", "https://x/a/1/", "", "raw", None, "c", [("i.png",)]), ("nga", "https://x/read.php?tid=5", "fit", "raw", None, "c", None)],
        "site_id string, post_url string, fit_text string, raw_body string, language string, correlation_id string, images array<struct<src:string>>",
    )
    sites = spark.createDataFrame([("nga", "NGA")], "site_id string, name string")
    good, bad = io.decode_events(io.to_events(posts, F.lit(T0), sites))
    got = {r.source_id: r for r in good.collect()}
    assert bad.count() == 0 and got["s"].raw_text == "raw" and got["s"].language == "ko" and got["s"].image_urls == ["i.png"] and got["nga"].image_urls == []
    assert [(got[k].post_id, got[k].site_name) for k in ("s", "nga")] == [("1", "s"), ("5", "NGA")]


# ---- streams against their batch twins


def stream_of(spark, df):
    at = folder()
    df.repartition(2).write.parquet(at + "/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at + "/in")


def drained(df, mode, spark):
    name = f"q{abs(hash(folder()))}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", folder()).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streams(spark):
    events = spark.createDataFrame([(f"u{i % 3}", f"s{i % 2}", T0 + dt.timedelta(hours=i), "click" if i % 2 else "error") for i in range(12)], "url string, site_name string, ts timestamp, type string")
    one = drained(streams.dedup_urls(stream_of(spark, events)), "append", spark)
    assert sorted(r.url for r in one.collect()) == ["u0", "u1", "u2"]
    bodies = drained(streams.dedup_bodies(stream_of(spark, events), body="url"), "append", spark)
    assert bodies.count() == 3
    latest = drained(streams.latest_runs(stream_of(spark, events)), "complete", spark)
    assert {r.site_name: r.ts.hour for r in latest.collect()} == {"s0": 10, "s1": 11}
    days = drained(streams.daily_counts(stream_of(spark, events)), "complete", spark)
    assert [r.n for r in days.collect()] == [12]
    rich = drained(streams.enrich(stream_of(spark, events), {"error": "T1"}), "append", spark)
    assert rich.where("is_illegal").count() == 6
    depth = drained(streams.depths(stream_of(spark, events.withColumn("status", F.col("type")))), "complete", spark)
    assert {r.status: r.depth for r in depth.collect()} == {"click": 6, "error": 6}
    spend = drained(streams.daily_spend(stream_of(spark, events.select(F.to_date("ts").alias("day"), F.lit(2).alias("micro"))), "day", "micro", 20), "complete", spark)
    assert (spend.first().spent, spend.first().held) == (24, True)
    rule = spark.createDataFrame([(1, None, "T1", None, None)], "id long, min_confidence double, min_tier string, detection_type string, source_site_name string")
    found = streams.match_alerts(streams.enrich(stream_of(spark, events), {"error": "T1"}).withColumn("id", F.xxhash64("ts")).withColumn("confidence", F.lit(1.0)), rule)
    assert drained(found, "append", spark).count() == 6


def test_ingest_and_merge(spark):
    at = folder()
    raw = spark.createDataFrame([(GOOD % "",), ("bad",)], "raw string")
    streams.ingest(stream_of(spark, raw), f"{at}/good", f"{at}/bad", f"{at}/cp").awaitTermination()
    assert spark.read.parquet(f"{at}/good").count() == 1 and spark.read.parquet(f"{at}/bad").count() == 1
    seen = []
    streams.merge_batches(stream_of(spark, raw), lambda df, n: seen.append((n, df.count())), f"{at}/cp2").awaitTermination()
    assert sum(n for _, n in seen) == 2


def test_retries(spark):
    """p1 is claimed once: given out again, then it waits. p2 is claimed again after that: a dead letter. p3 is acknowledged."""
    import time

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = folder()
    put = lambda *r: spark.createDataFrame(list(r), "post_id string, event string").coalesce(1).write.mode("append").parquet(f"{at}/in")
    put(("p1", "claimed"), ("p2", "claimed"), ("p3", "claimed"), ("p3", "acked"))
    source = spark.readStream.schema("post_id string, event string").parquet(f"{at}/in")
    q = streams.retries(source, timeout_ms=1000, most=1).writeStream.format("memory").queryName("k8").outputMode("update").option("checkpointLocation", f"{at}/cp").trigger(processingTime="1 second").start()
    seen = lambda: {(r.post_id, r.action) for r in spark.table("k8").collect()}
    try:
        end = time.time() + 90
        while time.time() < end and len(seen()) < 2:
            time.sleep(1)
        assert seen() == {("p1", "requeue"), ("p2", "requeue")}
        put(("p2", "claimed"))
        while time.time() < end and len(seen()) < 3:
            time.sleep(1)
        time.sleep(5)
        assert seen() == {("p1", "requeue"), ("p2", "requeue"), ("p2", "dead_letter")}
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")

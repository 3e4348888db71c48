"""Queries on detections, their statistics, alerts, merges and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.functions import text as X
from siftlake.operators import merge, reports, rules, selection
from siftlake.plans.bindings import AS_OF, Views
from siftlake.plans.registry import query
from siftlake.session import stored

DAY = "TIMESTAMP '2024-01-30 00:00:00'"


@query("a01_today_delta", f"""SELECT CAST(count(*) FILTER (CAST(detected_at AS DATE) = DATE '{AS_OF}') AS BIGINT) AS today,
    CAST(count(*) FILTER (CAST(detected_at AS DATE) = DATE '{AS_OF}') - count(*) FILTER (CAST(detected_at AS DATE) = DATE '{AS_OF}' - 1) AS BIGINT) AS delta
    FROM good""", "posts detections star good")
def today(v: Views) -> DataFrame:
    return reports.today_and_delta(reports.qualified(v.detections), AS_OF)


@query("a02_type_distribution", """SELECT type, count(*) AS n FROM good
    WHERE detected_at >= TIMESTAMP '2024-01-24' AND detected_at < TIMESTAMP '2024-01-31' AND type IS NOT NULL GROUP BY type""", "posts detections star good")
def by_type(v: Views) -> DataFrame:
    return reports.distribution(reports.last_days(reports.qualified(v.detections), AS_OF, 7), "type")


@query("a03_site_distribution", "SELECT site_name, count(*) AS n FROM good GROUP BY site_name", "posts detections star good")
def by_site(v: Views) -> DataFrame:
    return reports.distribution(reports.qualified(v.star), "site_name")


@query("a04_language_distribution", "SELECT language, count(*) AS n FROM good GROUP BY language", "posts detections star good")
def by_language(v: Views) -> DataFrame:
    return reports.distribution(reports.qualified(v.star), "language")


@query("a05_distributions", """SELECT 'type' AS dimension, type AS value, count(*) AS n FROM good GROUP BY type
    UNION ALL SELECT 'site_name', site_name, count(*) FROM good GROUP BY site_name UNION ALL SELECT 'language', language, count(*) FROM good GROUP BY language""", "posts detections star good")
def all_distributions(v: Views) -> DataFrame:
    return reports.distributions(reports.qualified(v.star), ["type", "site_name", "language"])


@query("a06_daily_trend", f"""SELECT CAST(c.day AS DATE) AS day, count(g.id) AS n FROM (SELECT unnest(generate_series(DATE '{AS_OF}' - 39, DATE '{AS_OF}', INTERVAL 1 DAY)) AS day) c
    LEFT JOIN good g ON CAST(g.detected_at AS DATE) = CAST(c.day AS DATE) GROUP BY 1""", "posts detections star good")
def trend(v: Views) -> DataFrame:
    return reports.daily_trend(reports.qualified(v.detections), AS_OF, 40)


RUNS = """SELECT 'run:' || site_name AS run_key, CASE WHEN k % 2 = 0 THEN '' ELSE site_name END AS site_name, max_at AS last_checked_at, fetched, failed FROM (
    SELECT CASE WHEN user_id % 23 > 19 THEN 'extra' || (user_id % 23) ELSE 'src' || (user_id % 23) END AS site_name, user_id % 23 AS k, max(ts) AS max_at, count(*) AS fetched,
    count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY ALL)"""


@query("a07_source_health", f"""SELECT coalesce(s.site_name, r.site_name) AS site_name, s.last_ingest, r.last_checked_at, coalesce(r.fetched, 0) AS fetched, coalesce(r.failed, 0) AS failed
    FROM (SELECT site_name, max(crawled_at) AS last_ingest FROM posts GROUP BY site_name) s
    FULL JOIN (SELECT split_part(run_key, ':', 2) AS site_name, last_checked_at, fetched, failed FROM ({RUNS})) r ON s.site_name = r.site_name""", "posts")
def health(v: Views) -> DataFrame:
    k = F.col("user_id") % 23
    site = F.concat(F.when(k > 19, "extra").otherwise("src"), k.cast("string"))
    runs = v.table("events").groupBy(site.alias("s"), k.alias("k")).agg(
        F.max("ts").alias("last_checked_at"), F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("event_type") == "error").alias("failed")
    )
    runs = runs.select(F.concat(F.lit("run:"), F.col("s")).alias("run_key"), F.when(F.col("k") % 2 == 0, "").otherwise(F.col("s")).alias("site_name"), "last_checked_at", "fetched", "failed")
    return reports.source_health(v.posts.select("site_name").distinct(), v.posts, runs)


@query("a08_stats_weekly", """SELECT 'type' AS dimension, type AS value, count(*) AS n FROM good WHERE detected_at >= TIMESTAMP '2024-01-24' AND detected_at < TIMESTAMP '2024-01-31' GROUP BY type
    UNION ALL SELECT 'site_name', site_name, count(*) FROM good WHERE detected_at >= TIMESTAMP '2024-01-24' AND detected_at < TIMESTAMP '2024-01-31' GROUP BY site_name
    UNION ALL SELECT 'language', language, count(*) FROM good WHERE detected_at >= TIMESTAMP '2024-01-24' AND detected_at < TIMESTAMP '2024-01-31' GROUP BY language""", "posts detections star good")
def weekly(v: Views) -> DataFrame:
    runs = v.spark.createDataFrame([], "run_key string, site_name string, last_checked_at timestamp_ntz, fetched long")
    return reports.stats_bundle(v.star, v.posts.select("site_name").distinct(), v.posts, runs, AS_OF, "weekly")["distributions"]


GOOD_DAY = "(SELECT count(*) FROM good WHERE detected_at >= TIMESTAMP '2024-01-{0}' AND detected_at < TIMESTAMP '2024-01-{1}')"


@query("a08_stats_frames", f"""SELECT 'today' AS frame, 'today' AS name, {GOOD_DAY.format(30, 31)} AS n UNION ALL SELECT 'today', 'delta', {GOOD_DAY.format(30, 31)} - {GOOD_DAY.format(29, 30)}
    UNION ALL SELECT 'distributions', dimension || ':' || value, count(*) FROM (SELECT unnest(['type', 'site_name', 'language']) AS dimension, unnest([type, site_name, language]) AS value FROM good WHERE detected_at >= TIMESTAMP '2024-01-01' AND detected_at < TIMESTAMP '2024-01-31') GROUP BY dimension, value
    UNION ALL SELECT 'trend', CAST(day AS VARCHAR), (SELECT count(*) FROM good WHERE CAST(detected_at AS DATE) = day) FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day)
    UNION ALL SELECT 'sources', site_name, coalesce(max(fetched), 0) FROM (SELECT site_name, NULL AS fetched FROM posts UNION ALL SELECT 'src' || user_id, count(*) FROM events GROUP BY user_id) GROUP BY site_name""", "posts detections star good")
def frames(v: Views) -> DataFrame:
    """All four frames of the overview of a month; a run for each user."""
    runs = v.table("events").groupBy(F.concat(F.lit("run:src"), F.col("user_id").cast("string")).alias("run_key")).agg(F.max("ts").alias("last_checked_at"), F.count(F.lit(1)).alias("fetched"))
    got = reports.stats_bundle(v.star, v.posts.select("site_name").distinct(), v.posts, runs.withColumn("site_name", F.lit(" ")), AS_OF, "monthly")
    shown = lambda frame, name, n: got[frame].select(F.lit(frame).alias("frame"), name.cast("string").alias("name"), n.cast("long").alias("n"))
    today = got["today"].select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in ("today", "delta")])))
    return (
        today.select(F.lit("today").alias("frame"), "name", "n")
        .unionByName(shown("distributions", F.concat_ws(":", "dimension", "value"), F.col("n")))
        .unionByName(shown("trend", F.col("day"), F.col("n")))
        .unionByName(shown("sources", F.col("site_name"), F.col("fetched")))
    )


HOT = """SELECT type, site_name, count(*) AS n, round(max(confidence), 9) AS max_confidence, min(tier) AS top_tier FROM {src} WHERE is_illegal GROUP BY type, site_name
    ORDER BY top_tier, n DESC, max(confidence) DESC, site_name, type LIMIT 6"""


@query("a09_hotspots_recent", HOT.format(src="(SELECT * FROM star ORDER BY detected_at DESC, id DESC LIMIT 100)"), "posts detections star")
def hotspots_recent(v: Views) -> DataFrame:
    return reports.hotspots(v.star).withColumn("max_confidence", F.round("max_confidence", 9))


@query("a09_hotspots_all", HOT.format(src="star"), "posts detections star")
def hotspots_all(v: Views) -> DataFrame:
    return reports.hotspots(v.star, sample_rows=None).withColumn("max_confidence", F.round("max_confidence", 9))


@query("a14_latency", """SELECT count(*) AS n, CAST(floor(median(value)) AS BIGINT) AS median,
    (SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS c FROM events) WHERE r = least(c, CAST(floor(0.95 * c) AS BIGINT) + 1)) AS p95, max(value) AS maximum FROM events""")
def latency(v: Views) -> DataFrame:
    return reports.latency_summary(v.table("events"), "value")


@query("a14_latency_by_type", """SELECT event_type, count(*) AS n, CAST(floor(median(value)) AS BIGINT) AS median,
    max(value) FILTER (r = least(c, CAST(floor(0.95 * c) AS BIGINT) + 1)) AS p95, max(value) AS maximum
    FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS c FROM events) GROUP BY event_type""")
def latency_by_type(v: Views) -> DataFrame:
    return reports.latency_summary(v.table("events"), "value", ["event_type"])


@query("a16_depth", """SELECT s.status, count(e.event_id) AS depth FROM (VALUES ('pending'), ('processing'), ('dead_letter'), ('corrupt')) s(status)
    LEFT JOIN (SELECT event_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'dead_letter' ELSE 'done' END AS status FROM events) e USING (status) GROUP BY 1""")
def depth(v: Views) -> DataFrame:
    status = F.create_map(*[F.lit(x) for x in ("view", "pending", "click", "processing", "error", "dead_letter")])[F.col("event_type")]
    return reports.depth_by_status(v.table("events").select(F.coalesce(status, F.lit("done")).alias("status")))


@query("r18_depth_alerts", """SELECT 'dead_letter' AS status, count(*) AS depth FROM events WHERE event_type = 'error' HAVING count(*) > 0""")
def depth_alerts(v: Views) -> DataFrame:
    return rules.depth_alerts(depth(v))


@query("a17_window_p95", """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY 1""")
def window_p95(v: Views) -> DataFrame:
    return reports.window_p95(v.table("events"), "ts", "value").withColumn("p95", F.round("p95", 6))


@query("a14_a17_sketches", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, true AS p50_close, true AS p95_close FROM events GROUP BY 1""")
def sketches(v: Views) -> DataFrame:
    """Sketches of five minutes rolled up to hours; an estimate is close if its rank is within 2 % of the rows of its hour, or next to that."""
    rows = v.table("events").select(F.col("ts"), "value")
    hours = reports.sketched_quantiles(stored(reports.latency_sketches(rows, "ts", "value"), "sketches"), "1 hour")
    met = rows.withColumn("window_start", F.window("ts", "1 hour").start).join(hours.hint("merge"), "window_start")
    within = lambda c, q: (F.count_if(F.col("value") < F.col(c)) <= (q + 0.02) * F.col("n") + 1) & (F.count_if(F.col("value") <= F.col(c)) >= (q - 0.02) * F.col("n") - 1)
    return met.groupBy("window_start", "n").agg(within("p50", 0.5).alias("p50_close"), within("p95", 0.95).alias("p95_close"))


@query("r01_detection_filter", """SELECT id, post_id, type, tier, site_name, language, round(confidence, 9) AS confidence FROM star WHERE is_illegal AND confidence >= 0.7
    AND detected_at >= TIMESTAMP '2024-01-10' AND detected_at < TIMESTAMP '2024-01-20' AND tier = 'T2' AND language = 'en'""", "posts detections star")
def detection_filter(v: Views) -> DataFrame:
    since, until = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-10 00:00:00", "2024-01-20 00:00:00"))
    got = rules.detection_filter(v.star, since=since, until=until, tier="T2", language="en", site=" ")
    return got.select("id", "post_id", "type", "tier", "site_name", "language", F.round("confidence", 9).alias("confidence"))


@query("r06_verdict_check", """SELECT type, count(*) FILTER (ok) AS good, count(*) FILTER (NOT ok) AS bad FROM (SELECT event_type AS type, event_type <> 'view' AND value / 300 BETWEEN 0 AND 1 AS ok FROM events) GROUP BY type""")
def verdict_check(v: Views) -> DataFrame:
    rows = v.table("events").select(F.col("event_type").alias("type"), (F.col("value") / 300).alias("confidence"))
    good, bad = rules.split_verdicts(rows, ("error", "purchase", "click", "signup"))
    both = good.select("type", F.lit(1).alias("g")).unionAll(bad.select("type", F.lit(0).alias("g")))
    return both.groupBy("type").agg(F.count_if(F.col("g") == 1).alias("good"), F.count_if(F.col("g") == 0).alias("bad"))


@query("r07_r08_tiers", "SELECT type, tier, is_illegal, count(*) AS n FROM detections GROUP BY ALL", "detections")
def tiers(v: Views) -> DataFrame:
    from siftlake.plans.bindings import TIERS

    rows = v.table("events").select(F.col("event_type").alias("type"), rules.tier_of(F.col("event_type"), TIERS).alias("tier"))
    return rows.withColumn("is_illegal", rules.is_illegal(F.col("tier"))).groupBy("type", "tier", "is_illegal").agg(F.count(F.lit(1)).alias("n"))


@query("r09_display_threshold", """SELECT tier, count(*) AS n FROM detections WHERE confidence >= CASE tier WHEN 'T1' THEN 0.65 WHEN 'T2' THEN 0.75 WHEN 'T3' THEN 0.85 ELSE 0.90 END GROUP BY tier""", "detections")
def display_threshold(v: Views) -> DataFrame:
    return rules.shown(v.detections).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("r10_fast_path", """SELECT type, count(*) AS n FROM (SELECT *, event_type AS type FROM events) WHERE type = 'view' AND least(value / 100, 1.0) >= 0.8 AND user_id % 3 = 0 GROUP BY type""")
def fast_path(v: Views) -> DataFrame:
    kind = F.when(F.col("type") == "view", "기타").otherwise(F.col("type"))
    return v.detections.where(rules.fast_path(kind, F.col("confidence"), F.col("user_id") % 3)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


RULES = [(1, 0.9, None, None, None), (2, None, "T1", None, None), (3, 0.5, "T2", "purchase", None), (4, None, "", "", "src3"), (5, 0.95, "T3", " ", "src1")]
RULES_SQL = "(VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in RULES) + ") r(id, min_confidence, min_tier, detection_type, source_site_name)"


def rule_rows(v: Views) -> DataFrame:
    return v.spark.createDataFrame(RULES, "id long, min_confidence double, min_tier string, detection_type string, source_site_name string")


@query("r12_j04_rule_match", f"""SELECT CAST(r.id AS BIGINT) AS rule_id, count(*) AS n, CAST(sum(d.id) AS BIGINT) AS ids FROM star d JOIN {RULES_SQL} ON
    (r.min_confidence IS NULL OR d.confidence >= r.min_confidence) AND (trim(coalesce(r.min_tier, '')) = '' OR d.tier <= r.min_tier)
    AND (trim(coalesce(r.detection_type, '')) = '' OR d.type = r.detection_type) AND (trim(coalesce(r.source_site_name, '')) = '' OR d.site_name = r.source_site_name) GROUP BY r.id""", "posts detections star")
def rule_match(v: Views) -> DataFrame:
    return rules.match_rules(v.star, rule_rows(v)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.sum("detection_id").alias("ids"))


COST = """CASE model WHEN 'm0' THEN (input_tokens * 2.5 + output_tokens * 10.0) WHEN 'm1' THEN (input_tokens * 0.15 + output_tokens * 0.6) WHEN 'm2' THEN (input_tokens * 1.0 + output_tokens * 4.0)
    ELSE (input_tokens * 3.0 + output_tokens * 12.0) END / 1e6"""


def costed(v: Views) -> DataFrame:
    return rules.token_cost(v.usage, v.prices, "base")


@query("r15_j10_token_cost", f"SELECT model, count(*) AS n, round(sum({COST}), 6) AS cost_usd FROM usage GROUP BY model", "usage")
def token_cost(v: Views) -> DataFrame:
    return costed(v).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


MICRO = f"CASE WHEN {COST} > 0 THEN greatest(1, CAST(round_even({COST} * 1e6, 0) AS BIGINT)) ELSE 0 END"


@query("r16_a24_daily_cost", f"SELECT day, CAST(sum({MICRO}) AS BIGINT) AS micro_usd FROM usage GROUP BY day", "usage")
def daily_cost(v: Views) -> DataFrame:
    return reports.daily_cost(costed(v).withColumn("micro", rules.micro_usd(F.col("cost_usd"))), F.col("day"), "micro")


@query("w06_spend_cap", f"""SELECT day, count(*) FILTER (before < 20000) AS admitted, count(*) AS n, CAST(max(before) AS BIGINT) AS most FROM (
    SELECT day, coalesce(sum({MICRO}) OVER (PARTITION BY day ORDER BY l_orderkey, l_linenumber, model, input_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM usage) GROUP BY day""", "usage")
def spend_cap(v: Views) -> DataFrame:
    rows = costed(v).withColumn("micro", rules.micro_usd(F.col("cost_usd")))
    got = selection.spend_cap(rows, day="day", order=["l_orderkey", "l_linenumber", "model", "input_tokens"], micro="micro", cap=20000)
    return got.groupBy("day").agg(F.count_if("admitted").alias("admitted"), F.count(F.lit(1)).alias("n"), F.max("spent_before").alias("most"))


@query("a23_cost_summary", f"SELECT round(sum({COST}), 6) AS total_usd, round(avg({COST}), 9) AS mean_usd, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM usage", "usage")
def cost_summary(v: Views) -> DataFrame:
    return reports.cost_summary(costed(v)).withColumn("total_usd", F.round("total_usd", 6)).withColumn("mean_usd", F.round("mean_usd", 9))


@query("a25_stage_rollup", f"""SELECT 's' || (l_linenumber % 3) AS stage, model, count(*) AS runs, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    round(sum({COST}), 6) AS cost_usd, round(avg(l_linenumber * 7), 6) AS mean_latency_ms FROM usage GROUP BY ALL""", "usage")
def stage_rollup(v: Views) -> DataFrame:
    rows = costed(v).withColumn("stage", F.concat(F.lit("s"), (F.col("l_linenumber") % 3).cast("string"))).withColumn("latency_ms", F.col("l_linenumber") * 7)
    return reports.stage_rollup(rows).withColumn("cost_usd", F.round("cost_usd", 6)).withColumn("mean_latency_ms", F.round("mean_latency_ms", 6))


@query("w07_daily_delta", "SELECT day, n, n - coalesce(lag(n) OVER (ORDER BY day), 0) AS delta FROM (SELECT CAST(detected_at AS DATE) AS day, count(*) AS n FROM good GROUP BY 1)", "posts detections star good")
def daily_delta(v: Views) -> DataFrame:
    days = reports.qualified(v.detections).groupBy(F.to_date("detected_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    before = days.select(F.date_add("day", 1).alias("day"), F.col("n").alias("before"))
    return days.join(before, "day", "left").select("day", "n", (F.col("n") - F.coalesce("before", F.lit(0))).alias("delta"))


@query("w08_latest_per_key", "SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest(v: Views) -> DataFrame:
    return selection.latest_per_key(v.table("events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_id")


@query("o01_page", "SELECT id, type, tier FROM good ORDER BY detected_at DESC, id DESC LIMIT 20 OFFSET 40", "posts detections star good")
def page(v: Views) -> DataFrame:
    return selection.page(reports.qualified(v.detections), 2, 20).select("id", "type", "tier")


@query("o01_page_after", "SELECT id, type FROM good WHERE detected_at < TIMESTAMP '2024-01-20' OR (detected_at = TIMESTAMP '2024-01-20' AND id < 100) ORDER BY detected_at DESC, id DESC LIMIT 50", "posts detections star good")
def page_after(v: Views) -> DataFrame:
    return selection.page_after(reports.qualified(v.detections), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 100, 50).select("id", "type")


@query("o02_most_recent", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent(v: Views) -> DataFrame:
    return selection.most_recent(v.table("events"), "ts", "event_id", 20).select("event_id", "event_type")


@query("o03_unlabelled", "SELECT id FROM star WHERE id % 4 <> 0 AND tier = 'T1' AND site_name IN ('src0', 'src1') ORDER BY detected_at DESC, id DESC LIMIT 50", "posts detections star")
def unlabelled(v: Views) -> DataFrame:
    rows = v.star.withColumn("human_label", F.when(F.col("id") % 4 == 0, "x"))
    sites = v.posts.select("site_name").distinct().where(F.col("site_name").isin("src0", "src1"))
    return selection.unlabelled(rows, sites=sites, tier="T1", limit=50).select("id")


@query("o06_detail", "SELECT d.id, d.type, d.site_name, length(p.body) AS chars FROM star d JOIN posts p USING (post_id)", "posts detections star")
def detail(v: Views) -> DataFrame:
    return v.detections.join(v.posts, "post_id").select("id", "type", "site_name", F.length("body").cast("bigint").alias("chars"))


OUTBOX = """SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'PENDING' WHEN event_type = 'click' THEN 'PROCESSING' ELSE 'COMPLETED' END AS status, CAST(user_id % 5 AS INTEGER) AS attempts,
    ts AS created_at, CASE WHEN event_type = 'click' THEN ts + INTERVAL 1 MINUTE END AS claimed_at, event_type AS last_error FROM events"""


def outbox(v: Views) -> DataFrame:
    e = F.col("event_type")
    return v.table("events").select(
        F.col("event_id").alias("id"), F.when(e == "view", "PENDING").when(e == "click", "PROCESSING").otherwise("COMPLETED").alias("status"), (F.col("user_id") % 5).cast("int").alias("attempts"),
        F.col("ts").alias("created_at"), F.when(e == "click", F.col("ts") + F.expr("interval 1 minute")).alias("claimed_at"), e.alias("last_error"),
    )


CLAIM = """(SELECT * FROM (%s) WHERE (status = 'PENDING' OR (status = 'PROCESSING' AND claimed_at < TIMESTAMP '2024-01-15' - INTERVAL 5 MINUTE)) AND attempts < 3 ORDER BY created_at, id LIMIT 50)""" % OUTBOX


@query("o07_claim_set", f"SELECT id, status, attempts FROM {CLAIM}")
def claim_set(v: Views) -> DataFrame:
    return selection.claimable(outbox(v), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("id", "status", "attempts")


@query("m12_claim", f"""SELECT o.id, CASE WHEN c.id IS NOT NULL THEN 'PROCESSING' ELSE o.status END AS status, CAST(o.attempts + CASE WHEN c.id IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS attempts,
    CASE WHEN c.id IS NULL THEN o.last_error END AS last_error FROM ({OUTBOX}) o LEFT JOIN {CLAIM} c USING (id)""")
def claim(v: Views) -> DataFrame:
    at = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return merge.claim(outbox(v), selection.claimable(outbox(v), at), at).select("id", "status", "attempts", "last_error")


@query("m03_m04_insert_ignore", """SELECT b.post_id, b.model_version, b.id AS detection_id, 'PENDING' AS status FROM (
    SELECT *, row_number() OVER (PARTITION BY post_id, model_version ORDER BY id) AS r FROM (SELECT event_id AS id, event_id % 300 AS post_id, 'v' || (user_id % 3) AS model_version FROM events WHERE event_type <> 'view')) b
    WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_type = 'view' AND o.event_id % 300 = b.post_id AND 'v' || (o.user_id % 3) = b.model_version)""")
def insert_ignore(v: Views) -> DataFrame:
    rows = v.table("events").select(F.col("event_id").alias("id"), (F.col("event_id") % 300).alias("post_id"), F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("model_version"), "event_type")
    fresh = merge.new_detections(rows.where("event_type = 'view'"), rows.where("event_type <> 'view'"), [F.asc("id")])
    return fresh.select("post_id", "model_version", "id").join(merge.outbox_rows(fresh), F.col("id") == F.col("detection_id")).select("post_id", "model_version", "detection_id", "status")


@query("m06_label_update", """SELECT d.id, u.label AS human_label, u.source AS label_source FROM detections d LEFT JOIN (
    SELECT user_id, max_by('l' || event_type, ts) AS label, 'person' AS source FROM events WHERE event_type IN ('error', 'signup') AND user_id % 7 = 1 GROUP BY user_id) u ON d.id = u.user_id""", "detections")
def label_update(v: Views) -> DataFrame:
    rows = v.detections.select("id", F.col("id").alias("post_id"), F.lit("m").alias("model_version"), F.lit(None).cast("string").alias("human_label"), F.lit(None).cast("timestamp_ntz").alias("human_verified_at"), F.lit(None).cast("string").alias("label_source"))
    ups = v.table("events").where("event_type in ('error', 'signup') and user_id % 7 = 1").select(F.col("user_id").alias("post_id"), F.lit("m").alias("model_version"), F.concat(F.lit("l"), F.col("event_type")).alias("label"), F.col("ts").alias("at"), F.lit("person").alias("source"))
    return merge.update_labels(rows, ups)[0].select("id", "human_label", "label_source")


@query("m08_orphans", "SELECT count(*) FILTER (event_type IN ('view', 'click')) AS swept, count(*) AS n FROM events")
def orphans(v: Views) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "queued").otherwise("done")
    jobs = v.table("events").select("event_id", status.alias("status"), F.lit(None).cast("timestamp_ntz").alias("finished_at"))
    done = merge.sweep_orphans(jobs, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return done.agg(F.count_if((F.col("status") == "failed") & F.col("swept") & F.col("finished_at").isNotNull()).alias("swept"), F.count(F.lit(1)).alias("n"))


@query("m09_job_fold", """SELECT user_id AS job_id, max_by(event_type, ts) FILTER (event_type <> 'view') AS status, max_by(value, ts) FILTER (value > 100) AS progress FROM (SELECT * FROM events) GROUP BY user_id""")
def job_fold(v: Views) -> DataFrame:
    ups = v.table("events").select(F.col("user_id").alias("job_id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("status"), F.when(F.col("value") > 100, F.col("value")).alias("progress"), "ts")
    return merge.fold_updates(ups, "job_id", ["status", "progress"], F.col("ts"))


@query("m10_outbox_outcome", """WITH e AS (SELECT user_id AS event_id, bool_or(event_type = 'error') AS is_illegal, count(*) FILTER (event_type = 'signup') AS n_rules, CAST(max(event_id % 4) AS INTEGER) AS attempts FROM events GROUP BY user_id),
    d AS (SELECT user_id AS event_id, bool_or(event_type = 'purchase' AND value > 400) AS ok FROM events GROUP BY user_id)
    SELECT event_id, CASE WHEN NOT is_illegal OR n_rules = 0 THEN 'SKIPPED' WHEN ok THEN 'COMPLETED' WHEN attempts >= 3 THEN 'FAILED' ELSE 'PENDING' END AS outcome FROM e LEFT JOIN d USING (event_id)""")
def outbox_outcome(v: Views) -> DataFrame:
    e = v.table("events")
    events = e.groupBy(F.col("user_id").alias("event_id")).agg(F.bool_or(F.col("event_type") == "error").alias("is_illegal"), F.count_if(F.col("event_type") == "signup").alias("n_rules"), F.max(F.col("event_id") % 4).cast("int").alias("attempts"))
    tries = e.select(F.col("user_id").alias("event_id"), F.when((F.col("event_type") == "purchase") & (F.col("value") > 400), "SUCCESS").otherwise("FAILED").alias("status"), F.col("event_type").alias("error_message"), F.col("ts").alias("attempted_at"))
    return merge.outbox_outcome(events, tries).select("event_id", "outcome")


@query("k09_retry_schedule", """SELECT user_id AS post_id, CASE WHEN ok THEN 'acked' WHEN hard OR failures > 3 THEN 'dead_letter' ELSE 'retry' END AS state, CASE WHEN NOT ok AND NOT hard AND failures <= 3 THEN pow(2.0, failures - 1) END AS delay_s
    FROM (SELECT user_id, bool_or(event_type = 'purchase') AS ok, bool_or(event_type = 'error') AS hard, count(*) FILTER (event_type = 'view') AS failures FROM events GROUP BY user_id)""")
def retry_schedule(v: Views) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for x in ("purchase", "acked", "error", "failed_permanent", "view", "failed_transient")])[F.col("event_type")]
    log = v.table("events").select(F.col("user_id").alias("post_id"), F.col("ts").alias("at"), F.coalesce(kinds, F.lit("claimed")).alias("event"))
    return merge.retry_schedule(log).select("post_id", "state", "delay_s")


@query("k10_token_bucket", """WITH RECURSIVE r AS (SELECT event_type AS key, event_id, epoch_us(ts) / 1e6 AS now, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT key, event_id, n, now, CAST(4 AS DOUBLE) AS tokens, true AS admitted, CAST(0 AS DOUBLE) AS wait FROM r WHERE n = 1
    UNION ALL SELECT key, event_id, n, now, t - (t >= 1)::INT, t >= 1, CASE WHEN t >= 1 THEN 0 ELSE (1 - t) * 600 END FROM (SELECT r.*, least(5, f.tokens + (r.now - f.now) / 600) AS t FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1))
    SELECT key, event_id, admitted, round(wait, 3) AS wait_s FROM f""")
def token_bucket(v: Views) -> DataFrame:
    rows = v.table("events").select(F.col("event_type").alias("key"), F.col("ts").alias("at"), "event_id")
    return merge.token_bucket(rows, tie="event_id", capacity=5.0, refill=1 / 600).select("key", "event_id", "admitted", F.round("wait_s", 3).alias("wait_s"))


@query("j02_left_sources", "SELECT s.site_name, max(p.crawled_at) AS latest, count(p.post_id) AS n FROM (SELECT DISTINCT site_name FROM posts UNION SELECT DISTINCT 'src' || user_id FROM events) s LEFT JOIN posts p USING (site_name) GROUP BY 1", "posts")
def left_sources(v: Views) -> DataFrame:
    """Sources are those of the posts and, without posts, one for each user."""
    found = v.posts.groupBy("site_name").agg(F.max("crawled_at").alias("latest"), F.count(F.lit(1)).alias("n"))
    named = v.table("events").select(F.concat(F.lit("src"), F.col("user_id").cast("string")).alias("site_name"))
    sources = v.posts.select("site_name").unionAll(named).distinct()
    return sources.join(found, "site_name", "left").select("site_name", "latest", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@query("j03_u04_full_outer", """SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS left_n, coalesce(b.n, 0) AS right_n FROM (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) a
    FULL JOIN (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) b ON a.k = b.k""")
def full_outer(v: Views) -> DataFrame:
    n = lambda kind, name: v.table("events").where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias(name))
    return n("error", "left_n").join(n("purchase", "right_n"), "k", "full").na.fill(0, ["left_n", "right_n"])


@query("j08_semi", "SELECT count(*) AS n FROM posts p WHERE EXISTS (SELECT 1 FROM detections d WHERE d.post_id = p.post_id AND d.tier = 'T1')", "posts detections")
def semi(v: Views) -> DataFrame:
    return v.posts.join(v.detections.where("tier = 'T1'"), "post_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))


GAMES = [("src0", "g1"), ("src1", "g1"), ("src2", "g2"), ("src3", "g2"), ("src4", "g3")]
GAMES_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in GAMES) + ") g(site_name, game_key)"


def games(v: Views) -> DataFrame:
    return v.spark.createDataFrame(GAMES, "site_name string, game_key string")


@query("j09_dimension_lookup", f"SELECT coalesce(g.game_key, '(unmapped)') AS game_key, count(*) AS n FROM star LEFT JOIN {GAMES_SQL} USING (site_name) GROUP BY 1", "posts detections star")
def lookup(v: Views) -> DataFrame:
    return v.star.join(F.broadcast(games(v)), "site_name", "left").groupBy(F.coalesce("game_key", F.lit("(unmapped)")).alias("game_key")).agg(F.count(F.lit(1)).alias("n"))


@query("j11_left_chain", "SELECT count(*) AS n, count(d.id) AS with_detection, count(p.post_id) AS with_post FROM events e LEFT JOIN detections d ON d.id = e.event_id + 5000 LEFT JOIN posts p ON p.post_id = d.post_id", "posts detections")
def left_chain(v: Views) -> DataFrame:
    e = v.table("events").select((F.col("event_id") + 5000).alias("id"))
    made = e.join(v.detections.select("id", "post_id", F.lit(1).alias("d")), "id", "left").join(v.posts.select("post_id", F.lit(1).alias("p")), "post_id", "left")
    return made.agg(F.count(F.lit(1)).alias("n"), F.count("d").alias("with_detection"), F.count("p").alias("with_post"))


@query("w04_top_examples", f"""SELECT game_key, type, id FROM (SELECT g.game_key, d.type, d.id, row_number() OVER (PARTITION BY g.game_key, d.type ORDER BY d.confidence DESC, d.id) AS r
    FROM star d JOIN {GAMES_SQL} USING (site_name)) WHERE r <= 3""", "posts detections star")
def top_examples(v: Views) -> DataFrame:
    rows = v.star.join(F.broadcast(games(v)), "site_name")
    return selection.top_per_group(rows, ["game_key", "type"], [F.desc("confidence"), F.asc("id")], 3).select("game_key", "type", "id")


@query("t22_t23_risk_severity", """SELECT severity, tier, count(*) AS n, round(sum(risk), 5) AS risk FROM (SELECT tier, CASE WHEN NOT is_illegal THEN 'low' WHEN tier = 'T1' THEN 'high' WHEN tier = 'T2' THEN 'medium' ELSE 'low' END AS severity,
    CASE tier WHEN 'T1' THEN 0.85 + 0.15 * confidence WHEN 'T2' THEN 0.65 + 0.15 * confidence WHEN 'T3' THEN 0.45 + 0.15 * confidence ELSE confidence END AS risk FROM detections) GROUP BY severity, tier""", "detections")
def risk(v: Views) -> DataFrame:
    rows = v.detections.select("tier", X.severity(F.col("is_illegal"), F.col("tier"), F.col("confidence")).alias("severity"), X.risk_score(F.col("tier"), F.col("confidence")).alias("risk"))
    return rows.groupBy("severity", "tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("risk"), 5).alias("risk"))


@query("t30_lenient_fields", "SELECT coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(json_extract_string(props, '$.none'), '') AS none, count(*) AS n FROM events GROUP BY 1, 2")
def lenient(v: Views) -> DataFrame:
    return v.table("events").groupBy(X.lenient_long(F.col("props"), "$.k").alias("k"), X.lenient_text(F.col("props"), "$.none").alias("none")).agg(F.count(F.lit(1)).alias("n"))


@query("t29_percent", "SELECT user_id, CAST(least(100, round_even(100.0 * count(*) FILTER (event_type = 'view') / count(*), 0)) AS INTEGER) AS percent FROM events GROUP BY user_id")
def percent(v: Views) -> DataFrame:
    made = v.table("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("d"), F.count(F.lit(1)).alias("t"))
    return made.select("user_id", X.percent_done(F.col("d"), F.col("t")).alias("percent"))

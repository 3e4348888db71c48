"""Queries of the remaining rules, functions and merges, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.functions import fixed
from siftlake.functions import text as X
from siftlake.functions import urls as U
from siftlake.operators import links as L
from siftlake.operators import merge, reports, rules, selection
from siftlake.plans.bindings import Views
from siftlake.plans.registry import query
from siftlake.session import stored

ERRORS = {"error": "HTTP 403 with HTML content", "click": "Timeout 30000ms", "purchase": "Blocked by anti-bot", "signup": "odd"}
CLASSES = "CASE event_type WHEN 'error' THEN 'cloudflare_or_waf_403_html' WHEN 'click' THEN 'timeout' WHEN 'purchase' THEN 'anti_bot_blocked' WHEN 'signup' THEN 'other' END"


def failures(v: Views) -> DataFrame:
    error = F.create_map(*[F.lit(x) for kv in ERRORS.items() for x in kv])[F.col("event_type")]
    rows = v.table("events").select((F.col("user_id") % 4).cast("string").alias("site"), error.alias("error"))
    return rows.withColumn("reason", F.when(F.col("error").isNotNull(), rules.fetch_error_class(F.col("error"))))


@query("r14_error_class", f"SELECT {CLASSES} AS reason, count(*) AS n FROM events GROUP BY 1")
def error_class(v: Views) -> DataFrame:
    return failures(v).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("a15_error_reasons", f"SELECT reason, site, count(*) AS n FROM (SELECT {CLASSES} AS reason, CAST(user_id % 4 AS VARCHAR) AS site FROM events) WHERE reason IS NOT NULL GROUP BY GROUPING SETS ((reason, site), (reason))")
def error_reasons(v: Views) -> DataFrame:
    return reports.error_reasons(failures(v), "reason", "site")


@query("r11_merge_verdicts", """SELECT t.event_id AS post_id, CASE WHEN i.event_type = 'purchase' THEN i.event_type ELSE t.event_type END AS type, CAST(t.user_id + i.user_id AS BIGINT) AS input_tokens FROM events t JOIN events i ON i.event_id = t.event_id + 1""")
def merge_verdicts(v: Views) -> DataFrame:
    def verdicts(shift: int) -> DataFrame:
        return v.table("events").select((F.col("event_id") - shift).alias("post_id"), F.col("event_type").alias("type"), F.lit(0.5).alias("confidence"), F.lit("r").alias("reason"), F.lit(None).cast("string").alias("translated_text"), (F.col("event_type") == "purchase").alias("image_observed"), F.col("user_id").alias("input_tokens"), F.lit(1).alias("output_tokens"), F.lit(0.0).alias("cost_usd"))

    return rules.merge_verdicts(verdicts(0), verdicts(1)).select("post_id", "type", "input_tokens")


@query("r13_enabled_rules", "SELECT event_id AS id FROM events WHERE user_id % 2 = 0 AND value > 100 AND event_type = 'error'")
def enabled_rules(v: Views) -> DataFrame:
    rows = v.table("events").select(F.col("event_id").alias("id"), (F.col("user_id") % 2 == 0).alias("enabled"), (F.col("value") > 100).alias("channel_enabled"), "event_type", F.col("ts").alias("created_at"))
    return rules.enabled_rules(rows, "error").select("id")


@query("r17_valid_labels", "SELECT count(*) AS n FROM events WHERE event_type IN ('view', 'error')")
def valid_labels(v: Views) -> DataFrame:
    label = F.when(F.col("event_type") == "view", "unknown").when(F.col("event_type") == "error", "기타").otherwise(F.col("event_type"))
    return rules.valid_labels(v.table("events").select(label.alias("human_label"))).agg(F.count(F.lit(1)).alias("n"))


@query("t24_model_version", "SELECT 'agentic:v1:m' || (l_partkey % 5) || ':2024-01' AS version, 'v1' AS part, count(*) AS n FROM lineitem GROUP BY 1")
def model_version(v: Views) -> DataFrame:
    version = X.model_version(F.lit("agentic"), F.lit("v1"), F.concat(F.lit("m"), (F.col("l_partkey") % 5).cast("string")), F.lit("2024-01"))
    return v.table("lineitem").groupBy(version.alias("version")).agg(F.count(F.lit(1)).alias("n")).withColumn("part", X.model_of(F.col("version")))


@query("t25_t26_t27_images", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END AS merged, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 1 END AS kept, CASE WHEN page_id % 3 = 0 THEN url ELSE 'fit' END AS body FROM pages")
def images(v: Views) -> DataFrame:
    own, even = F.array(F.col("url"), F.lit("")), F.col("page_id") % 2 == 0
    merged = X.merge_images(own, F.when(even, F.array(F.lit("s3/x"), F.col("url"))).otherwise(F.array(F.col("url"))))
    kept = X.filter_images(merged, F.lit(None).cast("array<string>"))
    return v.table("pages").select("page_id", F.size(merged).alias("merged"), F.size(kept).alias("kept"), X.pick_body(F.when(F.col("page_id") % 3 == 0, "").otherwise("fit"), F.col("url")).alias("body"))


@query("t18_parse_time", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE date_trunc('second', ts) END AS at FROM events")
def parse_time(v: Views) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return v.table("events").select("event_id", X.parse_time(text, F.lit("2024-02-01 00:00:00")).cast("timestamp_ntz").alias("at"))


@query("l03_unwrap_redirect", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://other.example/?url=' || page_id END AS target FROM pages")
def unwrap(v: Views) -> DataFrame:
    wrapped = F.concat(F.lit("https://ref.gamer.com.tw/redir.php?url="), F.url_encode("url"))
    url = F.when(F.col("page_id") % 2 == 0, wrapped).otherwise(F.concat(F.lit("https://other.example/?url="), F.col("page_id").cast("string")))
    return v.table("pages").select("page_id", U.unwrap_redirect(url).alias("target"))


#: Fetches: address, content type, state, redirects, where it ended, what the host was resolved to; and what they are.
FETCHES = (
    ("https://discord.gg/x", "text/html", 200, 0, None, "8.8.8.8", "messenger", "skipped:messenger", False, fixed.MESSENGER_INDICATOR), ("ftp://x.org/", "text/html", 200, 0, None, "8.8.8.8", "blocked", "blocked:scheme", False, ""),
    ("http://h.org/", "text/html", 200, 4, None, "8.8.8.8", "error", "error:too_many_redirects", False, ""), ("http://h.org/a", "application/zip; x=y", 200, 0, None, "8.8.8.8", "file_direct_link", "abort:content_type:application/zip; x=y", True, fixed.FILE_INDICATOR % "application/zip"),
    ("http://h.org/a", "text/html", 500, 0, None, "8.8.8.8", "error", "error:http_500", False, ""), ("http://h.org/a", "text/html", 200, 1, "https://i.org/b", "8.8.8.8", "web", "ok", False, ""),
    ("http://h.org/a", "text/html", 200, 1, "ftp://b/", "8.8.8.8", "blocked", "blocked:redirect_target", False, ""), ("http://h.org/a", "text/html", 200, 9, "http://127.0.0.1/", "8.8.8.8", "blocked", "blocked:redirect_target", False, ""),
    ("http://169.254.169.254/latest", "text/html", 200, 0, None, "8.8.8.8", "blocked", "blocked:ip", False, ""), ("http://[::ffff:10.0.0.1]/", "text/html", 200, 0, None, "8.8.8.8", "blocked", "blocked:ip", False, ""),
    ("http://h_x.org/a|b", "image/png", 200, 0, None, "8.8.8.8", "file_direct_link", "abort:content_type:image/png", False, ""), ("http://in.org/", "text/html", 200, 0, None, "10.0.0.9", "blocked", "blocked:ip", False, ""),
    ("http://gone.org/", "text/html", 200, 0, None, None, "blocked", "blocked:dns", False, ""), ("http://8.8.8.8/", "", 200, 3, "http://[2606:4700::1]/", "8.8.8.8", "web", "ok", False, ""),
    ("http://h.org/get", "application/x-msdownload", 200, 1, "https://store.steampowered.com/install", "8.8.8.8", "file_direct_link", "abort:content_type:application/x-msdownload", False, ""),
)
FETCHES_SQL = ", ".join(f"({k}, '{r[6]}', '{r[7]}', {r[8]}, '{r[9]}')" for k, r in enumerate(FETCHES))


@query("l13_fetch_log", f"SELECT page_id, kind, fetch_status, is_distribution_site, indicators FROM pages JOIN (VALUES {FETCHES_SQL}) f(k, kind, fetch_status, is_distribution_site, indicators) ON page_id % {len(FETCHES)} = f.k")
def fetch_log(v: Views) -> DataFrame:
    names = ("url", "content_type", "http_status", "redirects", "final_url", "ip")
    forms = F.array(*[F.struct(*[F.lit(x).cast("int" if isinstance(x, int) else "string").alias(n) for n, x in zip(names, r)]) for r in FETCHES])
    log = v.table("pages").select("page_id", F.element_at(forms, (F.col("page_id") % len(FETCHES) + 1).cast("int")).alias("f")).select("page_id", "f.*")
    log = stored(log.withColumn("resolved", F.array_compact(F.array("ip"))), "fetch-log")  # else the plan copies the forms for each field
    return L.classify_fetches(log, resolved="resolved").select("page_id", "kind", "fetch_status", "is_distribution_site", F.array_join("indicators", "; ").alias("indicators"))


@query("l17_evidence_reuse", """SELECT l.user_id AS url, e.evidence, e.evidence IS NULL AS to_fetch FROM (SELECT DISTINCT user_id FROM events) l LEFT JOIN (SELECT user_id, arg_max(event_id, (ts, event_id)) AS evidence FROM events
    WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' AND user_id % 3 = 0 GROUP BY user_id) e USING (user_id)""")
def evidence_reuse(v: Views) -> DataFrame:
    e = v.table("events")
    stored = e.where("user_id % 3 = 0").select(F.col("user_id").alias("url"), F.col("event_id").alias("evidence"), F.col("ts").alias("fetched_at"))
    return merge.with_reused_evidence(e.select(F.col("user_id").alias("url")).distinct(), stored, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))


@query("o05_trace", "SELECT event_id, event_type AS stage FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def trace(v: Views) -> DataFrame:
    e = v.table("events")
    runs = e.select("event_id", F.col("user_id").alias("detection_id"), F.col("event_type").alias("stage"), F.col("ts").alias("created_at"))
    first = e.agg(F.min("user_id")).first()[0]
    return selection.trace_of(runs, e.select(F.col("user_id").alias("id")), first).select("event_id", "stage")


@query("m05_traces_of_inserted", "SELECT count(*) AS n FROM events WHERE event_id % 300 IN (SELECT event_id % 300 FROM events WHERE event_type = 'error') AND event_id % 300 NOT IN (SELECT event_id % 300 FROM events WHERE event_type = 'view' AND event_id % 7 = 0)")
def traces(v: Views) -> DataFrame:
    rows = v.table("events").select(F.col("event_id").alias("id"), (F.col("event_id") % 300).alias("post_id"), F.lit("m").alias("model_version"), "event_type")
    fresh = merge.new_detections(rows.where("event_type = 'view' and id % 7 = 0"), rows.where("event_type = 'error'"), [F.asc("id")])
    return merge.trace_rows(rows, fresh).agg(F.count(F.lit(1)).alias("n"))


@query("m11_delivery_log", "SELECT CASE WHEN event_id % 2 = 0 AND value BETWEEN 200 AND 299 THEN 'SUCCESS' ELSE 'FAILED' END AS status, count(*) AS n FROM events GROUP BY 1")
def delivery_log(v: Views) -> DataFrame:
    e = v.table("events").select("event_id", (F.col("event_id") % 5).alias("rule_id"), F.col("value").alias("response_code"))
    log = merge.delivery_log(e.select("event_id", "rule_id"), e.where("event_id % 2 = 0"))
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("n"))

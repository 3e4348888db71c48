"""Views of the driver's tables in the library's terms, for queries and benchmarks, and the same views in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.session import small_batches

AS_OF = "2024-01-30"
#: Terms that occur in the synthetic prose; the library's own lists are tested on literal rows.
LEXICON = {
    "high_risk": ("hand", "onnt", "verung", "für"),
    "contact": ("with", "les"),
    "download": ("thing", "edre", "ein"),
    "game": ("que", "this"),
    "context": ("and", "del"),
    "low_intent": ("was", "der"),
}
TIER_SQL = "CASE event_type WHEN 'error' THEN 'T1' WHEN 'purchase' THEN 'T2' WHEN 'click' THEN 'T3' WHEN 'signup' THEN 'T3' ELSE 'T4' END"
TIERS = {"error": "T1", "purchase": "T2", "click": "T3", "signup": "T3", "view": "T4"}

SQL = {
    "posts": "SELECT doc_id AS post_id, source AS site_name, text AS body, lang AS language, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS crawled_at FROM documents",
    "detections": f"""SELECT event_id AS id, event_id % (SELECT count(*) FROM documents) AS post_id, event_type AS type, {TIER_SQL} AS tier,
        event_type <> 'view' AS is_illegal, least(value / 100, 1.0) AS confidence, ts AS detected_at, user_id, props FROM events""",
    "star": "SELECT d.*, p.site_name, p.language FROM detections d JOIN posts p USING (post_id)",
    "good": "SELECT * FROM star WHERE is_illegal AND confidence >= 0.7",
    "candidates": """SELECT doc_id, source AS site_id, 'https://' || source || '.example.org/board' AS board_url,
        'https://' || source || '.example.org/board/' || doc_id AS url, substr(text, 1, 80) AS title, doc_id AS ord,
        contains(lower(substr(text, 1, 80)), 'tion') AS keyword_matched, doc_id % 2 = 0 AS has_title_keywords FROM documents""",
    "usage": """SELECT l_orderkey, l_linenumber, 'm' || (l_partkey % 5) AS model, CAST(l_quantity * 100 AS BIGINT) AS input_tokens,
        CAST(l_linenumber * 10 AS BIGINT) AS output_tokens, CAST(l_shipdate AS DATE) AS day FROM lineitem""",
    "hrefs": """SELECT page_id, base, unnest(h) AS href, generate_subscripts(h, 1) AS ord
        FROM (SELECT page_id, url AS base, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)""",
}


def with_views(names: str, sql: str) -> str:
    """``sql`` with the named views before it."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names.split()) + "\n" + sql


class Views:
    """The tables of a folder and the views over them.

    The documents stand for posts. They have no titles: the title of a listing's candidate is the first 80
    characters of the text, as titles are short; bodies are whole texts.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = small_batches(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def posts(self) -> DataFrame:
        at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0)")
        return self.documents.select(
            F.col("doc_id").alias("post_id"), F.col("source").alias("site_name"), F.col("text").alias("body"), F.col("lang").alias("language"), at.alias("crawled_at")
        )

    @cached_property
    def detections(self) -> DataFrame:
        n = self.documents.count()  # from the files' footers
        tier = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])[F.col("event_type")]
        return self.table("events").select(
            F.col("event_id").alias("id"),
            (F.col("event_id") % F.lit(n)).alias("post_id"),
            F.col("event_type").alias("type"),
            F.coalesce(tier, F.lit("T4")).alias("tier"),
            (F.col("event_type") != "view").alias("is_illegal"),
            F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"),
            F.col("ts").alias("detected_at"),
            "user_id",
            "props",
        )

    @cached_property
    def star(self) -> DataFrame:
        return self.detections.join(self.posts.select("post_id", "site_name", "language"), "post_id")

    @cached_property
    def candidates(self) -> DataFrame:
        board = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/board"))
        title = F.substring("text", 1, 80)
        return self.documents.select(
            "doc_id",
            F.col("source").alias("site_id"),
            board.alias("board_url"),
            F.concat(board, F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
            title.alias("title"),
            F.col("doc_id").alias("ord"),
            F.contains(F.lower(title), F.lit("tion")).alias("keyword_matched"),
            (F.col("doc_id") % 2 == 0).alias("has_title_keywords"),
        )

    @cached_property
    def usage(self) -> DataFrame:
        return self.table("lineitem").select(
            "l_orderkey",
            "l_linenumber",
            F.concat(F.lit("m"), (F.col("l_partkey") % 5).cast("string")).alias("model"),
            (F.col("l_quantity") * 100).cast("bigint").alias("input_tokens"),
            (F.col("l_linenumber") * 10).cast("bigint").alias("output_tokens"),
            F.to_date("l_shipdate").alias("day"),
        )

    @cached_property
    def prices(self) -> DataFrame:
        return self.spark.createDataFrame([("m0", 2.5, 10.0), ("m1", 0.15, 0.6), ("m2", 1.0, 4.0), ("base", 3.0, 12.0)], "model string, input double, output double")

    @cached_property
    def hrefs(self) -> DataFrame:
        found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
        return self.table("pages").select("page_id", F.col("url").alias("base"), F.posexplode(found).alias("_p", "href")).select(
            "page_id", "base", "href", (F.col("_p") + 1).cast("bigint").alias("ord")
        )

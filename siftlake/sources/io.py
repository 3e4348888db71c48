"""Readers and writers of the event, label, archive and corpus formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from siftlake.functions import fixed
from siftlake.functions.text import language_code, pick_body, strip
from siftlake.functions.urls import post_id

EVENT_SCHEMA = (
    "post_id string, source_id string, site_name string, raw_text string, language string, detected_at string, correlation_id string, "
    "image_urls array<string>, s3_text_path string, s3_image_paths array<string>, post_url string"
)


def decode_events(df: DataFrame, column: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Good events (typed) and corrupt payloads. Corrupt: no JSON object, an unknown or missing field, a list field that is none."""
    marked = with_event(df, column)
    good = marked.where(~F.col("is_corrupt")).select("event.*")
    return good, marked.where("is_corrupt").select(*df.columns)


def with_event(df: DataFrame, column: str = "raw") -> DataFrame:
    """``df`` with ``event`` (struct) and ``is_corrupt``; one pass, for batch and stream.

    A payload is parsed once to a VARIANT, whose types are tested: lists must be lists and the text path a string; null is neither.
    JSON that a VARIANT does not take (a key given twice) is corrupt.
    """
    raw = F.col(column)
    keys = F.json_object_keys(raw)
    need = F.array(*[F.lit(k) for k in fixed.EVENT_REQUIRED])
    known = F.array(*[F.lit(k) for k in (*fixed.EVENT_REQUIRED, *fixed.EVENT_OPTIONAL)])
    unknown, missing = F.size(F.array_except(keys, known)) > 0, F.size(F.array_except(need, keys)) > 0
    parsed = F.try_parse_json(raw)

    def other(field: str, kind: str) -> Column:
        """Whether a field is given and is of another type."""
        got = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))
        return F.array_contains(keys, F.lit(field)) & ~F.coalesce(F.startswith(got, F.lit(kind)), F.lit(False))

    corrupt = keys.isNull() | parsed.isNull() | unknown | missing | other("image_urls", "ARRAY") | other("s3_image_paths", "ARRAY") | other("s3_text_path", "STRING")
    event = F.from_json(raw, EVENT_SCHEMA)
    empty = F.array().cast("array<string>")
    filled = event.withField("image_urls", F.coalesce(event["image_urls"], empty)).withField("s3_image_paths", F.coalesce(event["s3_image_paths"], empty))
    filled = filled.withField("s3_text_path", F.coalesce(event["s3_text_path"], F.lit(""))).withField("post_url", F.coalesce(event["post_url"], F.lit("")))
    return df.withColumn("event", filled).withColumn("is_corrupt", F.coalesce(corrupt, F.lit(True)))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a declared schema; a line that does not fit is an error that shows its file and how it begins. Blank lines are skipped.

    Lines have no numbers when many tasks read a file, so the error names the line by its text.
    """
    fields = StructType.fromDDL(schema)
    bad = "_malformed"
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    row = F.from_json("value", StructType([*fields, StructField(bad, StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    lines = lines.withColumn("row", row)
    message = F.concat(F.lit("no row of the declared schema in "), "file", F.lit(": "), F.substring("value", 1, 200))
    checked = F.when(F.col(f"row.{bad}").isNull(), F.col("row")).otherwise(F.raise_error(message))
    return lines.select(checked.alias("row")).select(*[F.col(f"row.`{c}`") for c in fields.names])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("post_id string, text string, label string, type string").csv(path, header=True, multiLine=True, escape='"')


def write_archive(df: DataFrame, path: str) -> DataFrame:
    """Write bodies by site and day; empty ones and ids with other than letters, digits, ``_`` and ``-`` stay out. Returns the latter."""
    safe = F.coalesce(F.col("site_name").rlike(r"^[A-Za-z0-9_\-]+$") & F.col("post_id").cast("string").rlike(r"^[A-Za-z0-9_\-]+$"), F.lit(False))
    full = F.coalesce(strip(F.col("body")), F.lit("")) != ""
    out = df.where(safe & full).withColumn("site", F.col("site_name")).withColumn("crawl_date", F.to_date("crawled_at"))
    out.select("site", "crawl_date", "post_id", "body").write.mode("append").partitionBy("site", "crawl_date").json(path)
    return df.where(~safe & full)


def write_corpus(df: DataFrame, path: str) -> None:
    """One folder of JSON lines per game key; groups of an earlier export that are now empty go."""
    df.where(F.col("game_key").isNotNull()).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("game_key").json(path)


def candidate_inventory(candidates: DataFrame, selected: DataFrame, key: str = "url") -> DataFrame:
    """Every candidate with ``selected``: whether it was picked."""
    picked = selected.select(key).distinct().withColumn("_p", F.lit(True))
    return candidates.drop("selected").join(picked.hint("merge"), key, "left").withColumn("selected", F.coalesce("_p", F.lit(False))).drop("_p")


def assemble_repo_document(df: DataFrame, readme_chars: int = 20_000, release_chars: int = 4_000) -> DataFrame:
    """A text of a repository: header lines with defaults, README and release cut, assets as bullets; its id."""

    def shown(c: str, default: str) -> Column:
        return F.coalesce(F.nullif(strip(F.col(c).cast("string")), F.lit("")), F.lit(default))

    assets = F.transform(F.coalesce(F.col("release.assets"), F.array().cast("array<struct<name:string>>")), lambda a: F.concat(F.lit("- "), a["name"]))
    lines = [
        F.concat(F.lit("Repository: "), F.col("full_name")),
        F.concat(F.lit("URL: "), shown("html_url", "(unknown)")),
        F.concat(F.lit("Description: "), shown("description", "(none)")),
        F.concat(F.lit("Topics: "), F.coalesce(F.nullif(F.array_join("topics", ", "), F.lit("")), F.lit("(none)"))),
        F.concat(F.lit("Stars: "), F.coalesce(F.col("stargazers_count"), F.lit(0)).cast("string")),
        F.concat(F.lit("Language: "), shown("language", "(unknown)")),
        F.lit("README:"),
        F.coalesce(F.nullif(F.substring("readme", 1, readme_chars), F.lit("")), F.lit("(none)")),
        F.lit("Release:"),
        F.coalesce(F.nullif(F.substring(F.col("release.body"), 1, release_chars), F.lit("")), F.lit("(none)")),
        F.coalesce(F.nullif(F.array_join(assets, "\n"), F.lit("")), F.lit("(none)")),
    ]
    return df.select(F.replace("full_name", F.lit("/"), F.lit("__")).alias("post_id"), F.concat_ws("\n", *lines).alias("body"))


def assemble_turns(df: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """A text per conversation: its turns in order, each with its role."""
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    turns = F.sort_array(F.collect_list(F.struct(F.col(order), line.alias("line"))))
    return df.groupBy(key).agg(F.array_join(F.transform(turns, lambda t: t["line"]), "\n").alias("document"), F.count(F.lit(1)).alias("turns"))


def to_events(posts: DataFrame, as_of: Column, sites: DataFrame | None = None, rules: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Event messages of fetched posts: ``raw`` JSON of the declared fields.

    ``posts``: ``site_id``, ``post_url``, ``fit_text``, ``raw_body``, ``language``, ``correlation_id``, ``images`` (structs with
    ``src``), and, where known, the archive's ``s3_text_path`` and ``s3_image_paths``. The post id is found in the address by the
    site's rule (``rules`` adds some). ``sites`` (``site_id``, ``name``: a person writes each) gives the shown names; a site that is not there
    is shown by its id.
    """
    empty = F.array().cast("array<string>")
    has = lambda c: F.col(c) if c in posts.columns else F.lit(None)
    if sites is not None:
        named = sites.select("site_id", F.col("name").alias("_name")).dropDuplicates(["site_id"])
        posts = posts.join(named.hint("merge"), "site_id", "left")
    else:
        posts = posts.withColumn("_name", F.lit(None).cast("string"))
    event = F.struct(
        post_id(F.col("site_id"), F.col("post_url"), rules).alias("post_id"),
        F.col("site_id").alias("source_id"),
        F.coalesce("_name", "site_id").alias("site_name"),
        pick_body(F.col("fit_text"), F.col("raw_body")).alias("raw_text"),
        language_code(F.col("language")).alias("language"),
        F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("detected_at"),
        "correlation_id",
        F.coalesce(F.transform("images", lambda i: i["src"]), empty).alias("image_urls"),
        F.coalesce(has("s3_text_path"), F.lit("")).alias("s3_text_path"),
        F.coalesce(has("s3_image_paths").cast("array<string>"), empty).alias("s3_image_paths"),
        F.coalesce("post_url", F.lit("")).alias("post_url"),
    )
    return posts.select(F.to_json(event).alias("raw"))


def merge_search_results(df: DataFrame, most: int, key: str = "full_name") -> DataFrame:
    """Results of several queries: first occurrence of each name by (query_no, rank), in that order, at most ``most``."""
    w = Window.partitionBy(key).orderBy("query_no", "rank")
    one = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")
    return one.orderBy("query_no", "rank", key).limit(most)

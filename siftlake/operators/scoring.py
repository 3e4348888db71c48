"""Scores and priority of listing candidates, made without fetching them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions import fixed
from siftlake.functions.text import compact, contains_any, match_text
from siftlake.session import scratch


def score_candidates(
    df: DataFrame,
    *,
    lexicon: dict[str, tuple[str, ...]] = fixed.LEXICON,
    source_risk: dict[str, int] = fixed.SOURCE_RISK,
    dedicated: tuple[str, ...] = fixed.DEDICATED_SOURCES,
) -> DataFrame:
    """``df`` with ``score``, ``priority_bucket``, ``reasons`` and the parts of the score.

    Needs ``site_id, board_url, title, keyword_matched, has_title_keywords``. The text of site, board and
    title is normalised once. Nulls count as empty or false.
    """
    no = F.lit(False)
    df = df.withColumn("_m", match_text(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("site_id", "board_url", "title")])))
    df = df.withColumn("_c", compact(F.col("_m")))
    df = df.withColumns({f"_{k}": contains_any(F.col("_m"), F.col("_c"), terms) for k, terms in lexicon.items()})

    def points(c: Column, n: int) -> Column:
        return F.when(c, n).otherwise(0)

    risk_map = F.create_map(*[F.lit(x) for kv in source_risk.items() for x in kv]) if source_risk else None
    risk = F.coalesce(risk_map[F.col("site_id")], F.lit(4)) if risk_map is not None else F.lit(4)
    keyword = F.coalesce("keyword_matched", no)
    signal = F.col("_high_risk") | F.col("_contact") | F.col("_download")
    dedicated_hit = F.coalesce(F.col("site_id").isin(*dedicated), no) & signal
    context = F.col("_context") & (keyword | signal)
    explore = F.coalesce("has_title_keywords", no) & ~keyword
    df = df.withColumns(
        {
            "source_risk": risk,
            "keyword_signal": points(keyword, 25) + points(F.col("_high_risk"), 30),
            "contact_signal": points(F.col("_contact"), 20),
            "download_signal": points(F.col("_download"), 20),
            "game_signal": points(F.col("_game"), 10),
            "exploration_bonus": points(explore, 6),
        }
    )
    rest = points(dedicated_hit, 6) + points(context, 8) - points(F.col("_low_intent"), 15)
    parts = ("source_risk", "keyword_signal", "contact_signal", "download_signal", "game_signal", "exploration_bonus")
    df = df.withColumn("score", F.greatest(sum((F.col(p) for p in parts), rest), F.lit(0)))
    reasons = [
        F.when(risk >= 10, F.concat(F.lit("source_risk:"), F.col("site_id"))),
        F.when(keyword, "title_keyword_match"),
        F.when(F.col("_high_risk"), "high_risk_term"),
        F.when(F.col("_contact"), "contact_or_sales_term"),
        F.when(F.col("_download"), "download_or_file_term"),
        F.when(F.col("_game"), "game_term"),
        F.when(dedicated_hit, "dedicated_nc_context"),
        F.when(context, "context_term"),
        F.when(explore, "title_unmatched_sampling_candidate"),
        F.when(F.col("_low_intent"), "low_distribution_intent"),
    ]
    strong = points(F.col("keyword_signal") > 0, 1) + points(F.col("_contact"), 1) + points(F.col("_download"), 1)
    vetoed = F.col("_low_intent") & ~(F.col("_contact") | F.col("_download"))
    bucket = (
        F.when((F.col("score") >= 70) & (strong >= 2), "P0")
        .when((F.col("score") >= 45) & (strong >= 2), "P1")
        .when((F.col("score") >= 25) & signal & ~vetoed, "P2")
        .otherwise("P3")
    )
    df = df.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn("priority_bucket", bucket)
    return df.drop("_m", "_c", *[f"_{k}" for k in lexicon])


def candidate_order(keyword: str = "keyword_matched", key: str = "numeric_key", ord_: str = "ord") -> list[Column]:
    """Keyword matches first, then the larger key, ties as they came."""
    return [F.desc(keyword), F.desc(key), F.asc(ord_)]


def placed(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``place``, from 1, in a stated order over all rows.

    A range sort, written out, numbers the rows of each partition; what came before is a sum over one row a partition.
    """
    spark, bits = df.sparkSession, 33  # monotonically_increasing_id: partition and number in it
    path = scratch(spark, "placed")
    df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_part", F.shiftright("_id", bits))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND((1 << bits) - 1) + 1
    return rows.join(F.broadcast(before), "_part").withColumn("place", place).drop("_id", "_part", "_before")

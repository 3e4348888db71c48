"""Distributions, trends, funnels, health, agreement and cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions import fixed
from siftlake.operators.rules import tier_of
from siftlake.operators.selection import ranges_of
from siftlake.session import stored


def qualified(df: DataFrame, least: float = 0.70) -> DataFrame:
    return df.where(F.col("is_illegal") & (F.col("confidence") >= least) & ~F.isnan("confidence"))


def last_days(df: DataFrame, as_of: str, days: int | None, at: str = "detected_at") -> DataFrame:
    """Rows of the last ``days`` days, ``as_of``'s own included; all if None."""
    if days is None:
        return df
    day = F.to_date(F.lit(as_of))
    return df.where((F.col(at) >= F.date_sub(day, days - 1)) & (F.col(at) < F.date_add(day, 1)))


def today_and_delta(df: DataFrame, as_of: str, at: str = "detected_at") -> DataFrame:
    day = F.to_date(F.lit(as_of))
    counts = df.agg(F.count_if(F.to_date(at) == day).alias("today"), F.count_if(F.to_date(at) == F.date_sub(day, 1)).alias("yesterday"))
    return counts.select("today", (F.col("today") - F.col("yesterday")).alias("delta"))


def distribution(df: DataFrame, by: str) -> DataFrame:
    """``by`` and ``n``, nulls out, most first."""
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by)


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """Several distributions in one scan: ``dimension``, ``value``, ``n``."""
    sets = df.groupingSets([[c] for c in columns], *columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    full = (1 << len(columns)) - 1
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, c in enumerate(columns):
        own = F.col("_g") == (full ^ (1 << (len(columns) - 1 - k)))
        dimension, value = F.when(own, c).otherwise(dimension), F.when(own, F.col(c).cast("string")).otherwise(value)
    return sets.select(dimension.alias("dimension"), value.alias("value"), "n").where(F.col("value").isNotNull())


def daily_trend(df: DataFrame, as_of: str, days: int | None, at: str = "detected_at") -> DataFrame:
    """``day`` and ``n`` for each of the last ``days`` days, zero where there is nothing; no rows for None."""
    spark = df.sparkSession
    n = days or 0
    calendar = spark.range(n).select(F.date_sub(F.to_date(F.lit(as_of)), F.col("id").cast("int")).alias("day"))
    counts = last_days(df, as_of, n, at).groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return calendar.join(counts.hint("merge"), "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy("day")


def source_health(sources: DataFrame, posts: DataFrame, runs: DataFrame) -> DataFrame:
    """Every source or run summary: latest crawl (or null) and the run's counters (or 0), by site.

    A run row with a blank site takes the end of its ``run_key`` after the last colon.
    """
    latest = posts.groupBy("site_name").agg(F.max("crawled_at").alias("last_ingest"))
    known = sources.select("site_name").join(latest, "site_name", "left")
    site = F.coalesce(F.nullif(F.trim("site_name"), F.lit("")), F.element_at(F.split("run_key", ":"), -1))
    run = runs.withColumn("site_name", site)
    counters = [c for c in ("fetched", "queued", "validator_skipped", "failed") if c in runs.columns]
    return known.join(run.select("site_name", "last_checked_at", *counters), "site_name", "full").select(
        "site_name", "last_ingest", "last_checked_at", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counters]
    ).orderBy("site_name")


def stats_bundle(detections: DataFrame, sources: DataFrame, posts: DataFrame, runs: DataFrame, as_of: str, days: int | str | None = None) -> dict[str, DataFrame]:
    """All figures of the overview by name. ``days``: 1 to 365, ``weekly``, ``monthly`` or None."""
    days = {"weekly": 7, "monthly": 30}.get(days, days) if isinstance(days, str) else days
    if days is not None and (not isinstance(days, int) or not 1 <= days <= 365):
        raise ValueError("days must be 1 to 365, weekly or monthly")
    base = qualified(detections)
    part = last_days(base, as_of, days)
    return {
        "today": today_and_delta(base, as_of),
        "distributions": distributions(part, ["type", "site_name", "language"]),
        "trend": daily_trend(base, as_of, days),
        "sources": source_health(sources, posts, runs),
    }


def hotspots(df: DataFrame, *, top: int = 6, sample_rows: int | None = 100) -> DataFrame:
    """Illegal detections by type and site: count, largest confidence, most severe tier. From the newest rows, or all of them."""
    if sample_rows is not None:
        df = df.orderBy(F.desc("detected_at"), F.desc("id")).limit(sample_rows)
    groups = df.where("is_illegal").groupBy("type", "site_name").agg(
        F.count(F.lit(1)).alias("n"), F.max("confidence").alias("max_confidence"), F.min("tier").alias("top_tier")
    )
    return groups.orderBy("top_tier", F.desc("n"), F.desc("max_confidence"), "site_name", "type").limit(top)


def inventory_summary(df: DataFrame, by: str = "site_id") -> DataFrame:
    """Counts by source and, with a null source, in all."""
    buckets = [F.count_if(F.col("priority_bucket") == b).alias(b.lower()) for b in ("P0", "P1", "P2", "P3")]
    return df.rollup(by).agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if("selected").alias("selected"), F.count_if("keyword_matched").alias("keyword"), *buckets
    ).orderBy(F.desc("discovered"), F.asc_nulls_first(by))


def probe_groups(df: DataFrame, columns: list[str]) -> DataFrame:
    """Totals and rates by each of several columns in one scan: ``dimension``, ``value`` (``—`` for null), counts, rates."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in columns})
    real = F.coalesce("is_real", F.lit(False))
    parts = filled.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in columns])).alias("d"), real.alias("r"), "signal_count", "ok")
    groups = parts.groupBy("d.dimension", "d.value").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("r").alias("real"), F.count_if(F.col("signal_count") > 0).alias("with_signal"), F.count_if(~F.col("ok")).alias("errors")
    )
    return groups.withColumns({f"{c}_rate": F.round(F.col(c) / F.col("total"), 6) for c in ("real", "with_signal", "errors")})


def signal_breakdown(df: DataFrame, column: str = "signals") -> DataFrame:
    """Documents and hits by signal family."""
    return df.select(F.explode(column).alias("family", "hits")).groupBy("family").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("hits")).alias("hits"))


def placed_values(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Distinct values ``v`` of each group with ``upto``, how many rows of the group have that value or less, and ``n``, its rows.

    The input is read once, to count values. The distinct values of all groups are dealt into ranges by approximate quantiles
    and ranked within each group and range, so no task holds a whole group; the ranges' offsets are at most 64 rows a group.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    counts = stored(counts, "value-counts")
    counts = counts.withColumn("_b", ranges_of(counts, "v"))
    sums = counts.groupBy(*by, "_b").agg(F.sum("c").alias("_s"))  # at most 64 rows a group
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranges = sums.select(*by, "_b", (F.sum("_s").over(group.orderBy("_b")) - F.col("_s")).alias("_before"), F.sum("_s").over(group).alias("n"))
    within = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*by, "_b").orderBy("v"))).alias("w")
    same = reduce(lambda a, b: a & b, [F.col(f"w.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, "_b")])
    joined = within.join(ranges.alias("r").hint("merge"), same)
    return joined.select(*[F.col(f"w.{c}") for c in by], "v", (F.col("upto") + F.col("_before")).alias("upto"), "n")


def value_at(rank: Column) -> Column:
    """The value that stands at a rank (from 1) of a group of ``placed_values``; an aggregate."""
    return F.min(F.when(F.col("upto") >= rank, F.col("v")))


def latency_summary(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Count, median (whole part), 95th of a hundred (value number min(n, floor(0.95 n) + 1)) and maximum, exactly. See ``latency_sketches`` for estimates."""
    by = by or []
    rank95 = F.least(F.col("n"), F.floor(F.col("n") * 0.95) + 1)
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    return placed_values(df, column, by).groupBy(*by).agg(
        F.max("n").alias("n"),
        F.floor((value_at(low) + value_at(high)) / 2).cast("long").alias("median"),
        value_at(rank95).alias("p95"),
        F.max("v").alias("maximum"),
    )


def latency_sketches(df: DataFrame, at: str, value: str, width: str = "5 minutes", k: int = 400) -> DataFrame:
    """``window_start``, ``n`` and ``sketch`` of each window: a KLL sketch of some KB, which can be stored and merged into longer windows."""
    return df.where(F.col(value).isNotNull()).groupBy(F.window(at, width).start.alias("window_start")).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch")
    )


def sketched_quantiles(sketches: DataFrame, width: str, quantiles: tuple[float, ...] = (0.5, 0.95), k: int = 400) -> DataFrame:
    """``window_start``, ``n`` and estimates ``p50``, ``p95``, ... of longer windows, from stored sketches; the values are not read again.

    With ``k`` of 400 the rank of an estimate is off by 0.7 % of a window's rows, at 99 % confidence.
    """
    merged = sketches.groupBy(F.window("window_start", width).start.alias("w")).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("s"))
    return merged.select(F.col("w").alias("window_start"), "n", *[F.kll_sketch_get_quantile_double("s", F.lit(q)).alias(f"p{round(100 * q):02d}") for q in quantiles])


def depth_by_status(df: DataFrame, statuses: tuple[str, ...] = ("pending", "processing", "dead_letter", "corrupt")) -> DataFrame:
    """Rows by status, 0 where there are none."""
    all_ = df.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    counts = df.groupBy("status").agg(F.count(F.lit(1)).alias("depth"))
    return F.broadcast(all_).join(counts, "status", "left").select("status", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def window_p95(df: DataFrame, at: str, value: str, width: str = "5 minutes") -> DataFrame:
    """The 95th of a hundred of each window, between two values by linear interpolation, exactly; no task holds a whole window.

    A window without values has a count of 0 and no quantile.
    """
    rows = df.select(F.window(at, width).start.alias("window_start"), value)
    every = rows.groupBy("window_start").agg(F.count(value).alias("n"))
    place = (F.col("n") - 1) * 0.95
    low, share = F.floor(place), place - F.floor(place)
    found = placed_values(rows, value, ["window_start"]).groupBy("window_start").agg(
        value_at(low + 1).alias("a"), value_at(F.least(low + 2, F.col("n"))).alias("b"), F.max(share).alias("s")
    )
    return every.join(found.hint("merge"), "window_start", "left").select("window_start", (F.col("a") + (F.col("b") - F.col("a")) * F.col("s")).alias("p95"), "n")


FUNNEL = ("seen_in_run", "seen_before", "fetch_failed", "empty", "sticky", "blocked", "unknown", "duplicate_body", "enqueued")


def funnel(df: DataFrame, by: str = "site_name") -> DataFrame:
    """Counts of dispositions by site and, with a null site, in all; skipped ones summed."""
    counts = [F.count_if(F.col("disposition") == d).alias(d) for d in FUNNEL]
    made = df.rollup(by).agg(F.count(F.lit(1)).alias("selected"), *counts)
    return made.withColumn("validator_skipped", F.col("empty") + F.col("sticky") + F.col("blocked") + F.col("unknown"))


#: Counters of the listings of a run, and of one family of sites whose counts are kept apart.
LISTING = ("boards", "discovered", "keyword_matched", "keyword_unmatched", "selected", "selected_p0", "selected_p1", "selected_p2", "selected_p3")


def crawl_funnel(candidates: DataFrame, posts: DataFrame, *, by: str = "site_name", apart: str | None = None, searches: DataFrame | None = None) -> DataFrame:
    """All counters of a run by site and, with a null site, in all.

    ``candidates``: ``by``, ``board_url``, ``keyword_matched``, ``priority_bucket``, ``selected``. ``posts``: ``by`` and
    ``disposition``. Counted are boards, candidates found, with and without a keyword, selected and those by bucket;
    posts attempted (not seen before), each disposition, and the skipped ones in sum. ``apart`` names a family (by
    ``rules.site_family`` or the site itself): its candidates and posts are counted in columns of their own too.
    A site with candidates or posts only has zeros for the others. ``searches``, a row of ``by`` for each search that was made for the
    family, adds ``apart_searches``.
    """
    c = F.col("priority_bucket")
    picked = F.coalesce("selected", F.lit(False))
    found = F.coalesce("keyword_matched", F.lit(False))
    mine = lambda: (F.col(by) == apart) if apart else F.lit(False)
    listed = candidates.rollup(by).agg(
        F.count_distinct("board_url").alias("boards"), F.count(F.lit(1)).alias("discovered"), F.count_if(found).alias("keyword_matched"), F.count_if(~found).alias("keyword_unmatched"),
        F.count_if(picked).alias("selected"), *[F.count_if(picked & (c == f"P{k}")).alias(f"selected_p{k}") for k in range(4)],
        F.count_if(mine()).alias("apart_discovered"), F.count_if(mine() & picked).alias("apart_selected"), F.grouping_id().alias("_g"),
    )
    is_ = lambda *d: F.coalesce(F.col("disposition").isin(*d), F.lit(False))
    made = posts.rollup(by).agg(
        F.count_if(~is_("seen_in_run", "seen_before")).alias("attempted"),
        *[F.count_if(is_(d)).alias(d) for d in FUNNEL],
        F.count_if(is_("empty", "sticky", "blocked", "unknown")).alias("validator_skipped"),
        F.count_if(mine() & is_("enqueued")).alias("apart_enqueued"), F.count_if(mine() & is_("seen_in_run", "seen_before")).alias("apart_seen"),
        F.count_if(mine() & is_("duplicate_body")).alias("apart_duplicates"), F.count_if(mine() & is_("fetch_failed")).alias("apart_failed"), F.grouping_id().alias("_g"),
    )
    parts = [listed, made]
    if searches is not None:
        parts.append(searches.rollup(by).agg(F.count_if(mine()).alias("apart_searches"), F.grouping_id().alias("_g")))
    names = [n for part in parts for n in part.columns if n not in (by, "_g")]
    zero = lambda c, n: (F.col(n) if n in c.columns else F.lit(None)).cast("long").alias(n)
    rows = reduce(DataFrame.unionByName, [part.select(by, "_g", *[zero(part, n) for n in names]) for part in parts])  # a row a site each
    return rows.groupBy("_g", by).agg(*[F.coalesce(F.max(n), F.lit(0)).alias(n) for n in names]).drop("_g")


def funnel_total(families: list[DataFrame]) -> DataFrame:
    """Funnels of several families in one row: enqueued by family, duplicates and skipped in sum."""
    both = None
    for k, f in enumerate(families):
        part = f.select(F.lit(k).alias("family"), "disposition")
        both = part if both is None else both.unionByName(part)
    hit = lambda *d: F.col("disposition").isin(*d)
    return both.agg(
        F.count_if(hit("seen_in_run", "seen_before", "duplicate_body")).alias("duplicates"),
        F.count_if(hit("empty", "sticky", "blocked", "unknown")).alias("skipped"),
        *[F.count_if(hit("enqueued") & (F.col("family") == k)).alias(f"enqueued_{k}") for k in range(len(families))],
    )


def label_agreement(df: DataFrame, *, label: str, predicted: str, by: list[str]) -> DataFrame:
    """Labelled rows by each column and in all: total, judgeable (label not ``unknown``), agreeing, rate (0 if none)."""
    known = F.col(label) != "unknown"
    parts = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in by])
    rows = df.where(F.col(label).isNotNull()).select(F.explode(parts).alias("d"), known.alias("k"), (known & (F.col(label) == F.col(predicted))).alias("a"))
    made = rows.groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("total"), F.count_if("k").alias("judgeable"), F.count_if("a").alias("agree"))
    return made.withColumn("rate", F.coalesce(F.try_divide("agree", "judgeable"), F.lit(0.0)))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def tier_accuracy(df: DataFrame, *, truth: str = "type", predicted: str = "predicted_type", failed: Column | None = None) -> DataFrame:
    """``tier``, ``total``, ``correct`` and ``rate`` by the tier of the true type, over rows that did not fail.

    Labels of the older set are read as their newer types, a blank or null one as the type of clean posts.
    """
    tier = lambda c: tier_of(newer_type(F.col(c)))
    rows = df.where(~F.coalesce(failed, F.lit(False))) if failed is not None else df
    got = rows.select(tier(truth).alias("tier"), (tier(truth) == tier(predicted)).alias("_c"))
    return got.groupBy("tier").agg(F.count(F.lit(1)).alias("total"), F.count_if("_c").alias("correct")).withColumn("rate", F.col("correct") / F.col("total"))


def newer_type(type_: Column) -> Column:
    """The type of the present set for a label of the older one."""
    name = F.coalesce(F.trim(type_), F.lit(""))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in fixed.OLD_TYPES.items() for x in kv])[name], name)


def binary_quality(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """Recall, specificity and accuracy; null where nothing is to be judged."""
    good = F.count_if(truth & predicted), F.count_if(truth), F.count_if(~truth & ~predicted), F.count_if(~truth)
    return df.agg(
        F.try_divide(good[0], good[1]).alias("recall"), F.try_divide(good[2], good[3]).alias("specificity"), F.try_divide(good[0] + good[2], good[1] + good[3]).alias("accuracy")
    )


def cost_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.sum("cost_usd").alias("total_usd"), F.avg("cost_usd").alias("mean_usd"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def daily_cost(df: DataFrame, day: Column, micro: str) -> DataFrame:
    return df.groupBy(day.alias("day")).agg(F.sum(micro).alias("micro_usd"))


def stage_rollup(df: DataFrame) -> DataFrame:
    return df.groupBy("stage", "model").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"), F.avg("latency_ms").alias("mean_latency_ms")
    )


LINKS_SCHEMA = "struct<extracted:array<string>,links:array<struct<url:string,kind:string,is_distribution_site:boolean>>>"


def link_risk(runs: DataFrame, output: str = "output") -> DataFrame:
    """By detection: links extracted, checked and risky, from the JSON of its traces; unreadable JSON counts as none."""
    o = F.from_json(output, LINKS_SCHEMA)
    none = F.array()
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    links = o.getField("links")
    risky = F.filter(F.coalesce(links, none.cast("array<struct<url:string,kind:string,is_distribution_site:boolean>>")), lambda x: F.coalesce(x["is_distribution_site"], F.lit(False)))
    per = runs.select("detection_id", F.greatest(size(o.getField("extracted")), F.lit(0)).alias("e"), F.greatest(size(links), F.lit(0)).alias("c"), F.size(risky).alias("r"))
    return per.groupBy("detection_id").agg(F.sum("e").alias("extracted"), F.sum("c").alias("checked"), F.sum("r").alias("risky"))


def error_reasons(df: DataFrame, reason: str, by: str) -> DataFrame:
    """Counts of error reasons by site and, with a null site, in all."""
    return df.where(F.col(reason).isNotNull()).groupingSets([[reason, by], [reason]], reason, by).agg(F.count(F.lit(1)).alias("n"))

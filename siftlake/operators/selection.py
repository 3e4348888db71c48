"""Quotas, samples, top-k, running totals, pages and work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.session import stored

#: Ranges that an order is cut into.
RANGES = 64


def ranges_of(df: DataFrame, column: str) -> Column:
    """The number of the range that a row's value is in: ranges of about equal size, from approximate quantiles. Null is in the first."""
    number = F.col(column).cast("double") if dict(df.dtypes)[column] not in ("timestamp", "timestamp_ntz") else F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    cuts = sorted(set(df.select(number.alias("x")).approxQuantile("x", [k / RANGES for k in range(1, RANGES)], 0.005)))

    def found(low: int, high: int) -> Column:
        """How many cuts lie below the value, between ``low`` and ``high``: a binary search."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(number > cuts[middle], found(middle + 1, high)).otherwise(found(low, middle))

    return found(0, len(cuts))


def negated(key: Column) -> Column:
    return F.transform(key, lambda x: -x)


def priority_budget(df: DataFrame, *, board: str = "board_url", caps: Column | None = None, cap: int = 2, limit: int = 50, enabled: bool = True) -> DataFrame:
    """Selected candidates of each board with their ``selection_rank``.

    All but P3 come first by score; then P3, keyword matches first, at most ``caps`` (a column, else ``cap``) of
    each board; then the board's ``limit``. Ties: ascending on the negated key, then address. Switched off:
    the first ``limit`` by order of arrival (``ord``).
    """
    if not enabled:
        w = Window.partitionBy(board).orderBy("ord", "url")
        return df.withColumn("selection_rank", F.row_number().over(w)).where(F.col("selection_rank") <= limit)
    p3 = F.col("priority_bucket") == "P3"
    keyword = F.when(p3, F.coalesce("keyword_matched", F.lit(False)).cast("int")).otherwise(0)
    order = [F.desc(keyword), F.desc("score"), negated(F.col("numeric_key")).asc(), F.asc("url")]
    ranked = df.withColumn("_q", F.row_number().over(Window.partitionBy(board, p3).orderBy(*order)))
    kept = ranked.where(~p3 | (F.col("_q") <= (caps if caps is not None else F.lit(cap))))
    w = Window.partitionBy(board).orderBy(p3.asc(), F.asc("_q"))
    return kept.withColumn("selection_rank", F.row_number().over(w)).where(F.col("selection_rank") <= limit).drop("_q")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order (``dropDuplicates`` does not promise which)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def probe_sample(df: DataFrame, *, p2: int = 80, quota: Column | None = None, p3: int = 2) -> DataFrame:
    """Probe rows with their ``sample_reason``: the best P2 of all sources, then P3 up to a quota of each source."""
    one = first_per_key(df, ["url"], [F.asc("ord")])
    best = one.where(F.col("priority_bucket") == "P2").orderBy(F.desc("score"), "site_id", "url").limit(p2).withColumn("sample_reason", F.lit("p2_top"))
    w = Window.partitionBy("site_id").orderBy(F.desc("selected"), F.desc("score"), "url")
    rest = one.where(F.col("priority_bucket") == "P3").withColumn("_n", F.row_number().over(w))
    rest = rest.where(F.col("_n") <= (quota if quota is not None else F.lit(p3))).drop("_n")
    reason = F.when(F.col("selected"), "p3_selected").otherwise("p3_sample")
    return best.unionByName(rest.withColumn("sample_reason", reason))


def stratified_sample(df: DataFrame, *, n: int, stratum: str, clean: str, id_col: str, seed: int) -> DataFrame:
    """``n`` rows: half from the strata other than ``clean``, spread evenly (at least one each, shortfall filled), the rest clean.

    The order within a stratum is a seeded hash of the id, so the sample is exact and repeatable.
    """
    df = df.withColumn("_h", F.sha2(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")), 256))
    marked = df.where(F.col(stratum) != clean)
    half = n // 2
    types = max(1, marked.select(stratum).distinct().count())
    each = max(1, half // types)
    per = marked.withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", id_col)))
    first = per.withColumn("_late", (F.col("_n") > each).cast("int")).orderBy("_late", "_h", id_col).limit(half).drop("_n", "_late")
    rest = df.where(F.col(stratum) == clean).orderBy("_h", id_col).limit(n - half)
    return first.unionByName(rest).drop("_h")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    if n < 1:
        raise ValueError("n must be at least 1")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def spend_cap(df: DataFrame, *, day: str, order: list[str], micro: str, cap: int) -> DataFrame:
    """``spent_before`` within the day and ``admitted`` (spent before is below the cap; a cap of 0 admits all).

    ``order`` starts with a number or a time and is unique in a day. Each day is cut into ranges of it: sums of the
    ranges, a row each, give what was spent before a range, so that no task holds a whole day. The input is read once, and stored.
    """
    part = "_range"
    df = stored(df, "spend")
    ranged = df.withColumn(part, ranges_of(df, order[0]))
    sums = ranged.groupBy(day, part).agg(F.sum(micro).alias("_s"))  # days x RANGES rows
    offsets = sums.withColumn("_offset", F.sum("_s").over(Window.partitionBy(day).orderBy(part)) - F.coalesce("_s", F.lit(0))).drop("_s")
    w = Window.partitionBy(day, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("_within", F.coalesce(F.sum(micro).over(w), F.lit(0)))
    joined = within.join(offsets.hint("merge"), (within[day].eqNullSafe(offsets[day])) & (within[part] == offsets[part]), "left").drop(offsets[day], offsets[part])
    before = (F.col("_within") + F.coalesce("_offset", F.lit(0))).cast("bigint")
    return joined.withColumn("spent_before", before).withColumn("admitted", (F.lit(cap) == 0) | (F.col("spent_before") < cap)).drop(part, "_within", "_offset")


def latest_per_key(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The latest row of each key, ties to the larger ``tie``: a combining aggregate, no window."""
    rest = [c for c in df.columns if c not in keys]
    made = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_r"))
    return made.select(*keys, "_r.*")


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """A page (from 0) by time and id, newest first. For deep pages use ``page_after``."""
    if not 1 <= size <= 100 or number < 0:
        raise ValueError("size must be 1 to 100 and number at least 0")
    return df.orderBy(F.desc("detected_at"), F.desc("id")).offset(number * size).limit(size)


def page_after(df: DataFrame, at: Column, id_: int, size: int) -> DataFrame:
    """The rows after a row of the page before: a filter in place of an offset."""
    after = (F.col("detected_at") < at) | ((F.col("detected_at") == at) & (F.col("id") < id_))
    return df.where(after).orderBy(F.desc("detected_at"), F.desc("id")).limit(size)


def most_recent(df: DataFrame, at: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(at), F.desc(tie)).limit(n)


def unlabelled(df: DataFrame, *, label: str = "human_label", sites: DataFrame | None = None, tier: str | None = None, limit: int = 50) -> DataFrame:
    """Newest detections without a label, of some sites (semi join) and a tier if given."""
    df = df.where(F.col(label).isNull())
    if sites is not None:
        df = df.join(sites, "site_name", "left_semi")
    if tier:
        df = df.where(F.col("tier") == tier)
    return df.orderBy(F.desc("detected_at"), F.desc("id")).limit(limit)


def claimable(outbox: DataFrame, as_of: Column, *, stale: str = "5 minutes", most_attempts: int = 3, limit: int = 50) -> DataFrame:
    """Events to take on: pending, or in work with a stale claim; attempts left; oldest first."""
    number, unit = stale.split()
    old = F.col("claimed_at") < as_of - F.make_dt_interval(mins=F.lit(int(number))) if unit.startswith("min") else F.col("claimed_at") < as_of
    open_ = (F.col("status") == "PENDING") | ((F.col("status") == "PROCESSING") & old)
    return outbox.where(open_ & (F.col("attempts") < most_attempts)).orderBy("created_at", "id").limit(limit)


def trace_of(runs: DataFrame, detections: DataFrame, detection_id: int) -> DataFrame:
    """The traces of a detection in order; an error if there is no such detection."""
    if detections.where(F.col("id") == detection_id).isEmpty():
        raise LookupError(f"no detection {detection_id}")
    return runs.where(F.col("detection_id") == detection_id).orderBy("created_at", "stage")


def problem_samples(df: DataFrame, *, order: list[str], kind: str = "kind", n: int = 12) -> DataFrame:
    """The first ``n`` rows, in a stated order, that are no real posts."""
    return df.where(F.coalesce(F.col(kind), F.lit("")) != "real").orderBy(*order).limit(n)


def top_signal_samples(df: DataFrame, *, tie: str, count: str = "signal_count", site: str = "site_id", n: int = 12) -> DataFrame:
    """The ``n`` rows of most signals, then by site and ``tie``; rows without a signal are none."""
    return df.where(F.col(count) > 0).orderBy(F.desc(count), F.coalesce(site, F.lit("")), tie).limit(n)

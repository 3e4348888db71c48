"""Filters, rules and classifications over posts and detections."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions import fixed
from siftlake.functions.text import any_marker, strip
from siftlake.session import stored


def detection_filter(
    df: DataFrame,
    *,
    least_confidence: float = 0.70,
    since: Column | None = None,
    until: Column | None = None,
    site: str | None = None,
    type_: str | None = None,
    language: str | None = None,
    tier: str | None = None,
    date: str | None = None,
    range_: str | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """Illegal detections of enough confidence; a blank or unset option adds no filter. ``since`` is inclusive, ``until`` not.

    ``range_`` (such as ``7d``, counted back from ``as_of``) and ``date`` (a UTC day, ``yyyy-mm-dd``) set both ends; a
    date overrides a range. Filters are added only when set, so that they reach the scan. NaN confidence is out.
    """
    if date and date.strip():
        day = datetime.date.fromisoformat(date.strip())
        since, until = (F.lit(f"{d} 00:00:00").cast("timestamp_ntz") for d in (day, day + datetime.timedelta(days=1)))
    elif range_ and range_.strip():
        since, until = as_of - F.make_dt_interval(F.lit(range_days(range_))), None
    df = df.where((F.col("confidence") >= least_confidence) & ~F.isnan("confidence") & F.col("is_illegal"))
    if since is not None:
        df = df.where(F.col("detected_at") >= since)
    if until is not None:
        df = df.where(F.col("detected_at") < until)
    for name, value in (("site_name", site), ("type", type_), ("language", language), ("tier", tier)):
        if value and value.strip():
            df = df.where(F.col(name) == value)
    return df


def range_days(range_: str) -> int:
    """Days of a range such as ``7d``, 1 to 365."""
    text = range_.strip().lower()
    if not (text.endswith("d") and text[:-1].isdigit() and 1 <= int(text[:-1]) <= 365):
        raise ValueError(f"range must be 1d to 365d, not {range_!r}")
    return int(text[:-1])


def site_family(site: Column) -> Column:
    """The rule family of a site: by name, else by the first prefix, else none."""
    named = F.create_map(*[F.lit(x) for kv in fixed.SITE_FAMILIES.items() for x in kv])[site]
    by_prefix = F.lit(None).cast("string")
    for prefix, family in reversed(fixed.SITE_PREFIXES):
        by_prefix = F.when(F.startswith(site, F.lit(prefix)), family).otherwise(by_prefix)
    return F.coalesce(named, by_prefix)


def _rule_holds(body: Column, where: str, how: str, markers: tuple[str, ...]) -> Column:
    part = body if where == "all" else F.substring(body, 1, int(where))
    if how == "always":
        return F.lit(True)
    if how == "any":
        return any_marker(part, markers)
    each = reduce(lambda a, b: a & b, [F.contains(part, F.lit(m)) for m in markers])
    if how == "not_each":
        return ~each
    return each & (F.length(body) < 500)


def content_kind(body: Column, family: Column | None = None, least: int = 50) -> Column:
    """Kind of a fetched page: ``empty, short, captcha, auth_wall, error, sticky, real`` or ``unknown``.

    General guards come first, then the rules of the family in their order; a family whose rules all
    fail is ``unknown``, no family is ``real``. A null body is empty.
    """
    body = F.coalesce(body, F.lit(""))
    text = strip(body)
    kind = (
        F.when(text == "", "empty")
        .when(F.length(text) < least, "short")
        .when(any_marker(text, fixed.CAPTCHA_MARKERS), "captcha")
        .when(any_marker(text, fixed.AUTH_WALL_MARKERS), "auth_wall")
        .when(any_marker(text, fixed.ERROR_MARKERS), "error")
    )
    if family is None:
        return kind.otherwise("real")
    for name, _, made, where, how, markers in sorted(fixed.SITE_RULES, key=lambda r: (r[0], r[1])):
        kind = kind.when((family == name) & _rule_holds(body, where, how, markers), made)
    return kind.when(family.isNull(), "real").otherwise("unknown")


def _first_marker(text: Column, markers: tuple[str, ...]) -> Column:
    """The first of the markers, in their order, that the text holds."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(m)), F.lit(m)) for m in markers])


def content_validation(body: Column, family: Column | None = None, least: int = 50) -> Column:
    """``kind`` (see ``content_kind``) and ``reason``: what decided it - the length, the marker found, or the family's rules.

    The kind is bound once, as the variable of a function over an array of one, so that the plan does not copy it.
    """

    def explained(kind: Column) -> Column:
        text = strip(F.coalesce(body, F.lit("")))
        quoted = lambda m: F.concat(F.lit("marker: "), m)
        reason = (
            F.when(kind == "empty", "empty body")
            .when(kind == "short", F.concat(F.lit("body of "), F.length(text).cast("string"), F.lit(f" characters, least {least}")))
            .when(kind == "captcha", quoted(_first_marker(text, fixed.CAPTCHA_MARKERS)))
            .when(kind == "auth_wall", quoted(F.coalesce(_first_marker(text, fixed.AUTH_WALL_MARKERS), F.lit("by the rules of the site"))))
            .when(kind == "error", quoted(F.coalesce(_first_marker(text, fixed.ERROR_MARKERS), F.lit("by the rules of the site"))))
            .when(kind == "sticky", "notice by the rules of the site")
            .when(kind == "unknown", "no mark of a post by the rules of the site")
            .otherwise("")
        )
        return F.struct(kind.alias("kind"), reason.alias("reason"))

    return F.element_at(F.transform(F.array(content_kind(body, family, least)), explained), 1)


#: Counter of each kind of page that is no post.
SKIPPED = {"sticky": "sticky", "auth_wall": "blocked", "captcha": "blocked", "error": "blocked", "empty": "empty", "short": "empty", "unknown": "unknown"}


def skip_reason(kind: Column) -> Column:
    """Counter of a page that is no post; null for a real one. The kind is looked up once."""
    return F.create_map(*[F.lit(x) for kv in SKIPPED.items() for x in kv])[kind]


def disposition(seen_in_run: Column, seen_before: Column, ok: Column, kind: Column, duplicate: Column) -> Column:
    """What became of a candidate: the first of these that holds. Each test is in the plan once, and run only where none before it holds."""
    before = F.when(seen_in_run, "seen_in_run").when(seen_before, "seen_before").when(~F.coalesce(ok, F.lit(False)), "fetch_failed")
    return F.coalesce(before, skip_reason(kind), F.when(duplicate, "duplicate_body"), F.lit("enqueued"))


def split_verdicts(df: DataFrame, types: tuple[str, ...] = fixed.DETECTION_TYPES) -> tuple[DataFrame, DataFrame]:
    """Verdicts of a known type with a confidence from 0 to 1, and the others (NaN and null among them)."""
    c = F.col("confidence")
    good = F.coalesce(F.col("type").isin(*types) & ~F.isnan(c) & c.between(0, 1), F.lit(False))
    return df.where(good), df.where(~good)


def tier_of(type_: Column, tiers: dict[str, str] = fixed.TIER_OF_TYPE) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in tiers.items() for x in kv])[type_], F.lit("T4"))


def is_illegal(tier: Column) -> Column:
    return tier != "T4"


def shown(df: DataFrame, thresholds: dict[str, float] = fixed.TIER_THRESHOLDS) -> DataFrame:
    """Rows whose confidence reaches the threshold of their tier."""
    least = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])[F.col("tier")]
    return df.where(F.col("confidence") >= least)


def fast_path(type_: Column, confidence: Column, n_links: Column) -> Column:
    """Whether a post needs no further look: other type, sure enough, no links."""
    return F.coalesce((type_ == fixed.OTHER_TYPE) & (confidence >= 0.80) & (n_links == 0), F.lit(False))


def merge_verdicts(text: DataFrame, image: DataFrame, key: str = "post_id") -> DataFrame:
    """Text and image verdicts of a post as one: the image's if it was observed; translation text first; tokens and cost summed."""
    t, i = text.alias("t"), image.alias("i")
    seen = F.coalesce(F.col("i.image_observed"), F.lit(False))
    picked = [F.when(seen, F.col(f"i.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in ("type", "confidence", "reason")]
    summed = [(F.coalesce(F.col(f"t.{c}"), F.lit(0)) + F.coalesce(F.col(f"i.{c}"), F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens", "cost_usd")]
    return t.join(i, key).select(key, *picked, F.coalesce("t.translated_text", "i.translated_text").alias("translated_text"), seen.alias("image_observed"), *summed)


def enabled_rules(rules: DataFrame, event_type: str) -> DataFrame:
    return rules.where(F.col("enabled") & F.col("channel_enabled") & (F.col("event_type") == event_type)).orderBy("created_at", "id")


#: Rules of a pack, and packs up to which they are sent to all tasks (about a million rules, 16 MB).
PACK, BROADCAST_PACKS = 512, 2_000


def _placed_rules(rules: DataFrame) -> DataFrame:
    """``id``, ``r_type``, ``r_site``, ``r_tier`` (null, null and 0 for all) and threshold ``t`` of each rule.

    A rule without a threshold has the least there is. A rule whose tier is none of the known ones meets nothing and goes.
    """

    def given(c: str) -> Column:
        return F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "", F.col(c))

    ranks = F.create_map(*[F.lit(x) for k, t in enumerate(fixed.TIERS, 1) for x in (t, k)])
    rank = F.when(given("min_tier").isNull(), 0).otherwise(ranks[F.col("min_tier")])
    threshold = F.coalesce(F.col("min_confidence").cast("double"), F.lit(float("-inf")))
    return rules.select(given("detection_type").alias("r_type"), given("source_site_name").alias("r_site"), rank.alias("r_tier"), threshold.alias("t"), "id").where(F.col("r_tier").isNotNull())


def rule_packs(rules: DataFrame) -> DataFrame:
    """Rules as an index: those of one type, site and tier by threshold, in packs with their least threshold ``low``."""
    rows = _placed_rules(rules)
    key = ["r_type", "r_site", "r_tier"]
    placed = rows.withColumn("pack", F.floor((F.row_number().over(Window.partitionBy(*key).orderBy("t", "id")) - 1) / PACK))
    return placed.groupBy(*key, "pack").agg(F.sort_array(F.collect_list(F.struct("t", "id"))).alias("rules"), F.min("t").alias("low"))


def _asked(detections: DataFrame, index: DataFrame) -> DataFrame:
    """``detection_id``, its confidence ``_c``, and the combinations ``a_type``, ``a_site``, ``a_tier`` of the index that a detection may meet (20 at most)."""
    kinds = index.select(F.col("r_type").isNull(), F.col("r_site").isNull(), "r_tier").distinct().collect()  # at most 20 rows
    ranks = F.create_map(*[F.lit(x) for k, t in enumerate(fixed.TIERS, 1) for x in (t, k)])
    own = detections.select(
        F.col("id").alias("detection_id"), F.col("type").alias("_t"), F.col("site_name").alias("_s"), ranks[F.col("tier")].alias("_r"),
        F.coalesce(F.col("confidence").cast("double"), F.lit(float("-inf"))).alias("_c"),
    )
    null = F.lit(None).cast("string")
    asks = [
        F.when(
            (F.lit(any_type) | F.col("_t").isNotNull()) & (F.lit(any_site) | F.col("_s").isNotNull()) & (F.lit(tier == 0) | F.coalesce(F.col("_r") <= tier, F.lit(False))),
            F.struct((null if any_type else F.col("_t")).alias("a_type"), (null if any_site else F.col("_s")).alias("a_site"), F.lit(tier).alias("a_tier")),
        )
        for any_type, any_site, tier in sorted(map(tuple, kinds))
    ]
    return own.select("detection_id", "_c", F.inline(F.array_compact(F.array(*asks)) if asks else F.array().cast("array<struct<a_type:string,a_site:string,a_tier:int>>")))


def match_rules(detections: DataFrame, rules: DataFrame) -> DataFrame:
    """``detection_id`` and ``rule_id`` of each rule that a detection meets; null or blank fields of a rule match all.

    A detection asks the index for the combinations of type, site and tier that occur among the rules (20 at most): an equi join
    with the packs whose least threshold it reaches, so that a row of the join stands for up to ``PACK`` matches. Packs are broadcast
    behind a count, else joined by a shuffle. ``detections`` may be a stream: it is read once. A null confidence meets
    rules without a threshold, an unknown tier rules without a tier.
    """
    packs = stored(rule_packs(rules), "rule-packs")
    asked = _asked(detections, packs)
    few = packs.count() <= BROADCAST_PACKS
    on = F.col("a_type").eqNullSafe(F.col("r_type")) & F.col("a_site").eqNullSafe(F.col("r_site")) & (F.col("a_tier") == F.col("r_tier")) & (F.col("low") <= F.col("_c"))
    met = asked.join(F.broadcast(packs) if few else packs.hint("merge"), on)
    reached = F.filter("rules", lambda r: r["t"] <= F.col("_c"))
    return met.select("detection_id", F.explode(F.transform(reached, lambda r: r["id"])).alias("rule_id"))


def rule_totals(detections: DataFrame, rules: DataFrame) -> DataFrame:
    """``rule_id``, ``n`` and ``ids`` of each rule that a detection meets: how many ``match_rules`` gives it, and the sum of their ids.

    No pair is made. Detections are summed by the combinations of type, site and tier that they ask for and by confidence, and a
    rule gets the sum of its combination from its threshold on: a running sum within a thousandth of confidence, and the total of
    the higher thousandths. So no combination goes to one task, however many detections ask for it.
    """
    key = ["r_type", "r_site", "r_tier"]
    placed = stored(_placed_rules(rules), "rules")
    asked = _asked(detections, placed).groupBy(F.col("a_type").alias("r_type"), F.col("a_site").alias("r_site"), F.col("a_tier").alias("r_tier"), F.col("_c").alias("t"))
    cells = asked.agg(F.count(F.lit(1)).alias("n"), F.sum("detection_id").alias("ids"))
    none = F.lit(0).cast("long")
    steps = cells.unionByName(placed.select(*key, "t", none.alias("n"), none.alias("ids")).distinct()).groupBy(*key, "t").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))
    # NaN is above all, as in the comparison of a rule with a detection.
    steps = stored(steps.withColumn("part", F.floor(F.least(F.greatest(F.col("t") * 1000, F.lit(-1.0)), F.lit(1001.0))).cast("int")), "confidences")
    higher = Window.partitionBy(*key).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = steps.groupBy(*key, "part").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))
    parts = parts.select(*[F.col(c).alias(f"p_{c}") for c in (*key, "part")], F.coalesce(F.sum("n").over(higher), none).alias("n_above"), F.coalesce(F.sum("ids").over(higher), none).alias("ids_above"))
    within = Window.partitionBy(*key, "part").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    sums = steps.select(*key, "part", "t", F.sum("n").over(within).alias("n"), F.sum("ids").over(within).alias("ids"))
    same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in (*key, "part")]
    whole = sums.join(parts.hint("merge"), reduce(lambda a, b: a & b, same)).select(
        *[F.col(c).alias(f"s_{c}") for c in (*key, "t")], (F.col("n") + F.col("n_above")).alias("n"), (F.col("ids") + F.col("ids_above")).alias("ids")
    )
    met = stored(whole.where("n > 0"), "rule-totals")
    same = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in (*key, "t")]
    return placed.join(met.hint("merge"), reduce(lambda a, b: a & b, same)).groupBy(F.col("id").alias("rule_id")).agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))


def fetch_error_class(error: Column) -> Column:
    """Class of a fetch error by the first of these parts that its text holds."""
    e = F.lower(F.coalesce(error, F.lit("")))
    # Parts of error texts and the names of their classes.
    return (
        F.when(F.contains(e, F.lit("cloudflare js challenge")), "cloudflare_js_challenge")
        .when(F.contains(e, F.lit("http 403")) & F.contains(e, F.lit("html content")), "cloudflare_or_waf_403_html")
        .when(F.contains(e, F.lit("blocked by anti-bot")), "anti_bot_blocked")
        .when(F.contains(e, F.lit("timeout")), "timeout")
        .otherwise("other")
    )


BROADCAST_PRICES = 10_000


def token_cost(usage: DataFrame, prices: DataFrame, fallback: str, overrides: DataFrame | None = None) -> DataFrame:
    """``usage`` (or a stream of it) with ``cost_usd``: tokens times the model's rates per million; an unknown model has the fallback's rates.

    Prices are broadcast up to ``BROADCAST_PRICES`` models, else joined by a shuffle.
    """
    p = prices.select("model", F.col("input").alias("_in"), F.col("output").alias("_out"))
    if overrides is not None:
        o = overrides.select("model", F.col("input").alias("_oin"), F.col("output").alias("_oout"))
        p = p.join(o.hint("merge"), "model", "full").select("model", F.coalesce("_oin", "_in").alias("_in"), F.coalesce("_oout", "_out").alias("_out"))
    base = p.where(F.col("model") == fallback).select(F.struct("_in", "_out")).limit(1)
    row = base.first()
    spare_in, spare_out = (row[0]["_in"], row[0]["_out"]) if row else (0.0, 0.0)
    cost = (F.col("input_tokens") * F.coalesce("_in", F.lit(spare_in)) + F.col("output_tokens") * F.coalesce("_out", F.lit(spare_out))) / 1e6
    side = F.broadcast(p) if p.count() <= BROADCAST_PRICES else p.hint("merge")
    return usage.join(side, "model", "left").withColumn("cost_usd", cost).drop("_in", "_out")


def micro_usd(cost: Column) -> Column:
    """Cost in millionths, half-even, at least 1 if there is any."""
    return F.when(cost > 0, F.greatest(F.lit(1), F.bround(cost * 1e6)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def valid_labels(df: DataFrame, label: str = "human_label") -> DataFrame:
    return df.where(F.col(label).isin(*fixed.DETECTION_TYPES, "unknown"))


def depth_alerts(depths: DataFrame) -> DataFrame:
    """Dead letters waiting, or a depth that could not be read (null)."""
    return depths.where(F.col("depth").isNull() | ((F.col("status") == "dead_letter") & (F.col("depth") > 0)))

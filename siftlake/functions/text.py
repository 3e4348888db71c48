"""Text, value and array functions: columns in, column out. Null text counts as empty unless stated."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.functions import fixed


def strip_format(c: Column) -> Column:
    """Drop characters of category Cf."""
    return F.regexp_replace(c, r"\p{Cf}", "")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """NFKC form; Spark has no built-in for it. Texts of ASCII, which it does not change, are not sent to Python."""
    other = c.rlike(r"[^\x00-\x7F]")
    return F.when(other, _nfkc(F.when(other, c))).otherwise(c)


def fold_homoglyphs(c: Column) -> Column:
    return F.translate(c, *fixed.HOMOGLYPHS)


def collapse_runs(c: Column) -> Column:
    """Three or more equal characters in a row become two."""
    return F.regexp_replace(c, r"(?s)(.)\1{2,}", "$1$1")


def normalize_text(c: Column) -> Column:
    """Format characters out, NFKC, look-alikes folded, runs collapsed."""
    return collapse_runs(fold_homoglyphs(nfkc(strip_format(F.coalesce(c, F.lit(""))))))


def removed_chars(raw: Column, clean: Column) -> Column:
    return F.greatest(F.length(F.coalesce(raw, F.lit(""))) - F.length(clean), F.lit(0))


def match_text(c: Column) -> Column:
    """Form for matching: NFKC first, then format characters out, then lower case."""
    return F.lower(strip_format(nfkc(F.coalesce(c, F.lit("")))))


def compact(c: Column) -> Column:
    """Without punctuation, symbols and separators."""
    return F.regexp_replace(c, r"[\p{P}\p{S}\p{Z}]", "")


def contains_any(matched: Column, compacted: Column | None, terms: tuple[str, ...]) -> Column:
    """Whether a term occurs. ASCII terms stand alone (no letter or digit at either side); others may be anywhere.

    Without a compacted form, terms are sought in ``matched`` alone. Null if that is null.
    One alternation per kind of term, so a text is read at most three times whatever the number of terms.
    """
    needles = ["".join(ch for ch in unicodedata.normalize("NFKC", t) if unicodedata.category(ch) != "Cf").lower() for t in terms]
    plain = [n for n in needles if n.isascii()]
    other = [n for n in needles if not n.isascii()]
    found = F.lit(False)
    if plain:
        found = found | matched.rlike("(?<![a-z0-9])(?:" + "|".join(map(_quoted, plain)) + ")(?![a-z0-9])")
    if other:
        found = found | matched.rlike("|".join(map(_quoted, other)))
    if other and compacted is not None:
        bare = [x for x in ("".join(ch for ch in n if unicodedata.category(ch)[0] not in "PSZ") for n in other) if x]
        found = found | compacted.rlike("|".join(map(_quoted, bare)))
    return found


def _quoted(term: str) -> str:
    return re.sub(r"([\\^$.|?*+(){}\[\]])", r"\\\1", term)


def any_marker(c: Column, markers: tuple[str, ...]) -> Column:
    return c.rlike("|".join(map(_quoted, markers))) if markers else F.lit(False)


def has_keyword(title: Column, keywords: Column) -> Column:
    """Whether any keyword of an array is part of the title, case ignored; no keywords: false."""
    return F.coalesce(F.exists(keywords, lambda k: F.contains(F.lower(title), F.lower(k))), F.lit(False))


def signals(c: Column, patterns: dict[str, str] = fixed.SIGNAL_PATTERNS, most: int = 10) -> Column:
    """Map of signal family to its distinct hits in the order first seen, at most ``most``; families without a hit are left out."""
    parts: list[Column] = []
    for family, pattern in patterns.items():
        hits = F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"(?iu)(?:{pattern})"), F.lit(0))), 1, most)
        parts += [F.lit(family), hits]
    return F.map_filter(F.create_map(*parts), lambda _, v: F.size(v) > 0)


def signal_count(found: Column) -> Column:
    return F.aggregate(F.map_values(found), F.lit(0), lambda n, v: n + F.size(v))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def preview(c: Column, n: int = 1200) -> Column:
    return F.substring(strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")), 1, n)


def excerpt(c: Column, n: int = 500) -> Column:
    """Stripped; cut to ``n`` characters and marked with an ellipsis if longer."""
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, n), r"(?U)\s+$", ""), F.lit("…")))


def abbreviate(c: Column, n: int) -> Column:
    """At most ``n`` characters, the last three being dots if cut."""
    t = F.coalesce(c, F.lit(""))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n - 3), F.lit("...")))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def language_code(c: Column) -> Column:
    """Regional forms spelt as agreed; blank or null becomes the default language."""
    t = strip(F.coalesce(c, F.lit("")))
    codes = F.create_map(*[F.lit(x) for kv in fixed.LANGUAGE_CODES.items() for x in kv])
    return F.when(t == "", F.lit(fixed.DEFAULT_LANGUAGE)).otherwise(F.coalesce(codes[F.lower(t)], t))


def parse_time(c: Column, as_of: Column) -> Column:
    """ISO time, ``Z`` accepted; anything else becomes ``as_of``."""
    return F.coalesce(F.try_to_timestamp(c), as_of.cast("timestamp"))


def numeric_key(post_id: Column, url: Column) -> Column:
    """All digit runs of the post id (of the address if there are none) as longs; ``[0]`` without digits."""

    def runs(c: Column) -> Column:
        found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+"), F.lit(0))
        return F.filter(F.transform(found, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())

    own, other = runs(post_id), runs(url)
    return F.when(F.size(own) > 0, own).when(F.size(other) > 0, other).otherwise(F.array(F.lit(0).cast("long")))


def risk_score(tier: Column, confidence: Column) -> Column:
    """Tier base plus 0.15 of the confidence; the confidence alone without a tier base. NaN counts as 0."""
    c = F.least(F.greatest(F.nanvl(F.coalesce(confidence, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    base = F.when(tier == "T1", 0.85).when(tier == "T2", 0.65).when(tier == "T3", 0.45)
    return F.when(base.isNotNull(), base + 0.15 * c).otherwise(c)


def severity(is_illegal: Column, tier: Column, confidence: Column) -> Column:
    by_confidence = F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")
    by_tier = F.when(tier == "T1", "high").when(tier == "T2", "medium").otherwise("low")
    return F.when(~F.coalesce(is_illegal, F.lit(False)), "low").when(tier.isNull(), by_confidence).otherwise(by_tier)


def model_version(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def model_of(version: Column) -> Column:
    """Second part of a version; null without one."""
    return F.try_element_at(F.split(version, ":", 3), F.lit(2))


def merge_images(first: Column, second: Column) -> Column:
    """Both lists, blanks out, first occurrences kept."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(F.coalesce(first, empty), F.coalesce(second, empty)), lambda x: F.coalesce(x, F.lit("")) != ""))


def filter_images(images: Column, allowed: Column) -> Column:
    """Addresses that start with http and hold one of the ``allowed`` parts (any, if the array is null)."""
    http = F.filter(images, lambda x: F.startswith(F.lower(x), F.lit("http")))
    return F.filter(http, lambda x: allowed.isNull() | F.exists(allowed, lambda a: F.contains(x, a)))


def pick_body(fit: Column, raw: Column) -> Column:
    return F.coalesce(F.nullif(fit, F.lit("")), raw)


def percent_done(done: Column, total: Column) -> Column:
    """Half-even rounded, at most 100; 0 without a total."""
    return F.when(total > 0, F.least(F.lit(100), F.bround(F.try_divide(100.0 * done, total)).cast("int"))).otherwise(0)


def lenient_long(json: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(json, path).try_cast("bigint"), F.lit(0).cast("long"))


def lenient_text(json: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(json, path), F.lit(""))

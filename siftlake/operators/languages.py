"""Language identification by profiles of character n-grams: aggregation, join and argmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.operators.selection import top_per_group
from siftlake.session import stored

#: Rows of a profile table up to which it is sent to all tasks; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


#: Bits of a character's code point.
CHAR = 21
#: Distinct n-grams that a task sums before it passes them on.
HELD = 500_000


def char_grams(text: Column, n: int = 3) -> Column:
    """The runs of ``n`` characters of a lower-cased text in order: one match of a lookahead at each place, so linear in its length."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def numbered_grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of ``n`` characters within a text: the text's number, a number that equal runs share, and where it begins in the joined texts."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    begins = np.cumsum(sizes) - sizes
    at = np.flatnonzero(np.arange(len(points)) - begins[of] + n <= sizes[of])
    ids, bits = np.zeros(len(at), dtype=np.int64), 0
    for k in range(n):
        if bits + CHAR > 63:  # longer runs than fit are numbered anew
            _, ids = np.unique(ids, return_inverse=True)
            bits = int(len(at)).bit_length()
        ids, bits = (ids << CHAR) | points[at + k], bits + CHAR
    return of[at], ids, at


def counted_grams(df: DataFrame, kind: str, n: int) -> DataFrame:
    """``lang``, ``g`` and ``n`` of the n-grams of the lower-cased texts (columns ``lang`` and ``text``), counted in the batch and summed in the task up to ``HELD`` of them."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, int] = {}

        def told() -> pd.DataFrame:
            return pd.DataFrame([(lang, g, m) for (lang, g), m in held.items()], columns=["lang", "g", "n"], dtype=object)

        for pdf in parts:
            texts = pdf["text"].tolist()
            codes, names = pd.factorize(pdf["lang"], use_na_sentinel=False)
            of, ids, at = numbered_grams(texts, n)
            joined = "".join(texts)
            order = np.argsort(codes[of], kind="stable")
            bounds = np.searchsorted(codes[of][order], np.arange(len(names) + 1))
            for code, name in enumerate(names.tolist()):
                own = order[bounds[code] : bounds[code + 1]]
                _, first, counts = np.unique(ids[own], return_index=True, return_counts=True)
                lang = None if pd.isna(name) else name
                for place, m in zip(at[own[first]].tolist(), counts.tolist(), strict=True):
                    key = lang, joined[place : place + n]
                    held[key] = held.get(key, 0) + m
            if len(held) > HELD:
                yield told()
                held.clear()
        if held:
            yield told()

    return df.mapInPandas(count, f"lang {kind}, g string, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))


def language_profiles(df: DataFrame, *, language: str = "lang", text: str = "text", n: int = 3, most: int = 100) -> DataFrame:
    """``lang``, ``g``, ``n`` and ``place`` (from 1): the ``most`` frequent n-grams of each language, ties by the n-gram.

    Texts without a language make a profile of the null language; null and short texts have no n-grams.
    """
    counts = counted_grams(df.select(F.col(language).alias("lang"), F.lower(F.coalesce(text, F.lit(""))).alias("text")), dict(df.dtypes)[language], n)
    order = [F.desc("n"), F.asc("g")]
    top = top_per_group(counts, ["lang"], order, most)
    # At most ``most`` rows a language from here on.
    return top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "g"))).alias("r")).select(
        "lang", F.posexplode("r").alias("p", "r")
    ).select("lang", "r.g", (-F.col("r.m")).alias("n"), (F.col("p") + 1).alias("place"))


def predict_language(df: DataFrame, profiles: DataFrame, *, key: str, text: str = "text", n: int = 3, most: int = 100) -> DataFrame:
    """``key``, ``language`` and ``score``: each text's n-grams are joined to the profiles, an n-gram at place p is worth
    ``most + 1 - p``, and the language of the greatest sum wins, ties to the first in order. Without a hit: ``und``, 0.

    ``key`` names a row of ``df``; rows of one key count as one text. Profiles of few languages are sent to all
    tasks, behind a count of their rows.
    """
    known = stored(profiles.where(F.col("lang").isNotNull()).select("lang", "g", (most + 1 - F.col("place")).cast("long").alias("worth")), "profiles")
    small = known.count() <= BROADCAST_ROWS
    kind, language = dict(df.dtypes)[key], dict(profiles.dtypes)["lang"]
    spark, texts = df.sparkSession, df.select(F.col(key).alias("_k"), F.lower(F.coalesce(text, F.lit(""))).alias("_t")).where("_k is not null")
    shared = spark.sparkContext.broadcast(known.toPandas() if small else None)

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums by language of the texts of a batch: n-grams are counted and looked up among those of the profiles."""
        table = shared.value
        langs, names = pd.factorize(table["lang"])
        grams = table["g"].tolist()
        worth = table["worth"].to_numpy(dtype=np.int64)
        for pdf in parts:
            values = pdf["_t"].tolist()
            of, ids, _ = numbered_grams(grams + values, n)
            mine, wanted = of[: len(grams)], ids[: len(grams)]  # each n-gram of a profile is a text of one
            distinct, which = np.unique(wanted, return_inverse=True)
            sums, met = (np.zeros((len(values), len(names)), dtype=t) for t in (np.int64, bool))
            if len(grams):
                worths, has = (np.zeros((len(distinct), len(names)), dtype=t) for t in (np.int64, bool))
                np.add.at(worths, (which, langs[mine]), worth[mine])
                has[which, langs[mine]] = True
                hit = np.minimum(np.searchsorted(distinct, ids[len(grams) :]), len(distinct) - 1)
                found = np.flatnonzero(distinct[hit] == ids[len(grams) :])
                both, times = np.unique((of[len(grams) :][found] - len(grams)) * len(distinct) + hit[found], return_counts=True)
                np.add.at(sums, both // len(distinct), worths[both % len(distinct)] * times[:, None])
                np.logical_or.at(met, both // len(distinct), has[both % len(distinct)])
            row, lang = np.nonzero(met)
            yield pd.DataFrame({key: pdf["_k"].to_numpy()[row], "lang": np.asarray(names)[lang], "score": sums[row, lang]})

    if small:  # a row for each text and language
        sums = texts.mapInPandas(score, f"{key} {kind}, lang {language}, score long").groupBy(key, "lang").agg(F.sum("score").alias("score"))
    else:  # an n-gram that a text holds often is one row of the join
        hits = counted_grams(texts.select(F.col("_k").alias("lang"), F.col("_t").alias("text")), kind, n).select(F.col("lang").alias(key), "g", F.col("n").alias("times")).join(known.hint("merge"), "g")
        sums = hits.groupBy(key, "lang").agg(F.sum(F.col("worth") * F.col("times")).alias("score"))
    best = sums.groupBy(key).agg(F.max("score").alias("score"), F.min_by("lang", F.struct(-F.col("score"), "lang")).alias("language"))
    made = df.select(key).distinct().join(best.hint("merge"), key, "left")
    return made.select(key, F.coalesce("language", F.lit("und")).alias("language"), F.coalesce("score", F.lit(0)).cast("long").alias("score"))

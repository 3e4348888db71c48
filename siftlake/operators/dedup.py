"""Exact deduplication, first-seen history and its expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.text import content_hash, strip
from siftlake.session import stored


#: Bits of a history's filter: so many a hash, and at most (16 MB).
BITS_PER_HASH, MOST_BITS = 16, 1 << 27
BUCKET = 1 << 15


def _bits_of(hash_: Column, bits: int) -> list[Column]:
    """Two bits of a filter for a hash."""
    return [F.pmod(F.xxhash64(hash_, F.lit(k)), F.lit(bits)) for k in (0, 1)]


def history_filter(history: DataFrame, column: str = "body_hash") -> tuple[DataFrame, int]:
    """Bitmaps of two bits for each hash (``bucket``, ``bitmap`` of 4 KB), at most ``MOST_BITS`` in all, and the number of bits."""
    n = history.count()
    bits = min(MOST_BITS, max(BUCKET, 1 << (BITS_PER_HASH * n).bit_length()))
    bit = F.explode(F.array(*_bits_of(F.col(column), bits)))
    rows = history.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / BUCKET).alias("bucket"))
    return stored(rows.agg(F.bitmap_construct_agg(F.col("bit") % BUCKET).alias("bitmap")), "history-filter"), bits


def maybe_in(df: DataFrame, column: str, filter_: tuple[DataFrame, int]) -> DataFrame:
    """``df`` with ``_maybe``: false where a hash is surely not in the history. The bitmaps, of a bounded size, go to all tasks."""
    table, bits = filter_
    for k, bit in enumerate(_bits_of(F.col(column), bits)):
        side = F.broadcast(table.select(F.col("bucket").alias("_bucket"), F.col("bitmap").alias(f"_m{k}")))
        df = df.withColumn(f"_b{k}", bit).join(side, F.floor(F.col(f"_b{k}") / BUCKET) == F.col("_bucket"), "left").drop("_bucket")

    def is_set(k: int) -> Column:
        place = F.col(f"_b{k}") % BUCKET
        byte = F.conv(F.hex(F.substr(F.col(f"_m{k}"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False))

    return df.withColumn("_maybe", is_set(0) & is_set(1)).drop("_b0", "_b1", "_m0", "_m1")


def body_duplicates(df: DataFrame, history: DataFrame | None = None, *, body: str = "body", arrival: str = "arrival") -> DataFrame:
    """``df`` with ``body_hash`` and ``duplicate``: an equal body came before, here or in ``history`` (``body_hash``).

    Blank and null bodies are never duplicates. ``arrival`` is unique. The earliest arrival of each hash is
    found by a combining aggregate and joined back; a body that very many rows share is split by the
    skew join, and rows without a hash are spread by their arrival. Only hashes that a filter of the history lets through
    are joined with it; from some eight million hashes on the filter lets more through, and results stay the same.
    """
    blank = F.coalesce(strip(F.col(body)), F.lit("")) == ""
    df = df.withColumn("body_hash", F.when(~blank, content_hash(F.col(body))))
    df = df.withColumn("_k", F.coalesce("body_hash", F.col(arrival).cast("string")))
    first = df.where(F.col("body_hash").isNotNull()).groupBy(F.col("body_hash").alias("_k")).agg(F.min(arrival).alias("_first"))
    later = F.coalesce(F.col(arrival) > F.col("_first"), F.lit(False))
    if history is not None:
        known = history.where(F.col("body_hash").isNotNull()).select(F.col("body_hash").alias("_k"))
        first = stored(maybe_in(first, "_k", history_filter(known, "_k")), "first-arrivals")
        met = first.where("_maybe").join(known.distinct().withColumn("_known", F.lit(True)).hint("merge"), "_k", "left")
        first = met.unionByName(first.where("NOT _maybe").withColumn("_known", F.lit(None).cast("boolean"))).drop("_maybe")
        later = later | F.coalesce("_known", F.lit(False))
    return df.join(first.hint("merge"), "_k", "left").withColumn("duplicate", later).drop("_k", "_first", "_known")


def first_seen(history: DataFrame, new: DataFrame, key: str = "url", at: str = "first_seen") -> DataFrame:
    """History with the new keys added; the time of a known key is never refreshed, also by an earlier one in ``new``."""
    both = history.select(key, at, F.lit(0).alias("_o")).unionByName(new.select(key, at, F.lit(1).alias("_o")))
    return both.groupBy(key).agg(F.min(F.struct("_o", at)).alias("_m")).select(key, F.col(f"_m.{at}").alias(at))


def purge(history: DataFrame, as_of: Column, days: int = 7, at: str = "first_seen") -> tuple[DataFrame, DataFrame]:
    """What stays and what goes: entries first seen ``days`` ago or earlier go."""
    old = F.col(at) <= as_of - F.make_dt_interval(F.lit(days))
    return history.where(~old), history.where(old)


def permanent_marks(df: DataFrame, disposition: str = "disposition") -> DataFrame:
    """Rows whose address is remembered: notices and enqueued posts; failed and blocked ones may be tried again."""
    return df.where(F.col(disposition).isin("sticky", "enqueued"))

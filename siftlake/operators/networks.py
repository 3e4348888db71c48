"""Longest-prefix match of addresses with a table of networks, by one pass over both in the order of addresses."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions import urls as U
from siftlake.session import stored

#: Networks up to which their table is sent to all tasks.
BROADCAST_ROWS = 100_000
#: Ranges of addresses that are passed over, each in one task.
RANGES = 256


def digits_of(ip: Column) -> Column:
    """An address as hex digits, 8 for IPv4 and 32 for IPv6; null for anything else. An IPv4 address mapped into IPv6 is an IPv4 address."""
    six = U.ipv6_hex(ip)
    four = F.lower(F.lpad(F.hex(U.ipv4_number(ip)), 8, "0"))
    return F.coalesce(four, F.when(F.startswith(six, F.lit("0" * 20 + "ffff")), F.substring(six, 25, 8)), six)


def prefix_of(digits: Column, length: Column) -> Column:
    """The first ``length`` bits of hex digits: whole digits, and the next one without its other bits."""
    full, rest = F.floor(length / 4).cast("int"), (length % 4).cast("int")
    last = F.conv(F.substr(digits, full + 1, F.lit(1)), 16, 10).cast("int")
    cut = F.call_function("shiftright", last, F.lit(4) - rest)
    return F.concat(F.substr(digits, F.lit(1), full), F.when(rest > 0, F.concat(F.lit("."), cut.cast("string"))).otherwise(""))


def prefixes(networks: DataFrame, network: str) -> DataFrame:
    """``networks`` with ``_bits`` (of an address: 32 or 128), ``_length`` and ``_prefix``; what names no network goes."""
    parts = F.split(F.trim(F.col(network)), "/")
    address = F.element_at(parts, 1)
    digits = digits_of(address)
    bits = F.length("_digits") * 4
    given = F.when(F.size(parts) == 1, bits).when(F.size(parts) == 2, F.element_at(parts, 2).try_cast("int"))
    # A network of mapped addresses counts its length in IPv6.
    shown = F.when(F.contains(address, F.lit(":")) & (bits == 32) & (F.size(parts) == 2), given - 96).otherwise(given)
    made = networks.withColumn("_digits", digits).withColumn("_bits", bits).withColumn("_length", shown)
    made = made.where(F.col("_digits").isNotNull() & F.col("_length").between(0, F.col("_bits")))
    return made.withColumn("_prefix", prefix_of(F.col("_digits"), F.col("_length"))).drop("_digits")


def _spans(table: DataFrame) -> DataFrame:
    """``table`` with ``_at`` and ``_until``, the first and last address of each network: ``4`` or ``6``, then hex digits, so that they sort as text."""
    family = F.when(F.col("_bits") == 32, "4").otherwise("6")
    full, free = F.substring_index("_prefix", ".", 1), F.lit(4) - F.col("_length") % 4
    low = F.call_function("shiftleft", F.substring_index("_prefix", ".", -1).try_cast("int"), free)
    high = low + F.call_function("shiftleft", F.lit(1), free) - 1
    parted = F.contains("_prefix", F.lit("."))
    ends = [F.rpad(F.concat(full, F.when(parted, F.lower(F.hex(digit))).otherwise("")), F.col("_bits") / 4, F.lit(rest)) for digit, rest in ((low, "0"), (high, "f"))]
    return table.select("*", F.concat(family, ends[0]).alias("_at"), F.concat(family, ends[1]).alias("_until"))


def _range_of(address: Column, bounds: list[str], first: int = 0) -> Column:
    """How many of the sorted ``bounds`` are not above an address, by bisection."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(address < bounds[half], _range_of(address, bounds[:half], first)).otherwise(_range_of(address, bounds[half + 1 :], first + half + 1))


def _innermost(rows: DataFrame) -> DataFrame:
    """``_ip``, and ``_at`` and ``_length`` of the smallest network that holds it. Of two networks one holds the other, or they are apart.

    Rows come by range and address, networks before what they hold; those that are open (129 at most) are kept.
    """
    schema = pa.schema([("_ip", pa.string()), ("_at", pa.string()), ("_length", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, []
        for batch in batches:
            out = []
            for part, at, length, until, ip in zip(*(batch.column(n).to_pylist() for n in range(5)), strict=True):
                if part != now:
                    now, open_ = part, []
                while open_ and open_[-1][0] < at:
                    open_.pop()
                if until is not None:
                    open_.append((until, at, length))
                elif open_:
                    out.append((ip, *open_[-1][1:]))
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], f.type) for n, f in enumerate(schema)], schema=schema)

    dealt = rows.select("_range", "_at", "_length", "_until", "_ip").repartition("_range").sortWithinPartitions("_range", "_at", F.col("_length").asc_nulls_last())
    return dealt.mapInArrow(run, "_ip string, _at string, _length int")


def longest_match(df: DataFrame, networks: DataFrame, *, ip: str = "ip", network: str = "network") -> DataFrame:
    """``df`` with ``match``: the row of ``networks`` with the longest prefix that holds the address; null where there is none, or no address.

    Distinct addresses and networks are dealt to ranges of addresses and passed over in order, so each is shuffled once, whatever
    lengths occur; a network is in each range that it touches (a bound lies in 162 networks at most). A sample gives the bounds, on which no
    result depends. Of networks that are equal the least row is taken; bits beyond a network's length are ignored.
    """
    fields = F.struct(*networks.columns)
    table = stored(_spans(prefixes(networks, network).groupBy("_bits", "_length", "_prefix").agg(F.min(fields).alias("match"))), "networks")
    digits = stored(df.select(F.col(ip).alias("_ip")).where(F.col(ip).isNotNull()).distinct().withColumn("_digits", digits_of(F.col("_ip"))), "addresses").where(F.col("_digits").isNotNull())
    addresses = digits.select("_ip", F.concat(F.when(F.length("_digits") == 8, "4").otherwise("6"), "_digits").alias("_at"))
    some = addresses.select("_at").unionAll(table.select("_at")).orderBy(F.xxhash64("_at")).limit(32 * RANGES)
    sample = sorted({r[0] for r in some.collect()})
    bounds = sample[len(sample) // RANGES :: max(1, len(sample) // RANGES)][: RANGES - 1]
    none = F.lit(None)
    asked = addresses.select(_range_of(F.col("_at"), bounds).alias("_range"), "_at", none.cast("int").alias("_length"), none.cast("string").alias("_until"), "_ip")
    touched = F.explode(F.sequence(_range_of(F.col("_at"), bounds), _range_of(F.col("_until"), bounds)))
    held = table.select(touched.alias("_range"), "_at", "_length", "_until", none.cast("string").alias("_ip"))
    found = _innermost(held.unionAll(asked))
    few = table.count() <= BROADCAST_ROWS
    named = table.select("_at", "_length", "match")
    best = stored(found.join(F.broadcast(named) if few else named.hint("merge"), ["_at", "_length"]).select("_ip", "match"), "matches")
    return df.join(best.hint("merge"), df[ip] == best["_ip"], "left").drop("_ip")


def blocked_by(df: DataFrame, networks: DataFrame, *, ip: str = "ip", network: str = "network", blocked: str = "blocked") -> DataFrame:
    """``df`` with ``blocked``: what the longest network of a table says; false outside all, true for what is no address."""
    found = longest_match(df, networks.select(network, F.col(blocked).alias("_blocked")), ip=ip, network=network)
    return found.withColumn("blocked", F.when(digits_of(F.col(ip)).isNull(), True).otherwise(F.coalesce("match._blocked", F.lit(False)))).drop("match")

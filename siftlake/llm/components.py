"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import stored


def _starred(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over links (u, v), u > v. Each node's least neighbour (or itself) becomes the hub.

    The least is found by a combining aggregate and joined back, so that the neighbours of a node are
    never gathered in one place; a node with very many links is split by the skew join.
    """
    both = edges if small else edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least.hint("merge"), "u")
    if small:  # all smaller neighbours, and the node itself, to the least
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    else:  # all larger neighbours to the least
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where(F.col("u") != F.col("v")).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the least node reachable) for every node that has a link to another.

    Links may be given in either direction and repeatedly; nulls and links of a node to itself are
    ignored; no links give no rows. Each round is written to the shared folder; only a count and a
    checksum of the links come to the driver. Rounds go on until nothing changes.
    """
    edges = (
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    edges, before = stored(edges, "links"), None
    while True:  # each round halves the longest chain at least
        edges = stored(_starred(_starred(edges, small=False), small=True), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
        before = now

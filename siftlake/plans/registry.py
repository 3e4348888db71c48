"""Registered queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftlake.plans.bindings import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable:
    """Register a function of ``Views`` under ``name``; ``sql`` may use the named views."""

    def register(make: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: make(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(views, sql) if views else sql
        return make

    return register


from siftlake.plans import queries_index, queries_links, queries_more, queries_ordered, queries_posts, queries_stats, queries_streams  # noqa: E402,F401  (they register themselves)

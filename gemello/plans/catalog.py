"""All queries of the library, by name, and equivalent SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gemello.plans import candidates, extra, groups, merges, more, runs, scale, scans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

for module in (groups, candidates, merges, scans, more, extra, runs, scale):
    for name, (query, sql) in module.CATALOG.items():
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql

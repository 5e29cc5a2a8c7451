"""Catalogue of registry-graph queries: name -> (DataFrame builder, SQL twin or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlink.plans import backfills, etl, graph, loads, search, semi, text

Query = Callable[[SparkSession, str], DataFrame]
ALL: dict[str, tuple[Query, str | None]] = {**graph.QUERIES, **search.QUERIES, **text.QUERIES, **etl.QUERIES, **loads.QUERIES, **backfills.QUERIES, **semi.QUERIES}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}

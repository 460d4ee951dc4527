"""Every query of the engine by name, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.plans import list_queries, match_queries, state_queries, sync_queries, text_queries

_PARTS = (list_queries, text_queries, match_queries, state_queries, sync_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_queries.match_cascade(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}

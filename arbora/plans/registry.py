"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arbora.plans import core_queries, corpus_queries, score_queries, text_queries

_MODULES = (core_queries, score_queries, corpus_queries, text_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_queries.macro_scores(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in _MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in getattr(m, "SQL", {}).items()}

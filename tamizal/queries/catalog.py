"""The registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import documents, evaluation, knowledge, language, metrics, questions, ranking, rest, retrieval

FLAGSHIP = "r_hybrid"

_MODULES: tuple = (ranking, retrieval, knowledge, evaluation, metrics, documents, language, questions, rest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}

"""The registered queries of the reference-parity operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioforge.plans import queries_library, queries_retrieval, queries_sessions, queries_text

FLAGSHIP = "r9_hybrid_retrieve"
MODULES = (queries_text, queries_retrieval, queries_library, queries_sessions)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}

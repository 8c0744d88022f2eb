"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# imported here, so that a missing library is known when this module is imported
from folioforge.llm import answers, entities, lookalikes, mixing, name_variants, neardup, neighbours, packing, scans, splitting

MODULES = (neighbours, answers, name_variants, entities, scans, neardup, splitting, packing, mixing, lookalikes)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}

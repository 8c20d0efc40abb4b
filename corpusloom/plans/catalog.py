"""The registered queries and their DuckDB counterparts, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import basics, library, links, measures, overlaps, scalars, verdicts, wording

MODULES = [basics, overlaps, measures, scalars, library, links, wording, verdicts]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}

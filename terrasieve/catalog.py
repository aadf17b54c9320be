"""Every query of the core by name, with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrasieve.queries import effects, environment, files, genetics, quality

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (quality, environment, genetics, effects, files)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}

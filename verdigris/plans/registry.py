"""All queries by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdigris.plans import decide, drift, files, prepare, retrieval


def _parts() -> list:
    return [decide.R, retrieval.R, prepare.R, files.R]


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return decide.flagship_report(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = drift.queries()
    for r in _parts():
        out |= r.queries
    return out


def oracle_sql() -> dict[str, str]:
    out = drift.oracle_sql()
    for r in _parts():
        out |= r.sql
    return out

"""Every query of the library with the SQL that checks it, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cross, diagnosis, evaluation, formulas, jobs, joins, models, sources

MODULES = (formulas, cross, sources, joins, evaluation, models, diagnosis, jobs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: make for m in MODULES for name, make in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.R.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["factor_job"](spark, sf_dir)

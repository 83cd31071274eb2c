"""Named queries: (spark, sf_dir) -> DataFrame, and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartwheel.plans.cleaning import CLEANING_QUERIES
from cartwheel.plans.cleaning_oracle import CLEANING_SQL
from cartwheel.plans.oracle import REPORT_SQL
from cartwheel.plans.reports import REPORTS
from cartwheel.sources.testviews import shop_tables

Query = Callable[[SparkSession, str], DataFrame]


def _report(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(shop_tables(spark, sf_dir))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: _report(fn) for name, fn in REPORTS.items()}
    out.update(CLEANING_QUERIES)
    return out


def all_oracle_sql() -> dict[str, str]:
    return {**REPORT_SQL, **CLEANING_SQL}

"""Common inputs of the registered queries, built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.operators import forecast, split, weekly
from tidewell.session import cut_lineage
from tidewell.sources.tables import raw_daily


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly demand table (closed week rule), all years."""
    return weekly.weekly_rollup(raw_daily(spark, sf_dir), rule="closed")


def demand_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly table written once to the checkpoint folder, for jobs that read it
    several times (split, fitted statistics, series features): lineitem is scanned,
    joined and rolled up once per job instead of once per use."""
    return cut_lineage(demand(spark, sf_dir))


def split_parts(spark: SparkSession, sf_dir: str):
    return split.year_split(demand(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive-forecast prediction table of the test year (K1 layout)."""
    d = demand_once(spark, sf_dir)
    _, test_year = split.split_years(d)
    return forecast.naive_predictions(d, test_year)

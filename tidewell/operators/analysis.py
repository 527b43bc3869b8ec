"""Demand analysis reports over the weekly demand table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.calendar import year_month


def display_label(col, prefix: str) -> F.Column:
    """``Store n`` / ``Product n`` for numeric ids, the id itself otherwise (P20)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.rlike("^[0-9]+$"), F.concat(F.lit(prefix + " "), c)).otherwise(c)


def inspect(df: DataFrame) -> DataFrame:
    """Dataset inspection (A3) in one aggregate pass."""
    null_cells = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("Date").alias("date_min"),
        F.max("Date").alias("date_max"),
        (F.count_distinct("Store") if "Store" in df.columns else F.lit(0).cast("long")).alias("stores"),
        F.count_distinct("Product").alias("products"),
        F.sum(null_cells).alias("missing_values"),
        F.avg("Demand").alias("demand_mean"),
        F.min("Demand").alias("demand_min"),
        F.max("Demand").alias("demand_max"),
    )


def monthly_totals(df: DataFrame) -> DataFrame:
    """Monthly demand totals (A7); partial aggregation keeps the shuffle to one row per month and task."""
    return df.groupBy(year_month("Date").alias("month")).agg(
        F.sum("Demand").alias("demand"), F.count(F.lit(1)).alias("rows"))


def demand_metrics(df: DataFrame) -> DataFrame:
    """Mean, total, peak/lowest month (ties -> earliest), growth of the last two months.

    Everything after the first aggregate runs on the month-level table (one row
    per month), so the global orderings there are over a few hundred rows.
    """
    monthly = monthly_totals(df)
    by_month = Window.orderBy("month")
    ranked = monthly.select(
        "*",
        F.row_number().over(Window.orderBy(F.desc("demand"), "month")).alias("_peak"),
        F.row_number().over(Window.orderBy("demand", "month")).alias("_low"),
        F.row_number().over(Window.orderBy(F.desc("month"))).alias("_last"),
        F.lag("demand").over(by_month).alias("_prev"),
    )
    growth = F.when(F.col("_prev").isNull() | (F.col("_prev") == 0), F.lit(0.0)).otherwise(
        (F.col("demand") - F.col("_prev")) / F.abs(F.col("_prev")) * 100)
    return ranked.agg(
        (F.sum("demand") / F.sum("rows")).alias("avg_weekly_demand"),
        F.sum("demand").alias("total_demand"),
        F.max(F.when(F.col("_peak") == 1, F.col("month"))).alias("peak_demand_month"),
        F.max(F.when(F.col("_low") == 1, F.col("month"))).alias("lowest_demand_month"),
        F.max(F.when(F.col("_last") == 1, growth)).alias("demand_growth_rate"),
    )


def key_totals(df: DataFrame, key: str, label_prefix: str) -> DataFrame:
    """Totals per store or product, descending, with the display label."""
    return (df.groupBy(key).agg(F.sum("Demand").alias("demand"))
            .withColumn("label", display_label(key, label_prefix))
            .orderBy(F.desc("demand"), key))


def distinct_sorted(df: DataFrame, key: str) -> DataFrame:
    """Distinct ids, sorted."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key)


def trend(df: DataFrame) -> DataFrame:
    """(Date, Demand) in date order."""
    return df.select("Date", "Demand").orderBy("Date")

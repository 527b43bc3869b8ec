"""Daily to weekly demand rollups (A1, A2) and the preparation jobs.

A rollup is one ``groupBy`` on (week, store, item): Spark plans a partial
aggregate before the shuffle (map-side combine), so the exchange carries at
most one row per (week, store, item) and input partition, never raw lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.calendar import week_end


def weekly_rollup(raw: DataFrame, rule: str = "closed", year_ceiling: int | None = None,
                  with_price: bool = True) -> DataFrame:
    """Roll raw daily rows (date, store_id, item_id, sales[, price, promo]) up to weeks.

    Output is the canonical demand table: Date, Store, Product, Demand
    [, Price (mean, 2 decimals), Promo (max)].  With ``year_ceiling`` the
    reference's two filters apply: on the day and again on the week end (P1).
    """
    df = raw
    if year_ceiling is not None:
        df = df.where(F.year("date") <= year_ceiling)
    df = df.withColumn("week", week_end("date", rule))
    if year_ceiling is not None:
        df = df.where(F.year("week") <= year_ceiling)
    aggs = [F.sum("sales").cast("double").alias("Demand")]
    if with_price:
        aggs += [F.round(F.avg("price"), 2).alias("Price"),
                 F.max("promo").cast("int").alias("Promo")]
    return (df.groupBy("week", "store_id", "item_id").agg(*aggs)
            .withColumnRenamed("week", "Date")
            .withColumnRenamed("store_id", "Store")
            .withColumnRenamed("item_id", "Product"))


def weekly_rollup_int_ids(raw2: DataFrame, rule: str = "closed") -> DataFrame:
    """Second layout (date, store, item, sales) -> weekly with integer ids cast to string."""
    return (raw2.withColumn("week", week_end("date", rule))
            .groupBy("week", "store", "item")
            .agg(F.sum("sales").cast("double").alias("Demand"))
            .select(F.col("week").alias("Date"),
                    F.col("store").cast("string").alias("Store"),
                    F.col("item").cast("string").alias("Product"),
                    "Demand"))


def submission_rows(raw: DataFrame) -> DataFrame:
    """Rows to be forecast in the second layout (id, date, store, item) as submission input
    (S15): integer ids, day-first date text; O1's order is left to the writer."""
    return raw.select(F.col("id").cast("int").alias("id"), F.date_format("date", "dd-MM-yyyy").alias("Date"),
                      F.col("store").cast("int").alias("Store"), F.col("item").cast("int").alias("Product"))


def id_suffix(col) -> F.Column:
    """Numeric suffix of an id such as ``store_12``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.split_part(c, F.lit("_"), F.lit(-1)).cast("int")


def prepared_file_rows(weekly: DataFrame) -> DataFrame:
    """The prepared-file projection (P3): day-first date text, ids rebuilt from suffixes."""
    return weekly.select(
        F.date_format("Date", "dd-MM-yyyy").alias("Date"),
        F.concat(F.lit("store_"), id_suffix("Store").cast("string")).alias("Store"),
        F.concat(F.lit("item_"), id_suffix("Product").cast("string")).alias("Product"),
        F.col("Demand").cast("int").alias("Demand"),
        "Price", "Promo")

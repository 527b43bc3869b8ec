"""Parquet sources: the driver's tables and the retail mapping built on them.

``raw_daily`` maps the sales fact of the test data onto the raw daily retail
layout (date, store_id, item_id, sales, price, promo) described in SURVEY §7.1.
All joins are inner equi-joins on dimension keys; Catalyst pushes the column
selection into the Parquet scans and AQE turns the dimension joins into
broadcast hash joins when their measured size is small, otherwise they stay
sort-merge joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_daily(spark: SparkSession, sf_dir: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Raw daily retail rows: one per sales line.

    ``since`` / ``until`` (ISO dates, until exclusive) filter the raw ship
    timestamp itself, so the range reaches the Parquet scan as a pushed filter.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    if since is not None:
        li = li.where(F.col("l_shipdate") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        li = li.where(F.col("l_shipdate") < F.lit(until).cast("timestamp_ntz"))
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return (li
            .join(part, li.l_partkey == part.p_partkey)
            .join(supp, li.l_suppkey == supp.s_suppkey)
            .join(nation, supp.s_nationkey == nation.n_nationkey)
            .select(
                F.to_date("l_shipdate").alias("date"),
                F.concat(F.lit("store_"), F.col("n_regionkey").cast("string")).alias("store_id"),
                F.concat(F.lit("item_"), F.regexp_replace("p_brand", "Brand#", "")).alias("item_id"),
                F.col("l_quantity").cast("int").alias("sales"),
                (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
                (F.col("l_discount") >= 0.09).cast("int").alias("promo"),
            ))


def raw_daily_layout2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second raw layout (date, store, item, sales) with integer ids."""
    return raw_daily(spark, sf_dir).select(
        "date",
        F.split_part(F.col("store_id"), F.lit("_"), F.lit(-1)).cast("int").alias("store"),
        F.split_part(F.col("item_id"), F.lit("_"), F.lit(-1)).cast("int").alias("item"),
        "sales")


def raw_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to be forecast in the second raw layout (id, date, store, item): one per sales line."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return (li.join(part, li.l_partkey == part.p_partkey).join(supp, li.l_suppkey == supp.s_suppkey)
            .join(nation, supp.s_nationkey == nation.n_nationkey)
            .select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.to_date("l_shipdate").alias("date"),
                    F.col("n_regionkey").alias("store"), F.regexp_replace("p_brand", "Brand#", "").cast("int").alias("item")))


# DuckDB counterpart used by the oracle SQL (a CTE body).
RAW_DAILY_SQL = """
raw_daily AS (
  SELECT CAST(l.l_shipdate AS DATE) AS date,
         'store_' || CAST(n.n_regionkey AS VARCHAR) AS store_id,
         'item_' || replace(p.p_brand, 'Brand#', '') AS item_id,
         CAST(l.l_quantity AS INTEGER) AS sales,
         l.l_extendedprice / l.l_quantity AS price,
         CAST(l.l_discount >= 0.09 AS INTEGER) AS promo
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
)"""

"""Registered queries: weekly rollups, inspection, demand analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.calendar import week_end
from tidewell.operators import analysis, split, weekly
from tidewell.plans import base
from tidewell.plans.registry import query
from tidewell.plans.sqlbase import (BASE, BASE_SPLIT, DEMAND_SQL, R, week_strict, with_ctes, ym)
from tidewell.sources.tables import RAW_DAILY_SQL, raw_daily, raw_daily_layout2, raw_submission


@query("weekly_rollup_closed", with_ctes(*BASE) + """
SELECT Date, Store, Product, Demand, Price, Promo FROM demand""", ids="A2 S14 F9")
def q_weekly_closed(spark, sf):
    return base.demand(spark, sf)


@query("weekly_rollup_strict", with_ctes(*BASE_SPLIT) + f""",
ceiling AS (SELECT max(y) AS y FROM years WHERE yr <= 4)
SELECT wk AS Date, store_id AS Store, item_id AS Product,
       CAST(sum(sales) AS DOUBLE) AS Demand, {R('avg(price)', 2)} AS Price,
       CAST(max(promo) AS INTEGER) AS Promo
FROM (SELECT *, {week_strict('date')} AS wk FROM raw_daily WHERE year(date) <= (SELECT y FROM ceiling)) t
WHERE year(wk) <= (SELECT y FROM ceiling)
GROUP BY 1, 2, 3""", ids="A1 P1")
def q_weekly_strict(spark, sf):
    # The prepared history ends with the test year (later years play later uploads)
    _, last = split.split_years(raw_daily(spark, sf).select(week_end("date", "closed").alias("Date")))
    return weekly.weekly_rollup(raw_daily(spark, sf, until=f"{last + 1}-01-01"), rule="strict", year_ceiling=last)


@query("weekly_int_ids", with_ctes(RAW_DAILY_SQL) + f"""
SELECT wk AS Date, CAST(store AS VARCHAR) AS Store, CAST(item AS VARCHAR) AS Product,
       CAST(sum(sales) AS DOUBLE) AS Demand
FROM (SELECT date, CAST(split_part(store_id, '_', -1) AS INTEGER) AS store,
             CAST(split_part(item_id, '_', -1) AS INTEGER) AS item, sales,
             date + CAST((5 - dayofweek(date) + 7) % 7 AS INTEGER) AS wk FROM raw_daily) t
GROUP BY 1, 2, 3""", ids="S15 A2 P2")
def q_weekly_int_ids(spark, sf):
    return weekly.weekly_rollup_int_ids(raw_daily_layout2(spark, sf), rule="closed")


@query("submission_input", with_ctes(RAW_DAILY_SQL) + """
SELECT CAST(l_orderkey * 8 + l_linenumber AS INTEGER) AS id, strftime(CAST(l_shipdate AS DATE), '%d-%m-%Y') AS Date,
       CAST(n_regionkey AS INTEGER) AS Store, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS Product
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey""", ids="S15")
def q_submission_input(spark, sf):
    return weekly.submission_rows(raw_submission(spark, sf))


@query("prepared_file", with_ctes(*BASE) + """
SELECT strftime(Date, '%d-%m-%Y') AS Date,
       'store_' || CAST(CAST(split_part(Store, '_', -1) AS INTEGER) AS VARCHAR) AS Store,
       'item_' || CAST(CAST(split_part(Product, '_', -1) AS INTEGER) AS VARCHAR) AS Product,
       CAST(Demand AS INTEGER) AS Demand, Price, Promo
FROM demand""", ids="P2 P3 S14")
def q_prepared_file(spark, sf):
    return weekly.prepared_file_rows(base.demand(spark, sf))


@query("inspect", with_ctes(*BASE) + f"""
SELECT count(*) AS rows, min(Date) AS date_min, max(Date) AS date_max,
       count(DISTINCT Store) AS stores, count(DISTINCT Product) AS products,
       CAST(sum((Date IS NULL)::BIGINT + (Store IS NULL)::BIGINT + (Product IS NULL)::BIGINT
           + (Demand IS NULL)::BIGINT + (Price IS NULL)::BIGINT + (Promo IS NULL)::BIGINT) AS BIGINT)
           AS missing_values,
       {R('avg(Demand)', 4)} AS demand_mean, min(Demand) AS demand_min, max(Demand) AS demand_max
FROM demand""", ids="A3")
def q_inspect(spark, sf):
    out = analysis.inspect(base.demand(spark, sf))
    return out.withColumn("demand_mean", F.round("demand_mean", 4))


_MONTHLY = f"""
monthly AS (SELECT {ym('Date')} AS month, sum(Demand) AS demand, count(*) AS rows
            FROM demand GROUP BY 1)"""


@query("monthly_demand", with_ctes(*BASE, _MONTHLY) + """
SELECT month, demand, rows FROM monthly""", ids="A7 F9")
def q_monthly_demand(spark, sf):
    return analysis.monthly_totals(base.demand(spark, sf))


@query("demand_metrics", with_ctes(*BASE, _MONTHLY) + f""",
ranked AS (
  SELECT *, row_number() OVER (ORDER BY demand DESC, month) AS pk,
            row_number() OVER (ORDER BY demand, month) AS lo,
            row_number() OVER (ORDER BY month DESC) AS la,
            lag(demand) OVER (ORDER BY month) AS prev
  FROM monthly)
SELECT {R('sum(demand) / sum(rows)', 4)} AS avg_weekly_demand,
       sum(demand) AS total_demand,
       max(CASE WHEN pk = 1 THEN month END) AS peak_demand_month,
       max(CASE WHEN lo = 1 THEN month END) AS lowest_demand_month,
       {R('max(CASE WHEN la = 1 THEN CASE WHEN prev IS NULL OR prev = 0 THEN 0.0 ELSE (demand - prev) / abs(prev) * 100 END END)', 4)} AS demand_growth_rate
FROM ranked""", ids="A6 W5 O6")
def q_demand_metrics(spark, sf):
    out = analysis.demand_metrics(base.demand(spark, sf))
    return out.withColumns({"avg_weekly_demand": F.round("avg_weekly_demand", 4),
                            "demand_growth_rate": F.round("demand_growth_rate", 4)})


@query("store_demand", with_ctes(*BASE) + """
SELECT Store, sum(Demand) AS demand,
       CASE WHEN regexp_matches(Store, '^[0-9]+$') THEN 'Store ' || Store ELSE Store END AS label
FROM demand GROUP BY Store ORDER BY demand DESC, Store""", ids="A8 P20")
def q_store_demand(spark, sf):
    return analysis.key_totals(base.demand(spark, sf), "Store", "Store")


@query("product_demand", with_ctes(*BASE) + """
SELECT Product, sum(Demand) AS demand,
       CASE WHEN regexp_matches(Product, '^[0-9]+$') THEN 'Product ' || Product ELSE Product END AS label
FROM demand GROUP BY Product ORDER BY demand DESC, Product""", ids="A9 P20")
def q_product_demand(spark, sf):
    return analysis.key_totals(base.demand(spark, sf), "Product", "Product")


@query("distinct_products", with_ctes(*BASE) + """
SELECT DISTINCT Product FROM demand WHERE Product IS NOT NULL ORDER BY Product""", ids="A28")
def q_distinct_products(spark, sf):
    return analysis.distinct_sorted(base.demand(spark, sf), "Product")


@query("demand_trend", with_ctes(*BASE) + """
SELECT Date, Demand FROM demand ORDER BY Date""", ids="P18")
def q_demand_trend(spark, sf):
    return analysis.trend(base.demand(spark, sf))


@query("year_split_summary", with_ctes(*BASE_SPLIT) + f""",
info AS (SELECT max(CASE WHEN yr = CASE WHEN ny > 3 THEN 4 ELSE ny END THEN y END) AS test_year,
                min(y) AS train_year,
                list(y ORDER BY y) FILTER (WHERE yr <= 3) AS train_years FROM years)
SELECT (SELECT test_year FROM info) AS test_year, (SELECT train_year FROM info) AS train_year,
       min(CASE WHEN list_contains((SELECT train_years FROM info), year(Date)) THEN Date END) AS train_start,
       max(CASE WHEN list_contains((SELECT train_years FROM info), year(Date)) THEN Date END) AS train_end,
       min(CASE WHEN year(Date) = (SELECT test_year FROM info) THEN Date END) AS test_start,
       max(CASE WHEN year(Date) = (SELECT test_year FROM info) THEN Date END) AS test_end,
       count(*) FILTER (WHERE list_contains((SELECT train_years FROM info), year(Date))) AS train_rows,
       count(*) FILTER (WHERE year(Date) = (SELECT test_year FROM info)) AS test_rows,
       count(DISTINCT CASE WHEN list_contains((SELECT train_years FROM info), year(Date)) THEN {ym('Date')} END) AS train_months,
       count(DISTINCT CASE WHEN year(Date) = (SELECT test_year FROM info) THEN {ym('Date')} END) AS test_months
FROM demand""", ids="P4")
def q_year_split_summary(spark, sf):
    return split.year_split_summary(base.demand(spark, sf))


@query("month_cutoff_split", with_ctes(*BASE) + """,
c AS (SELECT CAST(min(Date) + INTERVAL 12 MONTH AS DATE) AS cutoff_date FROM demand)
SELECT CASE WHEN d.Date < c.cutoff_date THEN 'train' ELSE 'test' END AS split,
       count(*) AS rows, min(d.Date) AS first_date, max(d.Date) AS last_date,
       max(c.cutoff_date) AS cutoff_date
FROM demand d, c GROUP BY 1""", ids="P5")
def q_month_cutoff_split(spark, sf):
    labelled = split.month_cutoff_split(base.demand(spark, sf), 12)
    return labelled.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.min("Date").alias("first_date"),
        F.max("Date").alias("last_date"), F.max("cutoff_date").alias("cutoff_date"))


@query("distinct_stores", with_ctes(*BASE) + """
SELECT DISTINCT Store FROM demand WHERE Store IS NOT NULL ORDER BY Store""", ids="A28 S13")
def q_distinct_stores(spark, sf):
    return analysis.distinct_sorted(base.demand(spark, sf), "Store")

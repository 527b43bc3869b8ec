"""Shared SQL pieces of the DuckDB oracle (see ``catalog.oracle_sql``).

The oracle re-states every query in plain ANSI SQL over the same Parquet
tables; these are the common table expressions (raw daily rows, weekly demand,
feature table, naive predictions) that the per-query statements build on.
"""

from __future__ import annotations

from tidewell.operators.features import LAGS, ROLL_WINDOWS
from tidewell.sources.tables import RAW_DAILY_SQL


def R(expr: str, k: int) -> str:
    """DuckDB rounding that agrees with Spark's ``round`` on doubles.

    Spark rounds the shortest decimal text of the double half-up; DuckDB's
    ``round`` works on the binary value.  Formatting first makes the two agree.
    """
    return (f"(CASE WHEN ({expr}) IS NULL THEN NULL ELSE "
            f"CAST(round(CAST(format('{{}}', CAST({expr} AS DOUBLE)) AS DECIMAL(38,20)), {k}) AS DOUBLE) END)")


def week_closed(d: str) -> str:
    return f"({d} + CAST((5 - dayofweek({d}) + 7) % 7 AS INTEGER))"


def week_strict(d: str) -> str:
    return week_closed(f"({d} + 1)")


def ym(d: str) -> str:
    return f"strftime({d}, '%Y-%m')"


DEMAND_SQL = f"""
demand AS (
  SELECT {week_closed('date')} AS Date, store_id AS Store, item_id AS Product,
         CAST(sum(sales) AS DOUBLE) AS Demand,
         {R('avg(price)', 2)} AS Price,
         CAST(max(promo) AS INTEGER) AS Promo
  FROM raw_daily GROUP BY 1, 2, 3
)"""

# First three distinct years train, the fourth test (else the last).
SPLIT_SQL = """
years AS (SELECT y, row_number() OVER (ORDER BY y) AS yr, count(*) OVER () AS ny
          FROM (SELECT DISTINCT year(Date) AS y FROM demand) t),
train AS (SELECT d.* FROM demand d JOIN years ON year(d.Date) = years.y WHERE years.yr <= 3),
test  AS (SELECT d.* FROM demand d JOIN years ON year(d.Date) = years.y
          WHERE years.yr = CASE WHEN years.ny > 3 THEN 4 ELSE years.ny END)"""


def _series_cols() -> str:
    w = "PARTITION BY Store, Product ORDER BY Date"
    parts = [f"lag(Demand, {k}) OVER ({w}) AS _lag{k}" for k in LAGS]
    for n in ROLL_WINDOWS:
        fr = f"({w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        parts += [f"avg(Demand) OVER {fr} AS Rolling_Mean_{n}",
                  f"coalesce(stddev_samp(Demand) OVER {fr}, 0.0) AS Rolling_Std_{n}",
                  f"max(Demand) OVER {fr} AS Rolling_Max_{n}",
                  f"min(Demand) OVER {fr} AS Rolling_Min_{n}"]
    return ",\n         ".join(parts)


def _lag_fill() -> str:
    return ",\n         ".join(
        f"coalesce(_lag{k}, avg(_lag{k}) OVER (PARTITION BY Store, Product), 0.0) AS Lag_{k}" for k in LAGS)


CAL_SQL = """month(Date) AS Month, quarter(Date) AS Quarter, year(Date) AS Year,
         dayofyear(Date) AS DayOfYear, weekofyear(Date) AS WeekOfYear,
         CAST(quarter(Date) = 1 AS INTEGER) AS Is_Q1, CAST(quarter(Date) = 2 AS INTEGER) AS Is_Q2,
         CAST(quarter(Date) = 3 AS INTEGER) AS Is_Q3, CAST(quarter(Date) = 4 AS INTEGER) AS Is_Q4,
         sin(2 * pi() * month(Date) / 12) AS Month_Sin, cos(2 * pi() * month(Date) / 12) AS Month_Cos,
         sin(2 * pi() * quarter(Date) / 4) AS Quarter_Sin, cos(2 * pi() * quarter(Date) / 4) AS Quarter_Cos,
         sin(2 * pi() * weekofyear(Date) / 52) AS Week_Sin, cos(2 * pi() * weekofyear(Date) / 52) AS Week_Cos,
         CAST(month(Date) IN (11, 12) AS INTEGER) AS Near_Holiday,
         CAST(month(Date) IN (6, 7, 8) AS INTEGER) AS Is_Summer,
         CAST(month(Date) IN (12, 1, 2) AS INTEGER) AS Is_Winter"""


def series_sql(src: str = "demand", name: str = "series") -> str:
    """Lag/rolling/momentum columns over ``src`` (a CTE with the demand schema)."""
    return f"""
{name}_raw AS (
  SELECT *, {_series_cols()}
  FROM {src}
),
{name}_lags AS (
  SELECT * EXCLUDE ({', '.join(f'_lag{k}' for k in LAGS)}),
         {_lag_fill()}
  FROM {name}_raw
),
{name} AS (
  SELECT *, Lag_1 / (Rolling_Mean_3 + 1) AS Momentum_3, Lag_1 / (Rolling_Mean_6 + 1) AS Momentum_6,
         Rolling_Std_4 / (Rolling_Mean_4 + 1) AS Volatility_4, Rolling_Std_8 / (Rolling_Mean_8 + 1) AS Volatility_8
  FROM {name}_lags
)"""


# Naive forecast (M10): Predicted = Rolling_Mean_4 of the history; test-year rows.
PRED_SQL = f"""
pred_base AS (
  SELECT s.Store, s.Product, s.Date, s.Demand,
         coalesce(s.Rolling_Mean_4, 0.0) AS p
  FROM series s JOIN test t ON s.Store = t.Store AND s.Product = t.Product AND s.Date = t.Date
),
preds AS (
  SELECT Store, Product, Date, Demand,
         {R('p', 2)} AS Predicted,
         {R('p * 0.85', 2)} AS CI_Lower,
         {R('p * 1.15', 2)} AS CI_Upper,
         {R('abs(Demand - p)', 2)} AS Abs_Error,
         {R('abs(Demand - p) / (abs(Demand) + 1e-9) * 100', 2)} AS Error_Pct,
         {ym('Date')} AS month
  FROM pred_base
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


BASE = (RAW_DAILY_SQL, DEMAND_SQL)
BASE_SPLIT = (RAW_DAILY_SQL, DEMAND_SQL, SPLIT_SQL)
BASE_PRED = (RAW_DAILY_SQL, DEMAND_SQL, SPLIT_SQL, series_sql(), PRED_SQL)

"""Registered queries: the forecast cycle (M8 with M10, J3, J4, J7, J8, J11, J12, A22, A23, A26, A29, A37, D9, D10, K5, U1-U3, W6).

Test-data roles: the closed-week demand table is the stored history; the
daily rows of the years after the test year, rolled up with the strict week
rule, are the monthly actuals uploads (they overlap the history's keys, so
replacement and "latest source wins" act on real duplicates).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.calendar import shift_month, week_end, year_month
from tidewell.functions.scalars import row_literals
from tidewell.operators import forecast, reconcile, split, weekly
from tidewell.operators.features import add_series_features
from tidewell.operators.reconcile import COMPARISON_ADVICE
from tidewell.plans import base
from tidewell.plans.registry import query
from tidewell.plans.sqlbase import BASE_SPLIT, R, series_sql, week_closed, week_strict, with_ctes, ym
from tidewell.session import cut_lineage
from tidewell.sources.tables import raw_daily


# ── Spark side ─────────────────────────────────────────────────────────────
class Cycle:
    """Inputs of one cycle job: the history, the uploads (``first_month`` on) and what follows
    from them. History and uploads are written to the checkpoint folder once, since a job reads
    them several times (months to replace, forecasts, actuals)."""

    def __init__(self, spark, sf):
        daily = raw_daily(spark, sf)
        _, test_year = split.split_years(daily.select(week_end("date", "closed").alias("Date")))
        self.first_month = f"{test_year + 1}-01"
        up = weekly.weekly_rollup(raw_daily(spark, sf, since=f"{self.first_month}-01"), rule="strict")
        self.history = base.demand_once(spark, sf)
        self.uploads = cut_lineage(up)

    def replaced(self):
        return reconcile.replace_months(self.history, self.uploads)

    def forecasts(self):
        fc = forecast.month_ahead_naive(self.replaced(), self.first_month)
        return fc.withColumn("Predicted_Demand", F.round("Predicted_Demand", 2))

    def actuals(self):
        return self.uploads.withColumn("month", year_month("Date"))

    def compared(self):
        return reconcile.compare_actuals(self.actuals(), self.forecasts())

    def baseline_mae(self):
        """Training MAE of the naive forecast (full precision): a one-row frame."""
        d = self.history
        train_years, _ = split.split_years(d)
        s = add_series_features(d, ["Store", "Product"]).where(F.year("Date").isin(train_years))
        return s.agg(F.avg(F.abs(F.col("Demand") - F.coalesce("Rolling_Mean_4", F.lit(0.0)))).alias("baseline_mae"))

    def monthly_comparison_drift(self):
        metrics = reconcile.comparison_metrics(self.compared())
        return reconcile.comparison_drift(metrics, row_literals(self.baseline_mae())["baseline_mae"])


# ── SQL side ───────────────────────────────────────────────────────────────
_UP_SQL = f"""
since AS (SELECT CAST(max(y) + 1 AS VARCHAR) AS y FROM years WHERE yr <= 4),
uploads AS (
  SELECT wk AS Date, store_id AS Store, item_id AS Product, CAST(sum(sales) AS DOUBLE) AS Demand,
         {R('avg(price)', 2)} AS Price, CAST(max(promo) AS INTEGER) AS Promo
  FROM (SELECT *, {week_strict('date')} AS wk FROM raw_daily WHERE date >= CAST((SELECT y FROM since) || '-01-01' AS DATE)) t
  GROUP BY 1, 2, 3),
replaced AS (
  SELECT d.* FROM demand d WHERE NOT EXISTS (SELECT 1 FROM uploads u WHERE {ym('u.Date')} = {ym('d.Date')})
  UNION ALL SELECT * FROM uploads)"""


def _fc_sql(src: str = "replaced", first: str = "(SELECT y || '-01' FROM since)") -> str:
    lag = ", ".join(f"lag(Demand, {j}) OVER w AS l{j}" for j in range(1, 5))
    s = " + ".join(f"coalesce(CASE WHEN {j} <= 4 - k THEN l{j} END, 0.0)" for j in range(1, 5))
    n = " + ".join(f"CASE WHEN {j} <= 4 - k AND l{j} IS NOT NULL THEN 1 ELSE 0 END" for j in range(1, 5))
    first_day = "CAST(month || '-01' AS DATE)"
    return f"""
lagged AS (SELECT Store, Product, Date, {ym('Date')} AS month, {lag}, row_number() OVER w AS rn
           FROM {src} WINDOW w AS (PARTITION BY Store, Product ORDER BY Date)),
firsts AS (SELECT * FROM (SELECT *, min(rn) OVER (PARTITION BY Store, Product, month) AS fr
                          FROM lagged WHERE month >= {first}) t WHERE rn = fr),
fridays AS (SELECT f.*, r.range AS k, CAST({week_closed(first_day)} + CAST(7 * r.range AS INTEGER) AS DATE) AS fd,
                   last_day({first_day}) AS ld
            FROM firsts f CROSS JOIN range(0, 5) r),
fc_raw AS (SELECT Store, Product, fd AS Date, month,
                  CASE WHEN ({n}) > 0 THEN ({s}) / ({n}) ELSE 0.0 END AS p_raw
           FROM fridays WHERE fd <= ld),
fc AS (SELECT Store, Product, Date, month, p_raw, {R('p_raw', 2)} AS Predicted_Demand FROM fc_raw)"""


CYCLE = with_ctes(*BASE_SPLIT, _UP_SQL, _fc_sql())
_CMP = """,
act AS (SELECT month, Store, Product, avg(Demand) AS Actual
        FROM (SELECT *, """ + ym("Date") + """ AS month FROM uploads) u GROUP BY 1, 2, 3),
prd AS (SELECT month, Store, Product, avg(Predicted_Demand) AS Predicted FROM fc GROUP BY 1, 2, 3),
cmp AS (SELECT a.month, a.Store, a.Product, a.Actual, p.Predicted, abs(a.Actual - p.Predicted) AS Error,
               """ + R("abs(a.Actual - p.Predicted) / (abs(a.Actual) + 1e-9) * 100", 2) + """ AS Error_Pct
        FROM act a JOIN prd p ON a.month = p.month AND a.Store IS NOT DISTINCT FROM p.Store
                              AND a.Product IS NOT DISTINCT FROM p.Product),
metrics AS (SELECT month, """ + R("avg(Error)", 2) + """ AS mae, """ + R("sqrt(avg(Error * Error))", 2) + """ AS rmse,
                   """ + R("avg(Error_Pct)", 2) + """ AS mape, count(*) AS n_keys FROM cmp GROUP BY month)"""


@query("dedupe_last", with_ctes(*BASE_SPLIT, _UP_SQL) + """,
u AS (SELECT *, 0 AS source_seq FROM demand UNION ALL SELECT *, 1 AS source_seq FROM uploads)
SELECT Store, Product, Date, Demand, Price, Promo, source_seq FROM (
  SELECT *, row_number() OVER (PARTITION BY Store, Product, Date ORDER BY source_seq DESC) AS rn FROM u) t
WHERE rn = 1""", ids="A22 U1 U4 S9")
def q_dedupe_last(spark, sf):
    c = Cycle(spark, sf)
    u = reconcile.union_sources([c.history, c.uploads])
    return reconcile.dedupe_last(u).select("Store", "Product", "Date", "Demand", "Price", "Promo", "source_seq")


@query("replace_month", CYCLE + "\nSELECT Date, Store, Product, Demand, Price, Promo FROM replaced",
       ids="J11 U3 K5")
def q_replace_month(spark, sf):
    return Cycle(spark, sf).replaced().select("Date", "Store", "Product", "Demand", "Price", "Promo")


@query("month_ahead_forecast", CYCLE + "\nSELECT Store, Product, Date, month, Predicted_Demand FROM fc",
       ids="M8 M10 J7 F8 U2")
def q_month_ahead(spark, sf):
    return Cycle(spark, sf).forecasts()


@query("compare_actuals", CYCLE + _CMP + "\nSELECT * FROM metrics", ids="J3 A23")
def q_compare_actuals(spark, sf):
    return reconcile.comparison_metrics(Cycle(spark, sf).compared())


@query("compare_details", CYCLE + _CMP + f"""
SELECT month, Store, Product, {R('Actual', 4)} AS Actual, {R('Predicted', 4)} AS Predicted,
       {R('Error', 4)} AS Error, Error_Pct FROM cmp""", ids="J3")
def q_compare_details(spark, sf):
    c = Cycle(spark, sf).compared()
    return c.withColumns({k: F.round(k, 4) for k in ("Actual", "Predicted", "Error")})


@query("compare_global", CYCLE + f""",
a AS (SELECT {ym('Date')} AS month, avg(Demand) AS Actual FROM uploads GROUP BY 1),
p AS (SELECT month, avg(Predicted_Demand) AS Predicted FROM fc GROUP BY 1)
SELECT a.month, {R('Actual', 4)} AS Actual, {R('Predicted', 4)} AS Predicted,
       {R('abs(Actual - Predicted)', 4)} AS Error,
       {R('abs(Actual - Predicted) / (abs(Actual) + 1e-9) * 100', 2)} AS Error_Pct
FROM a JOIN p ON a.month = p.month""", ids="J4")
def q_compare_global(spark, sf):
    cy = Cycle(spark, sf)
    c = reconcile.compare_global(cy.actuals(), cy.forecasts())
    return c.withColumns({k: F.round(k, 4) for k in ("Actual", "Predicted", "Error")})


_BASE_MAE = f""",
{series_sql('demand', 'hs').strip()},
bmae AS (SELECT avg(abs(Demand - coalesce(Rolling_Mean_4, 0.0))) AS b
         FROM hs JOIN years ON year(hs.Date) = years.y WHERE years.yr <= 3),
cdrift AS (SELECT month, mae, mape,
                  {R('CASE WHEN b > 0 THEN (mae - b) / b ELSE 0.0 END * 100', 1)} AS error_increase_pct,
                  CASE WHEN (CASE WHEN b > 0 THEN (mae - b) / b ELSE 0.0 END) < 0.1 THEN 'none'
                       WHEN (CASE WHEN b > 0 THEN (mae - b) / b ELSE 0.0 END) < 0.5 THEN 'mild'
                       ELSE 'severe' END AS severity
           FROM metrics, bmae)"""


@query("comparison_drift", CYCLE + _CMP + _BASE_MAE + "\nSELECT * FROM cdrift", ids="D9")
def q_comparison_drift(spark, sf):
    return Cycle(spark, sf).monthly_comparison_drift()


@query("comparison_drift_overall", CYCLE + _CMP + _BASE_MAE + f""",
recent AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY month DESC) AS r FROM cdrift) t WHERE r <= 3),
o AS (SELECT {R('avg(error_increase_pct)', 1)} AS avg_error_increase_pct, count(*) AS months_used FROM recent)
SELECT *, CASE WHEN avg_error_increase_pct < 10 THEN 'none' WHEN avg_error_increase_pct < 50 THEN 'mild'
               ELSE 'severe' END AS overall_severity,
       CASE WHEN avg_error_increase_pct < 10 THEN '{COMPARISON_ADVICE["none"]}'
            WHEN avg_error_increase_pct < 50 THEN '{COMPARISON_ADVICE["mild"]}'
            ELSE '{COMPARISON_ADVICE["severe"]}' END AS recommendation
FROM o""", ids="D10 W6 F17")
def q_comparison_drift_overall(spark, sf):
    return reconcile.overall_drift(Cycle(spark, sf).monthly_comparison_drift(), 3)


@query("cycle_status", CYCLE + f"""
SELECT min(Date) AS first_date, max(Date) AS last_date, count(*) AS total_rows,
       count(DISTINCT Store) AS stores, count(DISTINCT Product) AS products,
       {ym('max(Date)')} AS last_data_month,
       'Predict ' || strftime(CAST({ym('max(Date)')} || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') AS next_action
FROM replaced""", ids="A29 F7")
def q_cycle_status(spark, sf):
    return reconcile.cycle_status(Cycle(spark, sf).replaced())


@query("comparison_records", CYCLE + _CMP + f"""
SELECT month, mae, rmse, mape, n_keys, Store, count(*) AS n_products,
       string_agg(Product, ',' ORDER BY Product) AS products, {R('max(Error)', 4)} AS worst
FROM cmp JOIN metrics USING (month) GROUP BY ALL""", ids="K11")
def q_comparison_records(spark, sf):
    rec = reconcile.comparison_records(Cycle(spark, sf).compared())
    return rec.select("month", "mae", "rmse", "mape", "n_keys", "Store", F.size("products").cast("long").alias("n_products"),
                      F.array_join(F.transform("products", lambda p: p["Product"]), ",").alias("products"),
                      F.round(F.array_max(F.transform("products", lambda p: p["Error"])), 4).alias("worst"))


# ── next month: scaffold, forecast, summaries ─────────────────────────────
def _next_month(hist):
    return hist.agg(shift_month(year_month(F.max("Date")), 1).alias("target"))


def scaffold(spark, sf, hist=None):
    hist = hist if hist is not None else Cycle(spark, sf).replaced()
    target = _next_month(hist).first()["target"]
    return forecast.future_scaffold(hist, target)


_SCAFFOLD_SQL = f""",
tgt AS (SELECT strftime(CAST({ym('max(Date)')} || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') AS target
        FROM replaced),
lastrow AS (SELECT Price, Promo FROM replaced ORDER BY Date DESC, Store DESC, Product DESC LIMIT 1),
scaffold AS (
  SELECT s.Store, s.Product, CAST({week_closed("CAST(t.target || '-01' AS DATE)")} + CAST(7 * r.range AS INTEGER) AS DATE) AS Date,
         CAST(NULL AS DOUBLE) AS Demand, coalesce(l.Price, 0) AS Price, coalesce(l.Promo, 0) AS Promo
  FROM (SELECT DISTINCT Store, Product FROM replaced) s CROSS JOIN tgt t CROSS JOIN lastrow l
  CROSS JOIN range(0, 5) r
  WHERE {week_closed("CAST(t.target || '-01' AS DATE)")} + CAST(7 * r.range AS INTEGER) <= last_day(CAST(t.target || '-01' AS DATE)))"""


@query("future_scaffold", CYCLE + _SCAFFOLD_SQL + "\nSELECT * FROM scaffold", ids="J7 J8 F8")
def q_future_scaffold(spark, sf):
    return scaffold(spark, sf).select("Store", "Product", "Date", "Demand", "Price", "Promo")


def next_month_forecast(spark, sf):
    hist = Cycle(spark, sf).replaced()
    sc = scaffold(spark, sf, hist)
    target = sc.agg(year_month(F.min("Date")).alias("t")).first()["t"]
    fc = forecast.month_ahead_naive(hist.unionByName(sc), target)
    p = F.col("Predicted_Demand")
    return fc.select("Store", "Product", "Date", F.round(p, 2).alias("Predicted_Demand"),
                     F.round(p * 0.85, 2).alias("CI_Lower"), F.round(p * 1.15, 2).alias("CI_Upper"))


_NEXT_FC = with_ctes(*BASE_SPLIT, _UP_SQL) + _SCAFFOLD_SQL + ",\nwithsc AS (SELECT * FROM replaced UNION ALL BY NAME SELECT * FROM scaffold),\n" + \
    _fc_sql("withsc", "(SELECT target FROM tgt)").strip() + f""",
nfc AS (SELECT f.Store, f.Product, f.Date, f.Predicted_Demand,
               {R('p_raw * 0.85', 2)} AS CI_Lower, {R('p_raw * 1.15', 2)} AS CI_Upper
        FROM fc f)"""


@query("per_product_forecast", _NEXT_FC + f"""
SELECT Product, {R('avg(Predicted_Demand)', 4)} AS mean_predicted, {R('avg(CI_Lower)', 4)} AS mean_lower,
       {R('avg(CI_Upper)', 4)} AS mean_upper, count(*) AS rows
FROM nfc GROUP BY Product""", ids="A26 A37 M4b")
def q_per_product_forecast(spark, sf):
    fc = next_month_forecast(spark, sf)
    # means of 2-decimal values are reported at 4 decimals (no rounding ties)
    return fc.groupBy("Product").agg(F.round(F.avg("Predicted_Demand"), 4).alias("mean_predicted"),
                                     F.round(F.avg("CI_Lower"), 4).alias("mean_lower"),
                                     F.round(F.avg("CI_Upper"), 4).alias("mean_upper"),
                                     F.count(F.lit(1)).alias("rows"))


# ── months of the cycle ────────────────────────────────────────────────────
def _pending(spark, sf):
    """A cycle whose next month is forecast and waits for its actuals: (history, month table)."""
    cy = Cycle(spark, sf)
    hist = cy.replaced()
    target = _next_month(hist).first()["target"]
    todo = reconcile.months_without_rows(spark.createDataFrame([(target,)], "month string"), hist)
    ahead = scaffold(spark, sf, hist).withColumn("month", year_month("Date")).join(todo, "month", "left_semi")
    stored = cy.forecasts().select("month", "Store", "Product").unionByName(ahead.select("month", "Store", "Product"))
    metrics = reconcile.comparison_metrics(cy.compared())
    return hist, reconcile.month_state(hist, stored, cy.actuals(), metrics)


_STATE_SQL = CYCLE + _CMP + _SCAFFOLD_SQL + f""",
h AS (SELECT {ym('Date')} AS month, count(*) AS history_rows FROM replaced GROUP BY 1),
f AS (SELECT month, count(*) AS forecast_rows FROM (SELECT month FROM fc UNION ALL SELECT {ym('Date')} FROM scaffold) u GROUP BY 1),
u AS (SELECT {ym('Date')} AS month, count(*) AS upload_rows FROM uploads GROUP BY 1),
state AS (SELECT month, coalesce(history_rows, 0) AS history_rows, coalesce(forecast_rows, 0) AS forecast_rows,
                 coalesce(upload_rows, 0) AS upload_rows, mae,
                 coalesce(forecast_rows, 0) > 0 AND coalesce(upload_rows, 0) = 0 AS waiting_for_upload
          FROM h FULL JOIN f USING (month) FULL JOIN u USING (month) FULL JOIN (SELECT month, mae FROM metrics) m USING (month))"""


@query("cycle_month_state", _STATE_SQL + "\nSELECT * FROM state", ids="A29 J12")
def q_cycle_month_state(spark, sf):
    return _pending(spark, sf)[1]


@query("cycle_status_pending", _STATE_SQL + f""",
k AS (SELECT max(month) FILTER (forecast_rows > 0) AS last_prediction_month,
             max(month) FILTER (upload_rows > 0) AS last_upload_month,
             count(*) FILTER (forecast_rows > 0) AS prediction_months, count(mae) AS comparisons FROM state),
s AS (SELECT min(Date) AS first_date, max(Date) AS last_date, count(*) AS total_rows, count(DISTINCT Store) AS stores,
             count(DISTINCT Product) AS products FROM replaced),
w AS (SELECT s.*, k.*, {ym('last_date')} AS last_data_month,
             CASE WHEN last_prediction_month IS DISTINCT FROM last_upload_month THEN last_prediction_month END AS waiting_for_upload
      FROM s, k)
SELECT *, CASE WHEN waiting_for_upload IS NOT NULL THEN 'Upload ' || waiting_for_upload || ' actual data'
               ELSE 'Predict ' || strftime(CAST(last_data_month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') END AS next_action,
       CAST(CASE WHEN waiting_for_upload IS NOT NULL THEN 2 WHEN last_prediction_month IS NOT NULL THEN 3 ELSE 1 END AS INTEGER) AS step
FROM w""", ids="A29 P23")
def q_cycle_status_pending(spark, sf):
    hist, months = _pending(spark, sf)
    return reconcile.cycle_status(hist, months)

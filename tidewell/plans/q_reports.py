"""Registered queries: the naive prediction table and the reports on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import analysis, forecast, reports, split
from tidewell.plans import base
from tidewell.plans.registry import query
from tidewell.plans.sqlbase import BASE, BASE_PRED, R, with_ctes
from tidewell.session import cut_lineage, ensure_checkpoint_dir
from tidewell.sources import runs, sinks

P = with_ctes(*BASE_PRED)
PAIRS = "(SELECT * FROM preds WHERE Demand IS NOT NULL AND Predicted IS NOT NULL)"
ERR = "abs(Demand - Predicted)"
PCT = f"{ERR} / (abs(Demand) + 1e-9) * 100"


def _label(col, prefix):
    return f"CASE WHEN regexp_matches({col}, '^[0-9]+$') THEN '{prefix} ' || {col} ELSE {col} END"


@query("naive_predictions", P + "\nSELECT * FROM preds", ids="M10 F13 K1 M4b P4")
def q_naive_predictions(spark, sf):
    return base.predictions(spark, sf)


@query("store_error_stats", P + f"""
SELECT Store, {R(f'avg({ERR})', 2)} AS mae, {R('avg(Demand)', 2)} AS avg_sales, count(Demand) AS count
FROM {PAIRS} t GROUP BY Store""", ids="A10")
def q_store_error_stats(spark, sf):
    return reports.store_error_stats(base.predictions(spark, sf))


_PF = f"""
pf AS (SELECT Product, avg(Demand) AS avg_demand, avg(Predicted) AS avg_predicted,
              avg({ERR}) AS mae, avg({PCT}) AS mape, sum(Demand) AS total_demand, count(Demand) AS count
       FROM {PAIRS} t GROUP BY Product)"""
_PF_SELECT = f"""SELECT Product, {R('avg_demand', 2)} AS avg_demand, {R('avg_predicted', 2)} AS avg_predicted,
       {R('mae', 2)} AS mae, {R('mape', 2)} AS mape, {R('total_demand', 2)} AS total_demand, count,
       {_label('Product', 'Product')} AS name,
       {R('least(greatest(100 - mape, 0.0), 100.0)', 2)} AS accuracy
FROM pf"""


@query("product_forecast", P + "," + _PF + "\n" + _PF_SELECT, ids="A11 F15 P20")
def q_product_forecast(spark, sf):
    return reports.product_forecast(base.predictions(spark, sf))


@query("product_monthly", P + f"""
SELECT month, Product, {R('avg(Demand)', 2)} AS demand, {R('avg(Predicted)', 2)} AS predicted,
       {_label('Product', 'Product')} AS name
FROM {PAIRS} t GROUP BY month, Product""", ids="A12")
def q_product_monthly(spark, sf):
    return reports.product_monthly(base.predictions(spark, sf))


_SPF = f"""
spf AS (SELECT Store, Product, {R('avg(Demand)', 2)} AS avg_demand, {R('avg(Predicted)', 2)} AS avg_predicted,
               {R(f'avg({ERR})', 2)} AS mae, {R(f'avg({PCT})', 2)} AS mape, count(Demand) AS count,
               {_label('Product', 'Product')} AS name,
               {R(f'least(greatest(100 - avg({PCT}), 0.0), 100.0)', 2)} AS accuracy
        FROM {PAIRS} t GROUP BY Store, Product)"""


@query("store_product_forecast", P + "," + _SPF + "\nSELECT * FROM spf", ids="A13")
def q_store_product_forecast(spark, sf):
    return reports.store_product_forecast(base.predictions(spark, sf))


@query("store_monthly", P + f"""
SELECT month, Store, {R('avg(Demand)', 2)} AS demand, {R('avg(Predicted)', 2)} AS predicted
FROM {PAIRS} t GROUP BY month, Store""", ids="A14")
def q_store_monthly(spark, sf):
    return reports.store_monthly(base.predictions(spark, sf))


_SD = f"""
sd AS (SELECT Store, month, avg({ERR}) AS mae, avg(Demand) AS avg_demand, avg(Predicted) AS avg_predicted,
              count(Demand) AS count
       FROM {PAIRS} t GROUP BY Store, month)"""


@query("store_drift", P + "," + _SD + f"""
SELECT Store, month, {R('mae', 2)} AS mae, {R('avg_demand', 2)} AS avg_demand,
       {R('avg_predicted', 2)} AS avg_predicted, count,
       {R('mae / (abs(avg_demand) + 1e-9) * 100', 2)} AS error_pct
FROM sd""", ids="A15")
def q_store_drift(spark, sf):
    return reports.store_drift(base.predictions(spark, sf))


def _metrics_sql(group: str = "") -> str:
    sel = f"{group}, " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    return P + f""",
m AS (SELECT {sel}avg({ERR}) AS mae, sqrt(avg((Demand - Predicted) * (Demand - Predicted))) AS rmse,
             avg({PCT}) AS mape, sum({ERR}) / (sum(abs(Demand)) + 1e-9) * 100 AS wmape,
             sum((Demand - Predicted) * (Demand - Predicted)) AS ss_res,
             var_pop(Demand) * count(Demand) AS ss_tot, count(*) AS n_rows
      FROM {PAIRS} t{gb})
SELECT {sel}{R('mae', 4)} AS mae, {R('rmse', 4)} AS rmse, {R('mape', 4)} AS mape, {R('wmape', 4)} AS wmape,
       n_rows, {R('CASE WHEN ss_tot > 0 THEN (1 - ss_res / ss_tot) * 100 ELSE 100.0 END', 4)} AS r2,
       {R('greatest(0.0, 100 - mape)', 1)} AS accuracy
FROM m"""


@query("test_metrics", _metrics_sql(), ids="A16")
def q_test_metrics(spark, sf):
    return reports.test_metrics(base.predictions(spark, sf))


@query("selection_kpis", _metrics_sql("month"), ids="A30")
def q_selection_kpis(spark, sf):
    return reports.test_metrics(base.predictions(spark, sf), by=["month"])


@query("trainer_metrics", P + f""",
m AS (SELECT sqrt(avg((Demand - Predicted) * (Demand - Predicted))) AS rmse, avg({ERR}) AS mae,
             sum((Demand - Predicted) * (Demand - Predicted)) AS ss_res, var_pop(Demand) * count(Demand) AS ss_tot,
             avg(CASE WHEN Demand <> 0 THEN abs((Demand - Predicted) / Demand) END) AS mape,
             sum({ERR}) / (sum(abs(Demand)) + 1e-9) * 100 AS wmape
      FROM preds)
SELECT CAST(round_even(rmse, 0) AS INTEGER) AS RMSE, CAST(round_even(mae, 0) AS INTEGER) AS MAE,
       CAST(round_even(CASE WHEN ss_tot > 0 THEN 1 - ss_res / ss_tot ELSE 0.0 END * 100, 0) AS INTEGER) AS R2,
       CAST(coalesce(round_even(mape * 100, 0), 0.0) AS INTEGER) AS MAPE,
       CAST(round_even(wmape, 0) AS INTEGER) AS WMAPE,
       100 - CAST(coalesce(round_even(mape * 100, 0), 0.0) AS INTEGER) AS Accuracy
FROM m""", ids="A17")
def q_trainer_metrics(spark, sf):
    return reports.trainer_metrics(base.predictions(spark, sf))


@query("interval_coverage", P + f"""
SELECT {R('avg(CAST(Demand BETWEEN CI_Lower AND CI_Upper AS DOUBLE))', 6)} AS coverage,
       {R('avg(CI_Upper - CI_Lower)', 4)} AS avg_interval_width
FROM preds""", ids="A18 M4b")
def q_interval_coverage(spark, sf):
    return reports.interval_coverage(base.predictions(spark, sf))


_BATCH = f"""
batch AS (SELECT month, count(*) AS count, {R('avg(Predicted)', 2)} AS mean_pred,
                 {R('avg(Demand)', 2)} AS mean_actual FROM preds GROUP BY month)"""


@query("batch_summary", P + "," + _BATCH + "\nSELECT * FROM batch", ids="A19 K3")
def q_batch_summary(spark, sf):
    return reports.batch_summary(base.predictions(spark, sf))


@query("monthly_sales", P + "," + _BATCH + f"""
SELECT month, mean_actual AS actual, mean_pred AS predicted,
       {R('abs(coalesce(mean_actual, 0.0) - coalesce(mean_pred, 0.0))', 2)} AS mae
FROM batch""", ids="A20")
def q_monthly_sales(spark, sf):
    return reports.monthly_sales(reports.batch_summary(base.predictions(spark, sf)))


@query("quality_bands", P + """
SELECT Store, Product, Date, Error_Pct,
       CASE WHEN Error_Pct < 3 THEN 'Excellent' WHEN Error_Pct < 8 THEN 'Good'
            WHEN Error_Pct < 15 THEN 'Fair' ELSE 'Poor' END AS quality
FROM preds""", ids="P16")
def q_quality_bands(spark, sf):
    p = base.predictions(spark, sf)
    return p.select("Store", "Product", "Date", "Error_Pct", reports.quality_band("Error_Pct").alias("quality"))


@query("product_month_summary", P + f""",
s AS (SELECT month, Product, sum(coalesce(Demand, 0.0)) AS act, sum(Predicted) AS pr,
             sum(coalesce(Abs_Error, {ERR})) AS err, count(*) AS n
      FROM {PAIRS} t GROUP BY month, Product)
SELECT month, Product, n, {R('act / n', 0)} AS avgActual, {R('pr / n', 0)} AS avgPred,
       {R('err / n', 0)} AS mae, CASE WHEN act <> 0 THEN {R('err / act * 100', 1)} ELSE 0.0 END AS mape
FROM s""", ids="A31")
def q_product_month_summary(spark, sf):
    return reports.product_month_summary(base.predictions(spark, sf))


_PMS = """
pms AS (SELECT Product, first(name) AS name, avg(mae) AS mae, avg(mape) AS mape, avg(avg_demand) AS avg_demand,
               avg(avg_predicted) AS avg_predicted, sum(count) AS count FROM spf GROUP BY Product)"""
_PMS_SELECT = f"""SELECT Product, name, {R('mae', 2)} AS mae, {R('mape', 2)} AS mape, {R('avg_demand', 2)} AS avg_demand,
       {R('avg_predicted', 2)} AS avg_predicted, {R('100 - mape', 2)} AS accuracy, CAST(count AS BIGINT) AS count
FROM pms"""


def _pms_spark(spark, sf):
    return reports.product_mean_of_stores(reports.store_product_forecast(base.predictions(spark, sf)))


@query("product_mean_of_stores", P + "," + _SPF + "," + _PMS + "\n" + _PMS_SELECT, ids="A32")
def q_product_mean_of_stores(spark, sf):
    return _pms_spark(spark, sf)


@query("macro_kpis", P + "," + _SPF + "," + _PMS + f""",
r AS ({_PMS_SELECT})
SELECT {R('avg(mae)', 0)} AS mae, {R('avg(mape)', 0)} AS mape, {R('100 - avg(mape)', 0)} AS accuracy FROM r""",
       ids="A33")
def q_macro_kpis(spark, sf):
    return reports.macro_kpis(_pms_spark(spark, sf))


@query("top_products", P + "," + _SPF + "," + _PMS + f""",
r AS ({_PMS_SELECT})
SELECT * FROM r ORDER BY avg_demand DESC, Product LIMIT 8""", ids="O5")
def q_top_products(spark, sf):
    return reports.top_products(_pms_spark(spark, sf), 8)


@query("store_mae_by_month", P + "," + _SD + f""",
sdr AS (SELECT Store, month, {R('mae', 2)} AS mae FROM sd)
SELECT month, {R('avg(mae)', 2)} AS MAE FROM sdr GROUP BY month""", ids="A34")
def q_store_mae_by_month(spark, sf):
    return reports.store_mae_by_month(reports.store_drift(base.predictions(spark, sf)))


@query("demand_share", with_ctes(*BASE) + """,
t AS (SELECT Product, sum(Demand) AS demand FROM demand GROUP BY Product)
SELECT Product, demand, """ + R("demand / sum(demand) OVER () * 100", 1) + """ AS pct FROM t""", ids="A39")
def q_demand_share(spark, sf):
    totals = analysis.key_totals(base.demand(spark, sf), "Product", "Product").select("Product", "demand")
    return reports.demand_share(totals)


@query("product_month_heatmap", P + f""",
pm AS (SELECT month, Product, {R('avg(Demand)', 2)} AS demand FROM {PAIRS} t GROUP BY month, Product),
v AS (SELECT Product, month, {R('demand', 0)} AS value FROM pm)
SELECT Product, month, value, {R('value / max(value) OVER (PARTITION BY Product)', 4)} AS intensity FROM v""",
       ids="A40")
def q_heatmap(spark, sf):
    return reports.heatmap(reports.product_monthly(base.predictions(spark, sf)))


@query("normalised_scores", P + "," + _PF + f""",
r AS ({_PF_SELECT}),
k AS (SELECT *, row_number() OVER (ORDER BY Product) AS rn FROM r)
SELECT Product, name, {R('avg_demand / greatest(max(avg_demand) OVER (), 1.0) * 100', 1)} AS Demand,
       {R('accuracy', 0)} AS Accuracy
FROM k WHERE rn <= 10""", ids="A41")
def q_normalised_scores(spark, sf):
    return reports.normalised_scores(reports.product_forecast(base.predictions(spark, sf)), 10)


@query("demand_vs_forecast", P + "," + _PF + f""",
r AS ({_PF_SELECT})
SELECT Product, name, {R('avg_demand', 0)} AS avg_demand, {R('avg_predicted', 0)} AS avg_forecast,
       {R('accuracy', 0)} AS accuracy
FROM r ORDER BY avg_demand DESC, Product""", ids="O8")
def q_demand_vs_forecast(spark, sf):
    return reports.demand_vs_forecast(reports.product_forecast(base.predictions(spark, sf)))


@query("first_rows", P + """
SELECT * FROM preds ORDER BY Store, Product, Date LIMIT 150""", ids="O4")
def q_first_rows(spark, sf):
    return reports.first_rows(base.predictions(spark, sf), 150)


@query("store_stats_fallback", P + "," + _BATCH + f""",
g AS (SELECT coalesce(avg(abs(coalesce(mean_actual, 0.0) - coalesce(mean_pred, 0.0))), 0.0) AS mae FROM batch)
SELECT Store, {R('avg(Demand)', 2)} AS avg_sales, count(Demand) AS count, {R('max(g.mae)', 2)} AS mae
FROM demand, g GROUP BY Store""", ids="A10b")
def q_store_stats_fallback(spark, sf):
    return reports.store_stats_fallback(base.demand(spark, sf),
                                        reports.batch_summary(base.predictions(spark, sf)))


@query("dataset_summary", P + "," + _BATCH + f""",
info AS (SELECT max(CASE WHEN yr = CASE WHEN ny > 3 THEN 4 ELSE ny END THEN y END) AS test_year FROM years)
SELECT count(*) AS rows, count(DISTINCT Store) AS stores, min(Date) AS date_min, max(Date) AS date_max,
       {R('avg(Demand)', 4)} AS demand_mean, min(Demand) AS demand_min, max(Demand) AS demand_max,
       count(*) FILTER (WHERE year(Date) IN (SELECT y FROM years WHERE yr <= 3)) AS train_rows,
       count(*) FILTER (WHERE year(Date) = (SELECT test_year FROM info)) AS test_rows,
       (SELECT string_agg(month || ' ' || printf('%.2f', mean_actual) || ' ' || printf('%.2f', mean_pred), '; ' ORDER BY month)
        FROM batch) AS monthly_avg
FROM demand""", ids="A27 A3 P4")
def q_dataset_summary(spark, sf):
    d = base.demand_once(spark, sf)
    train_years, test_year = split.split_years(d)
    batches = reports.batch_summary(forecast.naive_predictions(d, test_year))
    text = F.transform("monthly_avg", lambda m: F.format_string("%s %.2f %.2f", m["month"], m["mean_actual"], m["mean_pred"]))
    return reports.dataset_summary(d, train_years, test_year, batches).withColumn("monthly_avg", F.array_join(text, "; "))


_GROUPED = ", ".join(f"({', '.join(k)})" for k in sorted({tuple(k for k in reports._KEYS if k in keys)
                                                         for keys in reports.REPORT_LEVELS.values()}))


@query("grouped_reports", P + f"""
SELECT Store, Product, month, concat_ws('+', CASE WHEN grouping(Store) = 0 THEN 'Store' END,
         CASE WHEN grouping(Product) = 0 THEN 'Product' END, CASE WHEN grouping(month) = 0 THEN 'month' END) AS level,
       {R('avg(Demand)', 2)} AS avg_demand, {R('avg(Predicted)', 2)} AS avg_predicted, {R(f'avg({ERR})', 2)} AS mae,
       {R(f'avg({PCT})', 2)} AS mape, {R('sum(Demand)', 2)} AS total_demand, count(Demand) AS count
FROM {PAIRS} t GROUP BY GROUPING SETS ({_GROUPED})""", ids="A11 A12 A13 A14 A15")
def q_grouped_reports(spark, sf):
    return reports._r2(reports.grouped_reports(base.predictions(spark, sf)))


def _stored_predictions(spark, sf) -> str:
    """The prediction table written by month below the checkpoint folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/predictions-{runs.new_run_id()}"
    sinks.write_predictions(base.predictions(spark, sf), path, "run")
    return path


@query("sliced_kpis", P + f""",
months AS (SELECT month, avg({ERR}) AS e FROM {PAIRS} t GROUP BY month),
hard AS (SELECT month FROM months WHERE e > (SELECT avg({ERR}) FROM {PAIRS} t)),
m AS (SELECT Store, avg({ERR}) AS mae, sqrt(avg((Demand - Predicted) * (Demand - Predicted))) AS rmse,
             avg({PCT}) AS mape, sum({ERR}) / (sum(abs(Demand)) + 1e-9) * 100 AS wmape,
             sum((Demand - Predicted) * (Demand - Predicted)) AS ss_res,
             var_pop(Demand) * count(Demand) AS ss_tot, count(*) AS n_rows
      FROM {PAIRS} t WHERE month IN (SELECT month FROM hard) GROUP BY Store)
SELECT Store, {R('mae', 4)} AS mae, {R('rmse', 4)} AS rmse, {R('mape', 4)} AS mape, {R('wmape', 4)} AS wmape,
       n_rows, {R('CASE WHEN ss_tot > 0 THEN (1 - ss_res / ss_tot) * 100 ELSE 100.0 END', 4)} AS r2,
       {R('greatest(0.0, 100 - mape)', 1)} AS accuracy
FROM m""", ids="P13 A30")
def q_sliced_kpis(spark, sf):
    """KPIs per store over the months whose error is above the run's, read from the stored table."""
    pred = spark.read.parquet(_stored_predictions(spark, sf))
    return reports.test_metrics(reports.slice_rows(pred, hard_months(pred)), by=["Store"])


def hard_months(pred):
    """Months whose mean error is above the mean over all rows, as a small stored table."""
    err = F.abs(F.col("Demand") - F.col("Predicted"))
    by_month = cut_lineage(reports.complete_pairs(pred).groupBy("month").agg(F.avg(err).alias("e"), F.sum(err).alias("s"),
                                                                               F.count(F.lit(1)).alias("n")))
    whole = by_month.agg((F.sum("s") / F.sum("n")).alias("w")).first()["w"]
    return by_month.where(F.col("e") > F.lit(whole)).select("month")


@query("saved_month_summary", P + f"""
SELECT month, count(*) AS count, {R('avg(Predicted)', 2)} AS mean_predicted FROM preds GROUP BY month""", ids="S16 K10")
def q_saved_month_summary(spark, sf):
    """Two published runs and one that never completed: readers see the newest complete one."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/forecasts-{runs.new_run_id()}"
    rows = cut_lineage(base.predictions(spark, sf).select("Store", "Product", "Date", "month",
                                                          F.col("Predicted").alias("Predicted_Demand")))
    by = {"forecasts": "month"}
    runs.publish(spark, root, {"forecasts": rows.withColumn("Predicted_Demand", F.lit(0.0))}, partition_by=by)
    runs.publish(spark, root, {"forecasts": rows}, partition_by=by, keep=1)
    runs.write_table(spark, root, runs.new_run_id(), "forecasts", rows.limit(1), "month")
    return runs.month_summary(runs.read(spark, root, "forecasts"))

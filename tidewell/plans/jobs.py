"""End-to-end jobs: what the reference runs as its pipeline, monitor and actuals cycle.

Each job is a composition of the operators, reading and writing month-partitioned
tables; nothing passes through the driver except key lists (years, months) and
one-row summaries.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.calendar import year_month
from tidewell.functions.keys import series_keys
from tidewell.operators import drift, features as fe, forecast, models, reconcile, reports, split, weekly
from tidewell.operators.models import ForecastModel
from tidewell.sources import ingest, runs, sinks
from tidewell.session import cut_lineage


def _ts() -> str:
    return _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d_%H%M%S")


def prepare(raw: DataFrame, out_path: str, rule: str = "closed", year_ceiling: int | None = None) -> DataFrame:
    """Raw daily rows -> weekly demand table, written partitioned by month."""
    w = weekly.weekly_rollup(raw, rule=rule, year_ceiling=year_ceiling).withColumn("month", year_month("Date"))
    sinks.by_month_parts(w).sortWithinPartitions(*series_keys(w), "Date") \
        .write.mode("overwrite").partitionBy("month").parquet(out_path)
    return w


def monitor(spark: SparkSession, history: DataFrame, upload: DataFrame, out_root: str,
            importance: DataFrame | None = None, model: ForecastModel | None = None,
            baseline_path: str | None = None) -> dict[str, DataFrame]:
    """D11 + D12: score every month of ``upload`` and compare it with the training years of
    ``history``, by ``model`` where one is given (its state, features and importances), else by
    the naive forecast. Thresholds depend on the features' importance (D6, D7): ``importance``
    (feature, importance), or |correlation| with demand when none is known.

    Writes predictions (K1b), the batch log (A19), the nested drift report (K3), the healing
    log with a decision per month (D12) and the run's summary (A24, F17); returns the month
    report, per-feature, decision, prediction and summary frames. Works with or without
    ``Store``. With ``baseline_path`` the baseline's value counts are read from the table stored
    there (``drift.store_baseline``), which the first run writes from the training years."""
    run_ts = _ts()
    run = F.lit(run_ts)
    train_years, _ = split.split_years(history)
    train = history.where(F.year("Date").isin(train_years))
    state = model.state if model is not None else fe.fit(train)
    base_feats, names = fe.transform(train, state)
    cur_feats, _ = fe.transform(upload, state)

    def scored(feats):
        if model is None:
            return feats.withColumn("_predicted", F.col("Rolling_Mean_4"))
        return models.predict(model.pipeline, fe.align_to(feats, model.features), "_predicted")
    error = F.col("Demand") - F.col("_predicted")
    # both sides feed every measure: the feature windows run once
    base_feats = cut_lineage(scored(base_feats).withColumn("error", error))
    cur_feats = scored(split.month_rows_at_least(cur_feats, 2))
    cur_feats = cut_lineage(cur_feats.withColumns({"YearMonth": year_month("Date"), "error": error}))
    pred = forecast.prediction_rows(cur_feats, "_predicted")
    sinks.write_monitor_predictions(pred, f"{out_root}/predictions", run_ts)
    if importance is None:
        importance = (drift.correlation_importance(base_feats, names) if model is None
                      else models.feature_importances(model.pipeline, model.features))
    categories = drift.importance_category(importance)
    stored = None
    if baseline_path is not None:
        if not runs.exists(spark, f"{baseline_path.rstrip('/')}/counts"):
            drift.store_baseline(spark, base_feats.withColumn("YearMonth", year_month("Date")), names, baseline_path,
                                 f"{out_root}/staging", "YearMonth")
        stored = drift.stored_baseline(spark, baseline_path)
    pf = cut_lineage(drift.feature_drift(base_feats, cur_feats, names, categories, month_col="YearMonth", stored=stored)
                     .withColumnRenamed("YearMonth", "month"))
    trend = drift.error_trend(base_feats, cur_feats, "YearMonth").withColumnRenamed("YearMonth", "month")
    months = cut_lineage(drift.month_severity(pf, trend))
    decided = drift.decisions(months, cur_feats.select(*series_keys(cur_feats), "Date", F.col("YearMonth").alias("month"), "error"))
    summary = drift.run_summary(months)
    sinks.append_log(drift.drift_report(pf, months).withColumn("run_ts", run), f"{out_root}/drift_history")
    sinks.append_log(decided.withColumn("run_ts", run), f"{out_root}/healing_actions")
    sinks.append_log(reports.batch_summary(pred).withColumn("run_ts", run), f"{out_root}/prediction_batches")
    sinks.append_log(summary.withColumn("run_ts", run), f"{out_root}/monitor_summary")
    return {"months": months, "per_feature": pf, "decisions": decided, "predictions": pred, "summary": summary}


def reconcile_actuals(spark: SparkSession, history_path: str, actuals_csv: str, forecasts_path: str,
                      out_root: str, baseline_mae: float | None = None,
                      model: ForecastModel | None = None) -> dict[str, DataFrame]:
    """M9: normalise an actuals upload, keep it by month (K6), compare it with the stored
    forecast of its month(s), replace those months in the history, and forecast the next month,
    by ``model`` where one is given, else by the naive mean (M8).

    Comparisons are kept one per month, with their nested rows per store (K11): a repeated
    upload replaces its month (K4). The next
    forecast goes to ``forecasts_path``, where the next cycle reads it (plus a copy per run
    in ``<forecasts_path>_history``). With ``baseline_mae`` the stored comparisons are rated
    (D9, D10). A column of the history that the upload lacks takes its latest value, a
    missing ``Store`` stays null."""
    upload = ingest.load_actuals(spark, actuals_csv).withColumn("month", year_month("Date"))
    staging = f"{out_root}/staging"
    sinks.replace_month_partitions(upload, f"{out_root}/actuals", staging)
    history = spark.read.parquet(history_path)
    fc = spark.read.parquet(forecasts_path)
    keys = [k for k in ("Store", "Product") if k in upload.columns and k in fc.columns]
    compared = reconcile.compare_actuals(upload, fc, keys) if keys else reconcile.compare_global(upload, fc)
    metrics = cut_lineage(reconcile.comparison_metrics(compared).withColumn("run_ts", F.lit(_ts())))
    comparisons_path = f"{out_root}/monthly_comparisons"
    sinks.replace_month_partitions(metrics, comparisons_path, staging)
    if "Product" in keys:
        sinks.replace_month_partitions(reconcile.comparison_records(compared), f"{out_root}/comparison_records", staging)
    upload = reconcile.fill_from_last_row(upload, history.drop("month"))
    for c, kind in history.drop("month").dtypes:
        if c not in upload.columns:
            upload = upload.withColumn(c, F.lit(None).cast(kind))
    sinks.replace_month_partitions(upload.select(*history.columns), history_path, staging)
    new_history = spark.read.parquet(history_path).drop("month")
    target = new_history.agg(F.date_format(F.add_months(F.max("Date"), 1), "yyyy-MM").alias("t")).first()["t"]
    if model is not None:
        nxt = forecast.month_ahead_model(new_history, model, target)
    else:
        scaffold = forecast.future_scaffold(new_history, target)
        nxt = forecast.month_ahead_naive(new_history.unionByName(scaffold, allowMissingColumns=True), target)
        nxt = nxt.withColumns({"CI_Lower": F.round(F.col("Predicted_Demand") * 0.85, 2),
                               "CI_Upper": F.round(F.col("Predicted_Demand") * 1.15, 2),
                               "Predicted_Demand": F.round("Predicted_Demand", 2)})
    sinks.write_forecast(cut_lineage(nxt), forecasts_path, forecasts_path + "_history", _ts())
    out = {"comparison": metrics, "next_forecast": nxt}
    if baseline_mae is not None:
        stored = spark.read.parquet(comparisons_path)
        out["drift"] = reconcile.comparison_drift(stored, F.lit(baseline_mae))
        out["overall"] = reconcile.overall_drift(out["drift"])
    return out

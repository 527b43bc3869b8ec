"""Registered queries: MLlib model jobs (rows-only checks) and the streaming operators' batch forms."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidewell.functions.calendar import shift_month, year_month
from tidewell.operators import features as fe
from tidewell.operators import forecast, models, reports, split
from tidewell.operators.families import feature_families
from tidewell.plans import base
from tidewell.plans.q_drift import month_reports
from tidewell.plans.registry import query
from tidewell.plans.sqlbase import R
from tidewell.session import cut_lineage, ensure_checkpoint_dir
from tidewell.sources import model_registry, runs
from tidewell.sources.tables import read_table
from tidewell.streaming.jobs import windowed_error_trend, windowed_event_values

# The reference's fast mode (50 trees, depth 3) for the registered model queries.
FAST = {"maxIter": 50, "maxDepth": 3, "stepSize": 0.1}


def _train_test(spark, sf):
    d = base.demand_once(spark, sf)
    train_years, test_year = split.split_years(d)
    train = d.where(F.year("Date").isin(train_years))
    state = fe.fit(train)
    feats, names = fe.transform(d, state)
    return (feats.where(F.year("Date").isin(train_years)), feats.where(F.year("Date") == test_year),
            fe.model_features(names))


@query("gbt_forecast", None, ids="M1 M5 K1")
def q_gbt_forecast(spark, sf):
    train, test, names = _train_test(spark, sf)
    model = models.fit_gbt(train, names, **FAST)
    scored = models.predict(model, test, "_p")
    return forecast.prediction_rows(scored, "_p")


@query("rf_interval", None, ids="M3 M4 F14 A18")
def q_rf_interval(spark, sf):
    train, test, names = _train_test(spark, sf)
    model = models.fit_gbt(train, names, **FAST)
    forest = models.fit_forest(train, names)
    scored = models.predict_with_interval(model, forest, test)
    return forecast.prediction_rows(scored, "Predicted", F.col("CI_Lower"), F.col("CI_Upper"))


@query("feature_importance", None, ids="M6 O2 P17 A36 O7")
def q_feature_importance(spark, sf):
    train, _, names = _train_test(spark, sf)
    model = models.fit_gbt(train, names, **FAST)
    imp = models.feature_importances(model, names)
    return feature_families(imp)


@query("heal_decisions", None, ids="M7")
def q_heal_decisions(spark, sf):
    """Only the months that the drift report marks are fitted."""
    train, test, names = _train_test(spark, sf)
    model = models.fit_gbt(train, names, **FAST)
    test = cut_lineage(test.withColumn("YearMonth", year_month("Date")))
    return models.heal_months(model, test, names, FAST, month_reports(spark, sf), parallelism=6)


@query("search_scores", None, ids="M2")
def q_search_scores(spark, sf):
    train, _, names = _train_test(spark, sf)
    grid = {"maxIter": [20, 50], "maxDepth": [2, 3], "stepSize": [0.1, 0.15]}
    found = models.search(cut_lineage(train), names, n_draws=3, grid=grid, parallelism=6)
    return models.search_scores(found, spark)


def _registered(spark, sf):
    """History, a registry below the checkpoint folder and a model trained on the first three
    years, saved there as two versions: without and with the interval forest."""
    d = base.demand_once(spark, sf)
    train_years, _ = split.split_years(d)
    in_train = F.year("Date").isin(train_years)
    state = fe.fit(d.where(in_train))
    feats, names = fe.transform(d, state)
    train, names = cut_lineage(feats.where(in_train)), fe.model_features(names)
    plain = models.ForecastModel(models.fit_gbt(train, names, **FAST), state, names)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/registry-{runs.new_run_id()}"
    metrics = reports.trainer_metrics(models.predict(plain.pipeline, train)).first().asDict()
    model_registry.register(spark, root, plain, FAST, metrics)
    forest = models.fit_forest(train, names)
    model_registry.register(spark, root, replace(plain, forest=forest), FAST, metrics)
    return d, root


@query("model_versions", None, ids="K8 K7")
def q_model_versions(spark, sf):
    _, root = _registered(spark, sf)
    v = model_registry.versions(spark, root)
    return v.select("version", "model_type", "params", "metrics", F.size("features").alias("features"),
                    "has_forest", "is_current")


@query("model_month_ahead", None, ids="M8 M4 M5 P10 K7 K8 J12")
def q_model_month_ahead(spark, sf):
    """The current version, read back from the registry, forecasts the month after the history."""
    d, root = _registered(spark, sf)
    model = model_registry.load(spark, root)
    target = d.agg(shift_month(year_month(F.max("Date")), 1).alias("t")).first()["t"]
    return forecast.month_ahead_model(d, model, target)


# ── streaming operators on the events table (batch form) ─────────────────
@query("events_daily_window", f"""
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start,
       CAST(date_trunc('day', ts) + INTERVAL 1 DAY AS TIMESTAMP) AS window_end,
       event_type, count(*) AS events, {R('avg(value)', 4)} AS mean_value
FROM events GROUP BY 1, 2, 3""", ids="T2")
def q_events_daily_window(spark, sf):
    # batch form: windows over the wall-clock timestamps, independent of the session time zone
    out = windowed_event_values(read_table(spark, sf, "events"), watermark=None)
    return out.withColumn("mean_value", F.round("mean_value", 4))


@query("events_error_trend", f"""
WITH b AS (SELECT avg(abs(value)) AS be FROM events),
c AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS n, avg(abs(value)) AS ce
      FROM events GROUP BY 1)
SELECT window_start, n, {R('be', 2)} AS baseline_error, {R('ce', 2)} AS current_error,
       {R('(ce - be) / (be + 1e-9)', 4)} AS error_increase, (ce - be) / (be + 1e-9) > 0.10 AS drift
FROM c, b""", ids="T3 D5")
def q_events_error_trend(spark, sf):
    ev = read_table(spark, sf, "events").withColumnRenamed("value", "error")
    return windowed_error_trend(ev, ev, watermark=None)

import datetime as dt

from pyspark.sql import functions as F

from tidewell.operators import features as fe
from tidewell.operators import models, reconcile, reports, split
from tidewell.sources import ingest, sinks

d = dt.date


def test_forecast_write_and_latest(spark, tmpdir_path):
    fc = spark.createDataFrame([("1", "1", d(2019, 2, 1), 5.0, "2019-02")],
                               "Store string, Product string, Date date, Predicted_Demand double, month string")
    cur, hist = f"{tmpdir_path}/current", f"{tmpdir_path}/history"
    sinks.write_forecast(fc, cur, hist, "20190101T000000")
    fc2 = fc.withColumn("Predicted_Demand", F.lit(7.0))
    sinks.write_forecast(fc2, cur, hist, "20190102T000000")
    assert [r.Predicted_Demand for r in spark.read.parquet(cur).collect()] == [7.0]
    assert spark.read.parquet(hist).count() == 2
    pred = f"{tmpdir_path}/pred"
    rows = spark.createDataFrame([("1", "1", d(2019, 2, 1), 1.0, 1.0, "2019-02")],
                                 "Store string, Product string, Date date, Demand double, Predicted double, month string")
    sinks.write_predictions(rows, pred, "r1")
    sinks.write_predictions(rows.withColumn("Predicted", F.lit(2.0)), pred, "r2")
    latest = ingest.latest_per_month(spark, pred)
    assert [r.Predicted for r in latest.collect()] == [2.0]


def test_state_and_runs(spark, tmpdir_path):
    df = spark.createDataFrame([("1", 10.0), ("1", 20.0), ("2", 5.0)], "Store string, Demand double")
    sinks.save_state_tables({"store_stats": fe.fit_group_stats(df, "Store")}, f"{tmpdir_path}/state")
    got = {r.Store: (r.Store_Mean, r.Store_Std) for r in spark.read.parquet(f"{tmpdir_path}/state/store_stats").collect()}
    assert got["1"][0] == 15.0 and got["2"] == (5.0, 0.0)
    sinks.write_run(df, f"{tmpdir_path}/runs", "a")
    sinks.write_run(df.limit(1), f"{tmpdir_path}/runs", "a")
    assert spark.read.parquet(f"{tmpdir_path}/runs").count() == 1


def test_comparison_records_nested(spark):
    c = spark.createDataFrame([("2024-01", "1", 10.0, 8.0, 2.0, 20.0), ("2024-01", "2", 5.0, 5.0, 0.0, 0.0)],
                              "month string, Product string, Actual double, Predicted double, Error double, Error_Pct double")
    r = reconcile.comparison_records(c).first()
    assert r.mae == 1.0 and [p.Product for p in r.products] == ["1", "2"]


def test_helpers(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (float("inf"), None)], "a double, b double")
    s = reports.sanitize(df).collect()
    assert s[0].a is None and s[1].a is None and s[0].b == 1.0
    al = fe.align_to(spark.createDataFrame([(None,)], "x double"), ["x", "y"]).first()
    assert al.x == 0.0 and al.y == 0.0
    big = spark.range(1000).withColumnRenamed("id", "k")
    a = sorted(r.k for r in split.sample_rows(big, 50, ["k"]).collect())
    b = sorted(r.k for r in split.sample_rows(big, 50, ["k"]).collect())
    assert a == b and len(a) == 50


def _small_features(spark):
    rows = [(d(2019, 1, 4) + dt.timedelta(days=7 * i), str(s), "1", float(10 + (i * 7 + s * 3) % 13), 2.0, i % 2)
            for i in range(40) for s in range(3)]
    df = spark.createDataFrame(rows, "Date date, Store string, Product string, Demand double, Price double, Promo int")
    out, names, _ = fe.feature_pipeline(df)
    return out, fe.model_features(names)


def test_search_and_heal(spark):
    df, names = _small_features(spark)
    res = models.search(df, names, n_draws=1, folds=2, grid={"maxIter": [3], "maxDepth": [2], "stepSize": [0.1]})
    assert res.params == {"maxIter": 3, "maxDepth": 2, "stepSize": 0.1} and res.mae >= 0
    model = models.fit_gbt(df, names, maxIter=3, maxDepth=2)
    month = df.where(F.month("Date") == 3).withColumn("YearMonth", F.lit("2019-03"))
    out = models.heal_month(model, month, names, {"maxIter": 3, "maxDepth": 2, "stepSize": 0.1})
    assert out["action"] in ("fine_tune", "rollback")
    assert out["model_updated"] == (out["action"] == "fine_tune")


def test_monitor_job(spark, tmpdir_path):
    from tidewell.plans import base, jobs
    hist = base.demand(spark, "/root/testdata/sf0.001")
    _, test_year = split.split_years(hist)
    out = jobs.monitor(spark, hist, hist.where(F.year("Date") == test_year), tmpdir_path)
    months = out["months"].collect()
    assert months and all(r.severity in ("none", "mild", "severe") for r in months)
    assert spark.read.parquet(f"{tmpdir_path}/predictions").count() > 0
    logged = {r.month: r for r in spark.read.parquet(f"{tmpdir_path}/healing_actions").collect()}
    assert {m.month for m in months} == set(logged)
    assert all(r.action == "monitor" for r in logged.values() if r.severity == "none")
    assert {r.action for r in logged.values()} <= {"monitor", "fine_tune"}
    reports_read = spark.read.parquet(f"{tmpdir_path}/drift_history").collect()
    assert len(reports_read) == len(months)
    features = out["per_feature"].select("feature").distinct().count()
    assert all(len(r.wasserstein) == features for r in reports_read)
    # dynamic thresholds: all three importance categories carry their own limits
    limits = {r[0]: r[1] for r in out["per_feature"].select("importance_category", "threshold_mild").distinct().collect()}
    assert limits["high"] < limits["medium"] < limits["low"]


def test_reconcile_job(spark, tmpdir_path):
    import os
    from tidewell.functions.calendar import year_month
    from tidewell.plans import jobs
    fix = os.path.join(os.path.dirname(__file__), "fixtures")
    hist = ingest.load_demand(spark, f"{fix}/base_history.csv").withColumn("month", year_month("Date"))
    hist.write.partitionBy("month").parquet(f"{tmpdir_path}/history")
    fc = spark.createDataFrame([("1", "1", d(2019, 1, 11), 50.0, "2019-01"), ("1", "1", d(2019, 1, 18), 50.0, "2019-01")],
                               "Store string, Product string, Date date, Predicted_Demand double, month string")
    fc.write.partitionBy("month").parquet(f"{tmpdir_path}/forecasts")
    out = jobs.reconcile_actuals(spark, f"{tmpdir_path}/history", f"{fix}/2019-01_actual.csv",
                                 f"{tmpdir_path}/forecasts", tmpdir_path)
    m = out["comparison"].first()
    assert m.month == "2019-01" and m.mae == 7.0          # |mean(99, 15) - 50| = 7
    h = spark.read.parquet(f"{tmpdir_path}/history")
    assert sorted(r.Demand for r in h.where("month = '2019-01'").collect()) == [15.0, 99.0]
    assert out["next_forecast"].count() > 0


def test_cycle_closes_over_two_months(spark, tmpdir_path):
    import os
    from tidewell.functions.calendar import year_month
    from tidewell.plans import jobs
    fix = os.path.join(os.path.dirname(__file__), "fixtures")
    history, forecasts = f"{tmpdir_path}/history", f"{tmpdir_path}/forecasts"
    ingest.load_demand(spark, f"{fix}/base_history.csv").withColumn("month", year_month("Date")) \
        .write.partitionBy("month").parquet(history)
    spark.createDataFrame([("1", "1", d(2019, 1, 11), 50.0, "2019-01")],
                          "Store string, Product string, Date date, Predicted_Demand double, month string") \
        .write.partitionBy("month").parquet(forecasts)
    for _ in range(2):                               # a repeated upload replaces its month
        jobs.reconcile_actuals(spark, history, f"{fix}/2019-01_actual.csv", forecasts, tmpdir_path)
    assert [r.month for r in spark.read.parquet(f"{tmpdir_path}/monthly_comparisons").collect()] == ["2019-01"]
    feb = {r.Date: r.Predicted_Demand for r in spark.read.parquet(forecasts).where("month = '2019-02'").collect()}
    assert feb[d(2019, 2, 1)] == 57.0                # mean(99, 15)
    csv = f"{tmpdir_path}/2019-02_actual.csv"
    with open(csv, "w") as f:
        f.write("Date,Store,Product,Demand\n01-02-2019,1,1,60\n")
    out = jobs.reconcile_actuals(spark, history, csv, forecasts, tmpdir_path, baseline_mae=10.0)
    got = out["comparison"].first()                  # finds the forecast the cycle before wrote
    expected = sum(feb.values()) / len(feb)
    assert got.month == "2019-02" and abs(got.mae - abs(60 - expected)) < 0.01
    assert {r.month for r in out["drift"].collect()} == {"2019-01", "2019-02"}
    assert out["overall"].first().months_used == 2


def test_monitor_and_forecast_without_store(spark, tmpdir_path):
    from tidewell.operators import analysis, forecast
    from tidewell.plans import jobs
    rows = [(d(2016, 1, 1) + dt.timedelta(days=7 * i), p, float(10 + (i * 7 + len(p)) % 13)) for i in range(208) for p in ("a", "bb")]
    df = spark.createDataFrame(rows, "Date date, Product string, Demand double")
    out = jobs.monitor(spark, df, df.where(F.year("Date") == 2019), tmpdir_path)
    assert out["decisions"].count() == out["months"].count() == 12
    assert "Store" not in out["predictions"].columns
    full = df.union(forecast.future_scaffold(df, "2020-01").select("Date", "Product", "Demand"))
    assert forecast.month_ahead_naive(full, "2020-01").count() == 2 * 5
    assert analysis.inspect(df).first().stores == 0 and reconcile.cycle_status(df).first().stores == 0


def test_wide_heatmap_error_columns_and_json_log(spark, tmpdir_path):
    pm = spark.createDataFrame([("1", "2019-01", 10.4), ("1", "2019-02", 20.6), ("2", "2019-01", 5.0)],
                               "Product string, month string, demand double")
    wide = {r.Product: (r["2019-01"], r["2019-02"]) for r in reports.heatmap_wide(pm, ["2019-01", "2019-02"]).collect()}
    assert wide == {"1": (10.0, 21.0), "2": (5.0, None)}
    p = spark.createDataFrame([(10.0, 7.5)], "Demand double, Predicted double")
    r = reports.with_error_columns(p).first()
    assert r.Abs_Error == 2.5 and r.Error_Pct == 25.0
    path = f"{tmpdir_path}/log.json"
    with open(path, "w") as f:
        f.write('[{"month": "2019-01", "count": 3, "mean_pred": 1.5}, {"month": "2019-02", "count": 4, "mean_pred": 2.0}]')
    log = ingest.read_json_log(spark, path)
    assert sorted(r.month for r in log.collect()) == ["2019-01", "2019-02"]


def test_latest_run_keeps_every_file_of_a_month(spark, tmpdir_path):
    from pyspark.sql import functions as F

    from tidewell.sources import ingest, sinks
    base = spark.range(2000).select(F.lit("2020-01").alias("month"), F.col("id").alias("Store"),
                                    (F.col("id") % 7).alias("Product"), F.lit("2020-01-03").alias("Date"))
    for run in ("20200101", "20200102"):
        sinks.write_predictions(base.withColumn("Predicted", F.lit(run)), f"{tmpdir_path}/p", run)
    got = ingest.latest_per_month(spark, f"{tmpdir_path}/p")
    assert got.count() == 2000
    assert [r[0] for r in got.select("Predicted").distinct().collect()] == ["20200102"]


def test_halves_keep_null_stores_and_work_without_store(spark):
    from tidewell.operators import split
    rows = [("2020-01", None, "a", 1), ("2020-01", None, "a", 2), ("2020-01", "s", "a", 1), ("2020-01", "s", None, 1)]
    df = spark.createDataFrame(rows, "month string, Store string, Product string, Date int")
    got = {(r["Store"], r["Product"], r["Date"]): (r["position"], r["half"]) for r in split.validation_halves(df).collect()}
    assert got == {(None, "a", 1): (1, "first"), (None, "a", 2): (2, "first"),
                   ("s", None, 1): (3, "second"), ("s", "a", 1): (4, "second")}
    assert split.validation_halves(df.drop("Store").dropDuplicates(["Product", "Date"])).count() == 3


def test_dedupe_keeps_the_last_row_of_a_file(spark):
    from tidewell.operators.reconcile import dedupe_last, union_sources
    a = spark.createDataFrame([("p", 1), ("p", 2), ("q", 5)], "Product string, Demand int").coalesce(1)
    u = union_sources([a])
    got = {r["Product"]: r["Demand"] for r in dedupe_last(u, ["Product"], order=("source_seq", "row_seq")).collect()}
    assert got == {"p": 2, "q": 5}


def test_checkpoint_folder_must_be_set_off_local():
    import pytest

    from tidewell.session import ensure_checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())

"""Published runs, model registry, model-based forecast, gated heal, stream ledger, cycle
status, grouped and sliced reports."""

import datetime as dt
import itertools
import os

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tidewell.operators import drift, families, features as fe, forecast, models, reconcile, reports
from tidewell.plans import jobs as plan_jobs
from tidewell.sources import model_registry, runs, sinks
from tidewell.streaming import jobs

D = dt.date


def weekly(spark, weeks=30, stores=("a", "b"), products=("1", "2"), demand=lambda i, s, p: 10.0 + i):
    rows = [(D(2019, 1, 4) + dt.timedelta(7 * i), s, p, float(demand(i, s, p)), 2.0 + (i % 3), i % 2)
            for i in range(weeks) for s in stores for p in products]
    return spark.createDataFrame(rows, "Date date, Store string, Product string, Demand double, Price double, Promo int")


def linear(spark, history, names, target="Demand"):
    """A pipeline trained on ``names`` whose forecast is known: least squares."""
    state = fe.fit(history)
    feats, _ = fe.transform(history, state)
    lr = LinearRegression(featuresCol="features", labelCol=target, regParam=0.0, solver="normal")
    train = fe.align_to(feats, names).where(F.col("Date") > D(2019, 4, 1))
    return models.ForecastModel(Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), lr]).fit(train),
                                state, names)


# ── published runs ─────────────────────────────────────────────────────────
def test_runs_become_visible_whole(spark, tmpdir_path):
    root = f"{tmpdir_path}/runs"
    with pytest.raises(LookupError):
        runs.resolve(spark, root)
    one = runs.publish(spark, root, {"t": spark.range(3), "u": spark.range(1)}, {"by": "x"})
    two = runs.publish(spark, root, {"t": spark.range(5)})
    half = runs.new_run_id()
    runs.write_table(spark, root, half, "t", spark.range(9))            # its job died here
    assert runs.read(spark, root, "t").count() == 5 and runs.resolve(spark, root).run_id == two
    assert runs.read(spark, root, "t", one).count() == 3 and runs.resolve(spark, root, one).info == {"by": "x"}
    with pytest.raises(LookupError):
        runs.read(spark, root, "u")
    with pytest.raises(LookupError):
        runs.resolve(spark, root, half)
    runs.complete(spark, root, half, ["t"])
    assert runs.read(spark, root, "t").count() == 9
    assert runs.purge(spark, root, keep=1) == sorted([one, two])
    assert runs.read(spark, root, "t").count() == 9 and runs.children(spark, f"{root}/data") == [half]


def test_saved_state_transforms_like_the_fitted_one(spark, tmpdir_path):
    hist = weekly(spark).withColumn("Seg", F.when(F.col("Store") == "a", "x").otherwise("y"))
    state = fe.fit(hist)
    feats, names = fe.transform(hist, state)
    fe.save_state(state, names, f"{tmpdir_path}/state", spark)
    again, saved_names = fe.load_state(spark, f"{tmpdir_path}/state")
    feats2, names2 = fe.transform(hist.withColumn("Seg", F.when(F.col("Store") == "a", "x")), again)
    assert names2 == saved_names == names
    same = fe.transform(hist, again)[0]
    assert sorted(map(str, feats.collect())) == sorted(map(str, same.collect()))
    assert {r.Seg_Encoded for r in feats2.where("Store = 'b'").collect()} == {-1}


# ── registry ───────────────────────────────────────────────────────────────
def test_registry_versions_and_pointer(spark, tmpdir_path):
    hist = weekly(spark)
    model = linear(spark, hist, ["Lag_1"])
    root = f"{tmpdir_path}/models"
    assert model_registry.current_version(spark, root) is None
    with pytest.raises(LookupError):
        model_registry.load(spark, root)
    v1 = model_registry.register(spark, root, model, {"maxIter": 5}, {"MAE": 1})
    v2 = model_registry.register(spark, root, model, {"maxIter": 9}, {"MAE": 0.5})
    table = {r.version: r for r in model_registry.versions(spark, root).collect()}
    assert table[v1].params["maxIter"] == "5" and table[v2].metrics == {"MAE": 0.5}
    assert (table[v1].is_current, table[v2].is_current) == (False, True)
    model_registry.switch(spark, root, v1)
    assert model_registry.load(spark, root).version == v1
    with pytest.raises(LookupError):
        model_registry.switch(spark, root, "v-none")
    a, b = (forecast.month_ahead_model(hist, model_registry.load(spark, root, v), "2019-08") for v in (v1, v2))
    assert sorted(a.collect()) == sorted(b.collect()) == sorted(forecast.month_ahead_model(hist, model, "2019-08").collect())


# ── month-ahead forecast ───────────────────────────────────────────────────
def test_forecast_feeds_its_own_weeks(spark):
    hist = weekly(spark)                                    # demand rises by one a week: next = Lag_1 + 1
    model = linear(spark, hist, ["Lag_1"])
    last = 10.0 + 29
    got = forecast.month_ahead_model(hist, model, "2019-08")
    assert got.columns == ["Store", "Product", "Date", "month", "Predicted_Demand", "CI_Lower", "CI_Upper"]
    weeks = [D(2019, 8, 2) + dt.timedelta(7 * k) for k in range(5)]
    assert {(r.Store, r.Product, r.Date): r.Predicted_Demand for r in got.collect()} == \
        {(s, p, w): round(last + k + 1, 2) for s in "ab" for p in "12" for k, w in enumerate(weeks)}
    for r in got.collect():                                 # M4b
        assert r.CI_Lower == pytest.approx(r.Predicted_Demand * 0.85, abs=0.011)
        assert r.CI_Upper == pytest.approx(r.Predicted_Demand * 1.15, abs=0.011)
    # unknown demand read as 0: the second week sees a lag of 0, not the first week's forecast
    flat = {(r.Date, r.Predicted_Demand) for r in forecast.month_ahead_model(hist, model, "2019-08", recursive=False).collect()}
    assert flat == {(weeks[0], last + 1)} | {(w, 1.0) for w in weeks[1:]}


def test_forecast_aligns_to_the_models_columns(spark):
    hist = weekly(spark).withColumn("Extra", F.col("Price") * 3)
    model = linear(spark, hist, ["Lag_1", "Extra"])
    with_zero = linear(spark, hist, ["Lag_1", "Extra"])
    got = forecast.month_ahead_model(hist.drop("Extra"), model, "2019-08")       # column gone: read as 0
    lr = with_zero.pipeline.stages[-1]
    first = [r for r in got.collect() if r.Date == D(2019, 8, 2)][0]
    assert first.Predicted_Demand == pytest.approx(lr.intercept + lr.coefficients[0] * 39.0, abs=0.006)


def test_forecast_without_store_and_of_a_month_with_rows(spark):
    hist = weekly(spark, stores=("a",)).drop("Store")
    model = linear(spark, hist, ["Lag_1"])
    got = forecast.month_ahead_model(hist, model, "2019-08")
    assert "Store" not in got.columns and got.count() == 10
    known = forecast.month_ahead_model(hist, model, "2019-07").collect()         # rows there: scored as they are
    assert {(r.Date, r.Predicted_Demand) for r in known} == \
        {(D(2019, 7, 5) + dt.timedelta(7 * k), 10.0 + 26 + k) for k in range(4)}


def test_forest_interval_is_the_trees_deviation(spark):
    hist = weekly(spark, demand=lambda i, s, p: 20 + (i * 7) % 13 + (s == "a") * 5)
    model = linear(spark, hist, ["Lag_1", "Lag_2"])
    feats, _ = fe.transform(hist, model.state)
    forest = models.fit_forest(fe.align_to(feats, model.features), model.features, numTrees=7, maxDepth=3)
    rows = models.predict_with_interval(model.pipeline, forest, feats.where(F.col("Date") > D(2019, 6, 1))).collect()
    trees = forest.stages[-1].trees
    for r in rows[:20]:
        votes = [t.predict(VectorAssemblerRow([r.Lag_1, r.Lag_2])) for t in trees]
        half = 1.96 * float(np.std(votes))
        assert r.CI_Lower == pytest.approx(max(r.Predicted - half, 0.0)) and r.CI_Upper == pytest.approx(r.Predicted + half)


def VectorAssemblerRow(values):
    from pyspark.ml.linalg import Vectors
    return Vectors.dense(values)


# ── heal and search ────────────────────────────────────────────────────────
def test_heal_fits_only_drifted_months(spark, monkeypatch):
    hist = weekly(spark, weeks=26, demand=lambda i, s, p: 20 + (i * 7) % 13)
    model = linear(spark, hist, ["Lag_1"])
    feats = fe.transform(hist, model.state)[0].withColumn("YearMonth", F.date_format("Date", "yyyy-MM"))
    fitted = []

    def one(pipeline, rows, *args):
        fitted.append(rows.first().YearMonth)
        return {"action": "fine_tune", "improvement": 0.2, "model_updated": True}
    monkeypatch.setattr(models, "heal_month", one)
    sev = spark.createDataFrame([("2019-01", "none"), ("2019-02", "mild"), ("2019-03", "severe"), ("2020-01", "severe")],
                                "month string, severity string")
    got = {r.month: (r.severity, r.action, r.improvement, r.model_updated)
           for r in models.heal_months(model.pipeline, feats, ["Lag_1"], {}, sev).collect()}
    assert got == {"2019-01": ("none", "monitor", 0.0, False), "2019-02": ("mild", "fine_tune", 0.2, True),
                   "2019-03": ("severe", "fine_tune", 0.2, True), "2020-01": ("severe", "monitor", 0.0, False)}
    assert sorted(fitted) == ["2019-02", "2019-03"]


def test_search_scores_every_draw_and_fold(spark):
    hist = weekly(spark, weeks=30, demand=lambda i, s, p: 20 + (i * 7) % 13)
    feats, _ = fe.transform(hist, fe.fit(hist))
    found = models.search(feats, ["Lag_1", "Lag_2"], n_draws=2, grid={"maxIter": [2, 3], "maxDepth": [2], "stepSize": [0.1]})
    rows = models.search_scores(found, spark).collect()
    assert len(rows) == 4 and {r.fold for r in rows} == {0, 1}
    means = {i: sum(r.mae for r in rows if r.draw == i) / 2 for i in (0, 1)}
    chosen = {r.draw for r in rows if r.chosen}
    assert found.mae == pytest.approx(min(means.values())) and means[chosen.pop()] == pytest.approx(found.mae)


# ── stream ledger ──────────────────────────────────────────────────────────
UPLOAD = "Date date, Product string, Demand double"


def put(spark, folder, name, rows, at, schema=UPLOAD):
    part = f"{folder}-{name}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
    os.makedirs(folder, exist_ok=True)
    src = [f for f in os.listdir(part) if f.endswith(".parquet")][0]
    os.rename(f"{part}/{src}", f"{folder}/{name}.parquet")
    os.utime(f"{folder}/{name}.parquet", (at, at))


def uploads():
    jan, feb, mar = D(2019, 1, 4), D(2019, 2, 1), D(2019, 3, 1)
    return {"one": ([(jan, "p1", 1.0), (jan, "p2", 2.0), (feb, "p1", 3.0), (None, "p1", 0.0)], 1000),
            "two": ([(jan, "p1", 10.0), (jan, "p1", 11.0)], 2000),                # newest January: p2 is gone
            "three": ([(feb, "p3", 5.0), (mar, "p1", 6.0)], 1500)}


EXPECTED = {("2019-01", "p1", 11.0), ("2019-02", "p3", 5.0), ("2019-03", "p1", 6.0)}


@pytest.mark.parametrize("max_files", [1, 2, None])
def test_stream_month_replace_in_any_batching(spark, tmpdir_path, max_files):
    src = f"{tmpdir_path}/up"
    for name, (rows, at) in uploads().items():
        put(spark, src, name, rows, at)
    jobs.ingest_actuals_stream(spark, src, UPLOAD, f"{tmpdir_path}/t", f"{tmpdir_path}/ck", f"{tmpdir_path}/st",
                               max_files=max_files).awaitTermination()
    got = spark.read.parquet(f"{tmpdir_path}/t")
    assert {(r.month, r.Product, r.Demand) for r in got.collect()} == EXPECTED and got.count() == 3


@pytest.mark.parametrize("order", list(itertools.permutations(["one", "two", "three"]))[1::2])
def test_stream_late_arrival_of_older_uploads(spark, tmpdir_path, order):
    src = f"{tmpdir_path}/up"
    for name in order:                                     # a run of the stream per arrival
        put(spark, src, name, *uploads()[name])
        jobs.ingest_actuals_stream(spark, src, UPLOAD, f"{tmpdir_path}/t", f"{tmpdir_path}/ck",
                                   f"{tmpdir_path}/st").awaitTermination()
    got = spark.read.parquet(f"{tmpdir_path}/t")
    assert {(r.month, r.Product, r.Demand) for r in got.collect()} == EXPECTED
    ledger = jobs.read_ledger(spark, f"{tmpdir_path}/ck/month-ledger")
    assert {r.month: os.path.basename(r.f) for r in ledger.groupBy("month").agg(F.max_by("file", "mtime").alias("f")).collect()} \
        == {"2019-01": "two.parquet", "2019-02": "three.parquet", "2019-03": "three.parquet"}


@pytest.mark.parametrize("max_files", [1, 2, None])
def test_stream_part_files_are_one_upload(spark, tmpdir_path, max_files):
    src, at = f"{tmpdir_path}/up", 1000
    for day, products in ((D(2019, 1, 4), "abc"), (D(2019, 1, 11), "de")):       # the second write is the newer upload
        out = f"{src}-{day}"
        spark.createDataFrame([(day, p, 1.0) for p in products], UPLOAD).repartitionByRange(len(products), "Product").write.parquet(out)
        os.makedirs(src, exist_ok=True)
        for f in sorted(f for f in os.listdir(out) if f.endswith(".parquet")):
            os.rename(f"{out}/{f}", f"{src}/{f}")
            os.utime(f"{src}/{f}", (at, at))
            at += 10
    jobs.ingest_actuals_stream(spark, src, UPLOAD, f"{tmpdir_path}/t", f"{tmpdir_path}/ck", f"{tmpdir_path}/st",
                               max_files=max_files).awaitTermination()
    assert sorted(r.Product for r in spark.read.parquet(f"{tmpdir_path}/t").collect()) == ["d", "e"]


# ── cycle status ───────────────────────────────────────────────────────────
def test_cycle_status_steps(spark):
    hist = weekly(spark, weeks=8)                          # to 2019-02
    fc = spark.createDataFrame([("2019-03",)] * 3, "month string")
    act = spark.createDataFrame([(D(2019, 3, 1),)], "Date date")
    none = spark.createDataFrame([], "month string")

    def status(h, f, a):
        return reconcile.cycle_status(h, reconcile.month_state(h, f, a)).first()
    r = status(hist, fc, none)
    assert (r.waiting_for_upload, r.next_action, r.step) == ("2019-03", "Upload 2019-03 actual data", 2)
    r = status(hist, fc, act)
    assert (r.waiting_for_upload, r.next_action, r.step) == (None, "Predict 2019-03", 3)
    r = status(hist, none, none)
    assert (r.next_action, r.step, r.prediction_months) == ("Predict 2019-03", 1, 0)
    r = status(hist.limit(0), none, none)
    assert (r.next_action, r.step, r.total_rows) == ("Run initial pipeline", 0, 0)
    state = {m.month: m for m in reconcile.month_state(hist, fc, act).collect()}
    assert state["2019-03"].forecast_rows == 3 and not state["2019-03"].waiting_for_upload and state["2019-01"].history_rows == 16


# ── reports ────────────────────────────────────────────────────────────────
def predictions(spark):
    hist = weekly(spark, weeks=20, demand=lambda i, s, p: 10 + (i * 7) % 13 + (s == "a") * 3 + int(p))
    return forecast.prediction_rows(hist.withColumn("p", F.col("Demand") * 0.9 + 1), "p")


def test_grouped_reports_equal_the_five_reports_with_one_exchange(spark):
    pred = predictions(spark)
    grouped = reports.grouped_reports(pred)
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    for name in reports.REPORT_LEVELS:
        one = getattr(reports, name)(pred)
        same = reports.report_of(grouped, name).select(*one.columns)
        assert sorted(map(str, one.collect())) == sorted(map(str, same.collect())), name


def test_slices_prune_the_stored_months(spark, tmpdir_path):
    path = f"{tmpdir_path}/pred"
    sinks.write_predictions(predictions(spark), path, "r1")
    stored = spark.read.parquet(path)
    spark.createDataFrame([("2019-02", "severe"), ("2019-03", "none")], "month string, severity string").write.parquet(f"{tmpdir_path}/sev")
    chosen = spark.read.parquet(f"{tmpdir_path}/sev").where("severity = 'severe'")
    df = reports.slice_rows(stored, chosen, stores=["a"])
    assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString()
    listed = reports.slice_rows(stored, ["2019-02"], stores=["a"], products=["1"])
    assert "PartitionFilters: [month" in listed._jdf.queryExecution().executedPlan().toString().replace("isnotnull(month#", "month#")\
        or "2019-02" in listed._jdf.queryExecution().executedPlan().toString()
    assert {r.month for r in df.collect()} == {"2019-02"} and df.count() == 2 * listed.count()


def test_families_cover_every_feature(spark):
    hist = weekly(spark)
    _, names = fe.transform(hist, fe.fit(hist))
    df = spark.createDataFrame([(n,) for n in [*names, "Temp_Fuel", "Store_Holiday", "Weeks_To_Easter"]], "feature string")
    got = {r.feature: r.f for r in df.select("feature", families.feature_family("feature").alias("f")).collect()}
    assert got["Temp_Fuel"] == got["Store_Holiday"] == got["Lag_1_x_Price"] == "Interaction"
    assert got["Weeks_To_Easter"] == got["WeekOfYear"] == "Temporal" and got["Store_Mean"] == "Product Stats"
    assert {n for n, f in got.items() if f == "Raw Inputs"} == {"Price", "Promo"}
    import duckdb
    con = duckdb.connect()
    for n, f in got.items():
        assert con.execute(f"SELECT {families.feature_family_sql('feature')} FROM (SELECT ? AS feature)", [n]).fetchone()[0] == f


# ── jobs ───────────────────────────────────────────────────────────────────
def test_monitor_and_reconcile_with_a_model(spark, tmpdir_path):
    rows = weekly(spark, weeks=200, demand=lambda i, s, p: 20 + (i * 7) % 13 + (s == "a") * 5)
    hist, up = rows.where("Date < '2022-01-01'"), rows.where("Date >= '2022-01-01'")
    model = linear(spark, hist, ["Lag_1", "Rolling_Mean_4"])
    imp = spark.createDataFrame([("Lag_1", 0.7), ("Rolling_Mean_4", 0.3)], "feature string, importance double")
    out = plan_jobs.monitor(spark, rows, up, f"{tmpdir_path}/m", importance=imp, model=model)
    assert out["months"].count() == 10
    for _ in range(2):                                     # written by the first run, read by the second
        again = plan_jobs.monitor(spark, rows, up, f"{tmpdir_path}/m2", imp, model, f"{tmpdir_path}/baseline")
        assert sorted(map(str, again["months"].collect())) == sorted(map(str, out["months"].collect()))
    stored = spark.read.parquet(f"{tmpdir_path}/m/predictions")
    assert set(stored.columns) == {"Store", "Product", "Date", "Demand", "Predicted", "month", "run_ts"}     # K1b
    lr = model.pipeline.stages[-1]
    feats = {(r.Store, r.Product, r.Date): r for r in fe.transform(up, model.state)[0].collect()}
    for r in stored.collect():
        f = feats[(r.Store, r.Product, r.Date)]
        assert r.Predicted == pytest.approx(lr.intercept + lr.coefficients[0] * f.Lag_1 + lr.coefficients[1] * f.Rolling_Mean_4, abs=0.006)
    s = spark.read.parquet(f"{tmpdir_path}/m/monitor_summary").first()
    assert s.none_months + s.mild_months + s.severe_months == 10 and s.recommendation == drift.MONITOR_ADVICE[s.worst_severity]

    table = f"{tmpdir_path}/history"
    hist.withColumn("month", F.date_format("Date", "yyyy-MM")).write.partitionBy("month").parquet(table)
    fc = forecast.month_ahead_model(hist, model, "2022-01")
    fc.write.partitionBy("month").parquet(f"{tmpdir_path}/fc")
    csv = f"{tmpdir_path}/jan"
    (up.where("Date < '2022-02-01'").select(F.date_format("Date", "dd-MM-yyyy").alias("time"), F.col("Store").alias("location"),
                                             F.col("Product").alias("sku"), F.col("Demand").alias("actual demand"))
     .coalesce(1).write.option("header", True).csv(csv))
    got = plan_jobs.reconcile_actuals(spark, table, csv, f"{tmpdir_path}/fc", f"{tmpdir_path}/out", 1.0, model)
    assert got["comparison"].first().month == "2022-01"
    assert spark.read.parquet(f"{tmpdir_path}/out/actuals").count() == 16                                     # K6
    rec = spark.read.parquet(f"{tmpdir_path}/out/comparison_records")
    assert {(r.Store, len(r.products)) for r in rec.collect()} == {("a", 2), ("b", 2)}                        # K11
    nxt = spark.read.parquet(f"{tmpdir_path}/fc").where("month = '2022-02'")
    direct = forecast.month_ahead_model(spark.read.parquet(table).drop("month"), model, "2022-02")
    assert sorted(r.Predicted_Demand for r in nxt.collect()) == sorted(r.Predicted_Demand for r in direct.collect())
    assert runs.month_summary(spark.read.parquet(f"{tmpdir_path}/fc"), "2022-02").first()["count"] == 16
    assert runs.saved_comparison(spark.read.parquet(f"{tmpdir_path}/out/monthly_comparisons"), "2022-01").count() == 1

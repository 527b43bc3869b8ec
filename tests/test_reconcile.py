import datetime as dt

from pyspark.sql import functions as F

from tidewell.operators import reconcile, split


def test_comparison_golden(spark):
    # FIXTURES §4: recorded comparison of 2024-01
    pairs = [(203, 57.53), (205, 63.77), (154, 57.43), (270, 75.9), (236, 87.9)]
    act = spark.createDataFrame([("2024-01", str(i), float(a)) for i, (a, _) in enumerate(pairs)],
                                "month string, Product string, Demand double")
    fc = spark.createDataFrame([("2024-01", str(i), p) for i, (_, p) in enumerate(pairs)],
                               "month string, Product string, Predicted_Demand double")
    m = reconcile.comparison_metrics(reconcile.compare_actuals(act, fc, ["Product"])).first()
    assert (m.mae, m.rmse, m.mape) == (145.09, 148.35, 67.58)


def test_dedupe_and_replace(spark):
    d = dt.date
    hist = spark.createDataFrame([("1", "1", d(2019, 1, 4), 10.0), ("1", "1", d(2019, 2, 1), 11.0)],
                                 "Store string, Product string, Date date, Demand double")
    up = spark.createDataFrame([("1", "1", d(2019, 1, 4), 99.0), (None, "1", d(2019, 1, 11), 5.0)],
                               "Store string, Product string, Date date, Demand double")
    last = reconcile.dedupe_last(reconcile.union_sources([hist, up]))
    got = {(r.Store, r.Date): r.Demand for r in last.collect()}
    assert got[("1", d(2019, 1, 4))] == 99.0 and got[(None, d(2019, 1, 11))] == 5.0 and len(got) == 3
    rep = reconcile.replace_months(hist, up)
    assert sorted(r.Demand for r in rep.collect()) == [5.0, 11.0, 99.0]


def test_upsert_and_first(spark):
    log = spark.createDataFrame([("2019-01", 1.0), ("2019-02", 2.0)], "month string, mae double")
    new = spark.createDataFrame([("2019-02", 3.0)], "month string, mae double")
    assert sorted(tuple(r) for r in reconcile.upsert_by_month(log, new).collect()) == [("2019-01", 1.0), ("2019-02", 3.0)]
    recs = spark.createDataFrame([("2019-01", 0, 1.0), ("2019-01", 1, 9.0)], "month string, seq int, v double")
    assert reconcile.dedupe_first(recs, "month", "seq").first().v == 1.0


def test_overall_drift_last_three(spark):
    m = spark.createDataFrame([("2019-01", 100.0), ("2019-02", 5.0), ("2019-03", 5.0), ("2019-04", 5.0)],
                              "month string, error_increase_pct double")
    r = reconcile.overall_drift(m).first()
    assert r.avg_error_increase_pct == 5.0 and r.overall_severity == "none"


def test_year_split_overlap(spark):
    def frame(years):
        return spark.createDataFrame([(dt.date(y, 1, 4),) for y in years], "Date date")
    assert split.split_years(frame([2019, 2020])) == ([2019, 2020], 2020)
    assert split.split_years(frame([2019, 2020, 2021, 2022, 2023])) == ([2019, 2020, 2021], 2022)
    try:
        split.year_split(frame([2019, 2020, 2021]), allow_overlap=False)
        raise AssertionError("expected overlap error")
    except ValueError:
        pass


def test_validation_halves_positional(spark):
    d = dt.date
    rows = [("2019-01", s, p, d(2019, 1, k)) for s in ("a", "b") for p in ("x", "y") for k in (4, 11, 18)]
    df = spark.createDataFrame(rows, "month string, Store string, Product string, Date date")
    got = sorted((r.Store, r.Product, r.Date, r.half) for r in split.validation_halves(df).collect())
    expected = [(s, p, dd, "first" if i < 6 else "second")
                for i, (_, s, p, dd) in enumerate(sorted(rows, key=lambda r: (r[1], r[2], r[3])))]
    assert got == sorted(expected)


def test_fill_from_last_row_and_names(spark):
    d = dt.date
    hist = spark.createDataFrame([("1", "1", d(2019, 1, 4), 1.0, 2.5, None), ("1", "1", d(2019, 1, 11), 1.0, 3.5, None)],
                                 "Store string, Product string, Date date, Demand double, Price double, Promo int")
    up = spark.createDataFrame([("1", "1", d(2019, 2, 1), 9.0)], "Store string, Product string, Date date, Demand double")
    r = reconcile.fill_from_last_row(up, hist).first()
    assert r.Price == 3.5 and r.Promo == 0
    names = spark.createDataFrame([("7", "Widget")], "Product string, name string")
    df = spark.createDataFrame([("7",), ("8",), ("x",)], "Product string")
    got = {r.Product: r.name for r in reconcile.attach_names(df, names, "Product", "Product").collect()}
    assert got == {"7": "Widget", "8": "Product 8", "x": "x"}


def test_hot_store_halves_and_dedupe(spark):
    # one store carries a third of all rows: results stay exact (positions, latest source)
    d = dt.date
    rows = [("2019-01", "hot" if i % 3 == 0 else f"s{i % 7}", f"p{i % 5}", d(2019, 1, 1 + i % 28))
            for i in range(600)]
    df = spark.createDataFrame(rows, "month string, Store string, Product string, Date date").dropDuplicates()
    n = df.count()
    got = split.validation_halves(df).groupBy("half").count().collect()
    assert {r.half: r["count"] for r in got} == {"first": n // 2, "second": n - n // 2}
    u = reconcile.union_sources([df.withColumn("v", F.lit(1)), df.where("Store = 'hot'").withColumn("v", F.lit(2))])
    last = reconcile.dedupe_last(u, ["Store", "Product", "Date"])
    assert last.count() == n and last.where("Store = 'hot' AND v <> 2").count() == 0


def test_upload_range_pushed_to_scan(spark):
    from tidewell.sources.tables import raw_daily
    plan = raw_daily(spark, "/root/testdata/sf0.001", since="1999-01-01")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan

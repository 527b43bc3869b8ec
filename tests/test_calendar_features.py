import datetime as dt

from pyspark.sql import functions as F

from tidewell.functions.calendar import month_fridays, shift_month, week_end
from tidewell.operators import features as fe


def d(s):
    return dt.date.fromisoformat(s)


def test_week_rules_golden(spark):
    # FIXTURES §4: Tue 2019-01-01, Fri 2019-01-04, Sat 2019-01-05
    df = spark.createDataFrame([(d("2019-01-01"),), (d("2019-01-04"),), (d("2019-01-05"),)], "x date")
    rows = df.select(week_end("x", "closed").alias("c"), week_end("x", "strict").alias("s")).collect()
    assert [r.c for r in rows] == [d("2019-01-04"), d("2019-01-04"), d("2019-01-11")]
    assert [r.s for r in rows] == [d("2019-01-04"), d("2019-01-11"), d("2019-01-11")]


def test_month_helpers(spark):
    r = spark.range(1).select(shift_month(F.lit("2019-12"), 1).alias("n"), shift_month(F.lit("2019-01"), -1).alias("p"),
                              month_fridays(F.lit("2019-03")).alias("f")).first()
    assert r.n == "2020-01" and r.p == "2018-12"
    assert r.f == [d("2019-03-01"), d("2019-03-08"), d("2019-03-15"), d("2019-03-22"), d("2019-03-29")]


def test_lag_rolling_golden(spark):
    # FIXTURES §4: one series 10, 20, 30
    rows = [(d("2019-01-04"), "s", "p", 10.0), (d("2019-01-11"), "s", "p", 20.0), (d("2019-01-18"), "s", "p", 30.0)]
    df = spark.createDataFrame(rows, "Date date, Store string, Product string, Demand double")
    out = fe.add_series_features(df, ["Store", "Product"]).fillna(0).orderBy("Date").collect()
    assert [r.Lag_1 for r in out] == [15.0, 10.0, 20.0]
    assert [r.Rolling_Mean_3 for r in out] == [0.0, 10.0, 15.0]
    assert [round(r.Rolling_Std_3, 4) for r in out] == [0.0, 0.0, 7.0711]
    # rolling mean always between rolling min and max
    assert all(r.Rolling_Min_3 <= r.Rolling_Mean_3 <= r.Rolling_Max_3 for r in out[1:])


def test_feature_count_and_single_exchange(spark):
    rows = [(d("2019-01-04"), "1", "1", 10.0, 2.5, 0), (d("2019-01-11"), "1", "1", 20.0, 2.5, 1),
            (d("2019-01-04"), "2", "1", 5.0, 3.0, 0)]
    df = spark.createDataFrame(rows, "Date date, Store string, Product string, Demand double, Price double, Promo int")
    out, names, _ = fe.feature_pipeline(df)
    assert len(names) == 70 and names[:3] == ["Price", "Promo", "Month"]
    assert "Demand_vs_Store_Mean" in names and "Demand_vs_Store_Mean" not in fe.model_features(names)
    plan = fe.add_series_features(df, ["Store", "Product"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(Store") == 1
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_label_and_frequency_encoding(spark):
    train = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "c string")
    dictionary = fe.fit_label_dictionary(train, "c")
    assert sorted(tuple(r) for r in dictionary.collect()) == [("a", 0), ("b", 1)]
    new = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    enc = {r.c: r.c_Encoded for r in fe.label_encode(new, "c", dictionary).collect()}
    assert enc == {"a": 0, "z": -1, None: -1}
    freq = {r.c: r.c_Freq for r in fe.frequency_encode(train, "c").collect()}
    assert freq == {"a": 2.0, "b": 1.0, None: 0.0}

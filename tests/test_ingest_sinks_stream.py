import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidewell.sources import ingest, sinks
from tidewell.streaming import jobs

FIX = os.path.join(os.path.dirname(__file__), "fixtures")


def test_bom_header_and_aliases(spark):
    df = ingest.normalise_columns(ingest.read_csv_messy(spark, f"{FIX}/bom_padded_header.csv"))
    assert df.columns == ["Date", "Store", "Product", "Demand"]
    assert df.count() == 3


def test_quoted_rows_repaired(spark):
    df = ingest.load_demand(spark, f"{FIX}/quoted_rows.csv")
    assert sorted(r.Demand for r in df.collect()) == [5.0, 10.0, 20.0]
    assert df.schema["Date"].dataType.simpleString() == "date"


def test_mixed_dates_day_first(spark):
    df = ingest.load_demand(spark, f"{FIX}/mixed_dates.csv")
    got = sorted(r.Date for r in df.collect())
    assert got == [dt.date(2019, 1, 25), dt.date(2019, 2, 1), dt.date(2019, 2, 13)]


def test_bad_demand_dropped_or_rejected(spark):
    assert ingest.load_demand(spark, f"{FIX}/bad_demand.csv").count() == 1
    with pytest.raises(ValueError):
        ingest.load_actuals(spark, f"{FIX}/bad_demand.csv")


def test_missing_required(spark):
    with pytest.raises(ValueError, match="Product"):
        ingest.load_demand(spark, f"{FIX}/missing_product.csv")


def test_actuals_wide_aliases(spark):
    df = ingest.load_actuals(spark, f"{FIX}/flex_actuals.csv")
    assert set(df.columns) >= {"Date", "Store", "Product", "Demand"}
    assert df.count() == 2


def test_history_last_upload_wins(spark):
    h = ingest.load_history(spark, f"{FIX}/base_history.csv",
                            [f"{FIX}/2019-02_actual.csv", f"{FIX}/2019-01_actual.csv"])
    got = {(r.Product, r.Date): r.Demand for r in h.collect()}
    assert got[("1", dt.date(2019, 1, 11))] == 99.0
    assert got[("1", dt.date(2019, 1, 18))] == 16.0     # later file (name order) wins
    assert len(got) == 5


def test_profile_roles(spark):
    df = spark.createDataFrame([(float(i), i % 2, "x" if i % 3 else "y") for i in range(300)],
                               "Price double, Promo int, Seg string")
    roles = ingest.profile_roles(df)
    assert roles["numeric_features"] == ["Price"] and roles["categorical_features"] == ["Promo", "Seg"]


def test_month_replace_and_latest(spark, tmpdir_path):
    d = dt.date
    table = f"{tmpdir_path}/pred"
    df = spark.createDataFrame([("1", "1", d(2019, 1, 4), 1.0, "2019-01"), ("1", "1", d(2019, 2, 1), 2.0, "2019-02")],
                               "Store string, Product string, Date date, Demand double, month string")
    df.write.partitionBy("month").parquet(table)
    new = spark.createDataFrame([("1", "1", d(2019, 2, 8), 9.0, "2019-02")],
                                "Store string, Product string, Date date, Demand double, month string")
    sinks.replace_month_partitions(new, table, f"{tmpdir_path}/staging")
    got = sorted((r.month, r.Demand) for r in spark.read.parquet(table).collect())
    assert got == [("2019-01", 1.0), ("2019-02", 9.0)]
    assert ingest.read_month(spark, table, "2019-02").count() == 1
    assert [r.month for r in ingest.months_available(spark, table).collect()] == ["2019-01", "2019-02"]


def test_streaming_windows_and_ingest(spark, tmpdir_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = f"{tmpdir_path}/events"
    ev.write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    jobs.run_to_memory(jobs.windowed_event_values(stream), "ev_windows", f"{tmpdir_path}/ck1")
    got = spark.sql("SELECT sum(events) AS n FROM ev_windows").first().n
    # everything but the windows still open at the watermark is emitted in append mode
    assert 0 < got <= ev.count()
    batch = jobs.windowed_event_values(ev).agg(F.sum("events")).first()[0]
    assert batch == ev.count()

    d = dt.date
    up = f"{tmpdir_path}/uploads"
    spark.createDataFrame([("1", "1", d(2019, 1, 4), 3.0), ("1", "1", d(2019, 1, 11), 4.0)],
                          "Store string, Product string, Date date, Demand double").write.parquet(up)
    table = f"{tmpdir_path}/history"
    q = jobs.ingest_actuals_stream(spark, up, "Store string, Product string, Date date, Demand double", table,
                                   f"{tmpdir_path}/ck2", f"{tmpdir_path}/stage")
    q.awaitTermination()
    assert spark.read.parquet(table).count() == 2

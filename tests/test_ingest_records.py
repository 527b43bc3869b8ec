"""Records over several lines, many files of several layouts, roles by sketches."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import features as fe
from tidewell.sources import ingest

FIX = os.path.join(os.path.dirname(__file__), "fixtures")


def write(path, text):
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)
    return str(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quoted_line_breaks_golden(spark):
    df = ingest.load_demand(spark, f"{FIX}/multiline.csv")
    got = {(r.Product, r.Date): (r.Demand, r.Note) for r in df.collect()}
    assert got == {("1", dt.date(2019, 1, 4)): (10.0, 'first line\nsecond, with "quotes"'),
                   ("2", dt.date(2019, 1, 11)): (20.0, "plain"),
                   ("3", dt.date(2019, 1, 18)): (30.0, "\n\nthree\n"),
                   ("4", dt.date(2019, 1, 25)): (40.0, None)}


def test_whole_rows_quoted_with_line_breaks(spark):
    got = sorted((r.Product, r.Demand, r.Note) for r in ingest.load_demand(spark, f"{FIX}/multiline_wrapped.csv").collect())
    assert got == [("1", 10.0, "a\nb"), ("2", 20.0, "c")]


def test_rows_with_every_field_quoted_stay_fields(spark, tmp_path):
    p = write(tmp_path / "q.csv", '"Date","Product","Demand"\n"04-01-2019","1","5"\n"11-01-2019","a,b","6"\n')
    got = sorted((r.Product, r.Demand) for r in ingest.load_demand(spark, p).collect())
    assert got == [("1", 5.0), ("a,b", 6.0)]


def test_records_across_file_blocks(spark, tmp_path):
    # blocks of 200 bytes: quoted fields cross many block borders
    rnd = random.Random(5)
    rows = [(f"p{i}", i, "\n".join("x" * rnd.randint(0, 60) for _ in range(rnd.randint(1, 12)))) for i in range(60)]
    text = "Date,Product,Demand,Note\n" + "".join(f'04-01-2019,{p},{d},"{n}"\n' for p, d, n in rows)
    p = write(tmp_path / "big.csv", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        assert ingest.block_stats(ingest.read_lines(spark, p)).count() > 20
        got = {(r.Product, int(r.Demand), r.Note or "") for r in ingest.load_demand(spark, p).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == set(rows)


def test_many_layouts_one_scan(spark, tmp_path):
    base = write(tmp_path / "base.csv", "Date,Store,Product,Demand,Price\n04-01-2019,s1,1,10,2.5\n11-01-2019,s1,1,11,2.5\n")
    ups = [write(tmp_path / "2019-02_actual.csv", "Week,Shop,SKU,Units\n01-02-2019,s1,1,20\n11-01-2019,s1,1,99\n"),
           write(tmp_path / "2019-03_actual.csv", '"Date,Store,Product,Demand"\n"01-03-2019,s1,1,30"\n"01-03-2019,s1,1,31"\n'),
           write(tmp_path / "2019-04_actual.csv", "Demand,Date,Item,Promo\n40,2019-13-40,1,1\n41,4/26/2019,1,0\n42,4/28/2019,1,0\n")]
    h = ingest.load_history(spark, base, list(reversed(ups)))
    got = {(r.Store, r.Date): (r.Demand, r.Price, r.Promo) for r in h.collect()}
    d = dt.date
    assert got == {("s1", d(2019, 1, 4)): (10.0, 2.5, None), ("s1", d(2019, 1, 11)): (99.0, None, None),
                   ("s1", d(2019, 2, 1)): (20.0, None, None), ("s1", d(2019, 3, 1)): (31.0, None, None),
                   (None, d(2019, 4, 26)): (41.0, None, 0.0), (None, d(2019, 4, 28)): (42.0, None, 0.0)}
    more = [write(tmp_path / f"2020-{i:02}_actual.csv", f"Week,Shop,SKU,Units\n01-{i:02}-2020,s1,1,{i}\n") for i in range(1, 13)]
    few, many = (plan(ingest.load_history(spark, base, u)) for u in (ups, ups + more))
    assert few.count("FileScan text") == many.count("FileScan text") >= 1


def test_missing_column_named(spark, tmp_path):
    a = write(tmp_path / "a.csv", "Date,Product,Demand\n04-01-2019,1,5\n")
    b = write(tmp_path / "b.csv", "Date,Demand\n04-01-2019,5\n")
    with pytest.raises(ValueError, match="Product"):
        ingest.load_files(spark, [a, b])


def test_upload_faults_in_one_message(spark, tmp_path):
    p = write(tmp_path / "u.csv", "Date,Product,Demand\nxx,1,5\n04-01-2019,1,abc\n")
    with pytest.raises(ValueError, match="1 rows without a usable Date.*1 rows without a usable Demand"):
        ingest.load_actuals(spark, p)


def test_report_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, "m")], "Demand double, Predicted double, month string")
    assert ingest.report_columns(df).columns == ["actual", "prediction", "month"]


def test_roles_near_the_limits_without_expand(spark):
    n = 3000
    df = spark.range(n).select(*[(F.col("id") % k).cast("string").alias(f"s{k}") for k in (2, 49, 50, 51, 400)],
                               *[(F.col("id") % k).cast("int").alias(f"n{k}") for k in (2, 10, 11, 40)],
                               F.lit(None).cast("string").alias("empty"))
    roles = ingest.profile_roles(df)
    assert roles["categorical_features"] == ["s2", "s49", "n2", "n10", "empty"]
    assert roles["numeric_features"] == ["n11", "n40"]
    assert fe.feature_roles(df)[2] == ["s2", "s49", "empty"]
    sketch = df.agg(*[F.approx_count_distinct(c, 0.02) for c in df.columns])
    assert "Expand" not in plan(sketch)
    short = df.limit(300).coalesce(1)                   # 10 values are not under 1 % of 300 rows
    assert ingest.profile_roles(short)["categorical_features"] == ["s2", "s49", "n2", "empty"]

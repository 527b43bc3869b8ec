"""Importance queries on tables whose lines are all promoted: Promo does not vary over the baseline."""
import datetime as dt
import random
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from tidewell.operators import drift

TABLES = ("nation", "supplier", "part", "lineitem")


def _tables(spark, path):
    rng = random.Random(11)
    lines = [(p, s, float(rng.randint(1, 50)), round(rng.uniform(100, 900), 2), 0.1,
              dt.datetime(2015, 1, 5) + dt.timedelta(weeks=w, days=rng.randint(0, 4)))
             for w in range(200) for p in (1, 2, 3) for s in (1, 2, 3) for _ in range(2)]
    rows = {"nation": ([(1, 0), (2, 1), (3, 2)], "n_nationkey int, n_regionkey int"),
            "supplier": ([(1, 1), (2, 2), (3, 3)], "s_suppkey bigint, s_nationkey int"),
            "part": ([(1, "Brand#11"), (2, "Brand#12"), (3, "Brand#21")], "p_partkey bigint, p_brand string"),
            "lineitem": (lines, "l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, "
                                "l_discount double, l_shipdate timestamp_ntz")}
    for name in TABLES:
        spark.createDataFrame(*rows[name]).coalesce(1).write.parquet(f"{path}/{name}.parquet")


def _standard(sql):
    """The SQL with the standard's corr, null where a column does not vary: DuckDB's is NaN there,
    which its round to decimals then refuses."""
    return re.sub(r"(corr\(\w+, Demand\))", r"(CASE WHEN isnan(\1) THEN NULL ELSE \1 END)", sql)


def _plain(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows)


def test_correlation_importance_of_constants(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(size=60)
    x = y + rng.normal(size=60)
    rows = [(float(a), 0.1, float(b), None, float(a) if i < 40 else None, 4.0 if i == 7 else None)
            for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x double, flat double, Demand double, gone double, part double, one double")
    names = ["x", "flat", "gone", "part", "one"]
    got = {r.feature: r.importance for r in drift.correlation_importance(df, names).collect()}
    assert abs(got["x"] - abs(np.corrcoef(x, y)[0, 1])) < 1e-12
    assert abs(got["part"] - abs(np.corrcoef(x[:40], y[:40])[0, 1])) < 1e-12
    assert got["flat"] == got["gone"] == got["one"] == 0.0
    # a target that does not vary
    got = {r.feature: r.importance for r in drift.correlation_importance(df, ["x", "Demand"], "flat").collect()}
    assert got == {"x": 0.0, "Demand": 0.0}


@pytest.mark.parametrize("name", ["drift_severity_dynamic", "feature_families", "importance_thresholds"])
def test_queries_with_a_constant_feature(spark, tmpdir_path, name):
    _tables(spark, tmpdir_path)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmpdir_path}/{t}.parquet/*.parquet')")
    assert con.execute("SELECT count(*) FROM lineitem WHERE l_discount < 0.09").fetchall() == [(0,)]
    df = E.queries()[name](spark, tmpdir_path)
    res = con.execute(_standard(E.oracle_sql()[name]))
    assert _plain([tuple(r) for r in df.collect()], df.columns) == _plain(res.fetchall(), [d[0] for d in res.description])

import duckdb
import pytest

import __spark_entry__ as E
from tidewell.plans import catalog
from tidewell.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
FAST = ["weekly_rollup_closed", "demand_metrics", "feature_table", "naive_predictions", "product_forecast",
        "test_metrics", "compare_actuals", "dedupe_last", "future_scaffold", "events_daily_window"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 12 and "severity" in df.columns


def test_registry_contract():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    own = set(catalog.queries())
    rows_only = own - set(sqls)
    assert rows_only == {"gbt_forecast", "rf_interval", "feature_importance", "heal_decisions", "search_scores",
                         "model_versions", "model_month_ahead"}


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle_smoke(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)

    def norm(rows, cols):
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        return sorted(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows)
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(res.fetchall(), ocols)

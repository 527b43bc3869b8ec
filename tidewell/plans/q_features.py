"""Registered queries: the feature table and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators import features as fe
from tidewell.operators import split
from tidewell.plans import base
from tidewell.plans.registry import query
from tidewell.plans.sqlbase import BASE_SPLIT, CAL_SQL, R, series_sql, with_ctes
from tidewell.sources.tables import RAW_DAILY_SQL, read_table

KEYS = ["Store", "Product", "Date"]
LAG_COLS = [f"Lag_{k}" for k in fe.LAGS]
ROLL_COLS = [f"Rolling_{s}_{n}" for n in fe.ROLL_WINDOWS for s in ("Mean", "Std", "Max", "Min")]
MOM_COLS = ["Momentum_3", "Momentum_6", "Volatility_4", "Volatility_8"]
CAL_TRIG = ["Month_Sin", "Month_Cos", "Quarter_Sin", "Quarter_Cos", "Week_Sin", "Week_Cos"]


def round_doubles(df: DataFrame, k: int = 4, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column at the report edge."""
    return df.withColumns({f.name: F.round(f.name, k) for f in df.schema.fields
                           if isinstance(f.dataType, T.DoubleType) and f.name not in skip})


def _features(spark, sf):
    d = base.demand_once(spark, sf)
    train, _, _, _ = split.year_split(d)
    state = fe.fit(train)
    out, names = fe.transform(d, state)
    return out, names


# ── calendar ───────────────────────────────────────────────────────────────
_CAL_INT_SQL = (CAL_SQL.replace("month(Date) AS Month", "CAST(month(Date) AS INTEGER) AS Month")
                .replace("quarter(Date) AS Quarter", "CAST(quarter(Date) AS INTEGER) AS Quarter")
                .replace("year(Date) AS Year", "CAST(year(Date) AS INTEGER) AS Year")
                .replace("dayofyear(Date) AS DayOfYear", "CAST(dayofyear(Date) AS INTEGER) AS DayOfYear")
                .replace("weekofyear(Date) AS WeekOfYear", "CAST(weekofyear(Date) AS INTEGER) AS WeekOfYear"))


@query("calendar_features", with_ctes(*BASE_SPLIT) + f""",
cal AS (SELECT Store, Product, Date, {_CAL_INT_SQL} FROM demand)
SELECT * EXCLUDE ({', '.join(CAL_TRIG)}), {', '.join(f"{R(c, 6)} AS {c}" for c in CAL_TRIG)}
FROM cal""", ids="F1 F2 F3 F4 F5")
def q_calendar(spark, sf):
    return round_doubles(fe.add_calendar(base.demand(spark, sf).select(*KEYS)), 6)


# ── series ─────────────────────────────────────────────────────────────────
def _series_query(cols):
    sel = ", ".join(f"{R(f'coalesce({c}, 0.0)', 6)} AS {c}" for c in cols)
    return with_ctes(*BASE_SPLIT, series_sql()) + f"\nSELECT Store, Product, Date, {sel} FROM series"


def _series_spark(spark, sf, cols):
    s = fe.add_series_features(base.demand(spark, sf), ["Store", "Product"])
    return round_doubles(s.select(*KEYS, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols]), 6)


@query("lag_features", _series_query(LAG_COLS), ids="W1 W2")
def q_lags(spark, sf):
    return _series_spark(spark, sf, LAG_COLS)


@query("rolling_features", _series_query(ROLL_COLS), ids="W3 P9")
def q_rolling(spark, sf):
    return _series_spark(spark, sf, ROLL_COLS)


@query("momentum_volatility", _series_query(MOM_COLS), ids="W4")
def q_momentum(spark, sf):
    return _series_spark(spark, sf, MOM_COLS)


# ── group statistics ───────────────────────────────────────────────────────
def _stats_sql(key):
    return with_ctes(*BASE_SPLIT) + f"""
SELECT {key}, {R('avg(Demand)', 6)} AS {key}_Mean, {R('coalesce(stddev_samp(Demand), 0.0)', 6)} AS {key}_Std
FROM train GROUP BY {key}"""


@query("store_stats_fit", _stats_sql("Store"), ids="A4 E3")
def q_store_stats(spark, sf):
    train, _, _, _ = split.year_split(base.demand(spark, sf))
    return round_doubles(fe.fit_group_stats(train, "Store"), 6)


@query("product_stats_fit", _stats_sql("Product"), ids="A5 E3")
def q_product_stats(spark, sf):
    train, _, _, _ = split.year_split(base.demand(spark, sf))
    return round_doubles(fe.fit_group_stats(train, "Product"), 6)


_GROUP_COLS = ["Store_Mean", "Store_Std", "Demand_vs_Store_Mean", "Store_CV",
               "Product_Mean", "Product_Std", "Demand_vs_Product_Mean", "Product_CV"]
_STATS_CTES = """
sstats AS (SELECT Store, avg(Demand) AS Store_Mean, coalesce(stddev_samp(Demand), 0.0) AS Store_Std
           FROM train GROUP BY Store),
pstats AS (SELECT Product, avg(Demand) AS Product_Mean, coalesce(stddev_samp(Demand), 0.0) AS Product_Std
           FROM train GROUP BY Product)"""
_GROUP_EXPR = {
    "Store_Mean": "ss.Store_Mean", "Store_Std": "ss.Store_Std",
    "Demand_vs_Store_Mean": "d.Demand / (ss.Store_Mean + 1)", "Store_CV": "ss.Store_Std / (ss.Store_Mean + 1)",
    "Product_Mean": "ps.Product_Mean", "Product_Std": "ps.Product_Std",
    "Demand_vs_Product_Mean": "d.Demand / (ps.Product_Mean + 1)",
    "Product_CV": "ps.Product_Std / (ps.Product_Mean + 1)",
}


@query("group_ratio_features", with_ctes(*BASE_SPLIT, _STATS_CTES) + f"""
SELECT d.Store, d.Product, d.Date,
       {', '.join(f"{R(f'coalesce({e}, 0.0)', 6)} AS {c}" for c, e in _GROUP_EXPR.items())}
FROM demand d LEFT JOIN sstats ss ON d.Store = ss.Store LEFT JOIN pstats ps ON d.Product = ps.Product""",
       ids="J1 J2 F10 E3")
def q_group_ratio(spark, sf):
    d = base.demand(spark, sf)
    train, _, _, _ = split.year_split(d)
    out = fe.attach_group_stats(d, fe.fit_group_stats(train, "Store"), "Store")
    out = fe.attach_group_stats(out, fe.fit_group_stats(train, "Product"), "Product")
    return round_doubles(out.select(*KEYS, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in _GROUP_COLS]), 6)


# ── interactions ───────────────────────────────────────────────────────────
_INTER = fe.interaction_columns(["Price", "Promo"])


@query("interaction_features", with_ctes(*BASE_SPLIT, series_sql()) + f"""
SELECT Store, Product, Date,
       {', '.join(f"{R(f'coalesce({a} * {b}, 0.0)', 6)} AS {n}" for n, a, b in _INTER)}
FROM series""", ids="F11 F12")
def q_interactions(spark, sf):
    s = fe.add_series_features(base.demand(spark, sf), ["Store", "Product"])
    s = fe.add_interactions(s, ["Price", "Promo"])
    return round_doubles(s.select(*KEYS, *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n)
                                           for n, _, _ in _INTER]), 6)


# ── full feature table (E4) ────────────────────────────────────────────────
def _feature_table_sql():
    inter = {n: f"s.{a} * s.{b}" for n, a, b in _INTER}
    cols = []
    for c in ["Price", "Promo"]:
        cols.append(f"s.{c}")
    cols.append(_CAL_INT_SQL.replace("(Date)", "(s.Date)"))
    for c in LAG_COLS + ROLL_COLS + MOM_COLS:
        cols.append(f"{R(f'coalesce(s.{c}, 0.0)', 6)} AS {c}")
    for c, e in _GROUP_EXPR.items():
        cols.append(f"{R(f'coalesce({e}, 0.0)', 6)} AS {c}".replace("d.Demand", "s.Demand"))
    for n, e in inter.items():
        cols.append(f"{R(f'coalesce({e}, 0.0)', 6)} AS {n}")
    body = ",\n       ".join(cols)
    trig = ", ".join(f"{R(c, 6)} AS {c}" for c in CAL_TRIG)
    return with_ctes(*BASE_SPLIT, series_sql(), _STATS_CTES) + f""",
ft AS (
SELECT s.Store, s.Product, s.Date, s.Demand,
       {body}
FROM series s LEFT JOIN sstats ss ON s.Store = ss.Store LEFT JOIN pstats ps ON s.Product = ps.Product
WHERE s.Demand IS NOT NULL)
SELECT * EXCLUDE ({', '.join(CAL_TRIG)}), {trig} FROM ft"""


@query("feature_table", _feature_table_sql(), ids="E4 P9 F1-F12 W1-W4 J1 J2")
def q_feature_table(spark, sf):
    out, names = _features(spark, sf)
    out = out.select(*KEYS, "Demand", *names)
    out = round_doubles(out, 6)
    return out.withColumns({c: F.round(c, 6) for c in CAL_TRIG})


# ── encodings (E1, E2) on a categorical column of the daily sales rows ─────
def _flag_rows(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"),
                     F.to_date("l_shipdate").alias("Date"), F.col("l_returnflag").alias("Flag"))


_FLAG_SQL = """
flags AS (SELECT l_orderkey AS order_key, l_linenumber AS line, CAST(l_shipdate AS DATE) AS Date,
                 l_returnflag AS Flag FROM lineitem),
fyears AS (SELECT y, row_number() OVER (ORDER BY y) AS yr
           FROM (SELECT DISTINCT year(Date) AS y FROM flags) t),
dict AS (SELECT Flag AS value, CAST(dense_rank() OVER (ORDER BY Flag) - 1 AS INTEGER) AS code
         FROM (SELECT DISTINCT Flag FROM flags f JOIN fyears ON year(f.Date) = fyears.y
               WHERE fyears.yr <= 3 AND Flag IS NOT NULL) t)"""


@query("label_encode", with_ctes(_FLAG_SQL) + """
SELECT f.order_key, f.line, f.Flag, coalesce(d.code, -1) AS Flag_Encoded
FROM flags f LEFT JOIN dict d ON coalesce(f.Flag, 'Unknown') = d.value""", ids="E1 E3")
def q_label_encode(spark, sf):
    rows = _flag_rows(spark, sf)
    train_years, _ = split.split_years(rows)
    dictionary = fe.fit_label_dictionary(rows.where(F.year("Date").isin(train_years)), "Flag")
    return fe.label_encode(rows, "Flag", dictionary).select("order_key", "line", "Flag", "Flag_Encoded")


@query("freq_encode", with_ctes(_FLAG_SQL) + """,
cnt AS (SELECT Flag, CAST(count(*) AS DOUBLE) AS n FROM flags WHERE Flag IS NOT NULL GROUP BY Flag)
SELECT f.order_key, f.line, f.Flag, coalesce(c.n, 0.0) AS Flag_Freq
FROM flags f LEFT JOIN cnt c ON f.Flag = c.Flag""", ids="E2 J9")
def q_freq_encode(spark, sf):
    return fe.frequency_encode(_flag_rows(spark, sf), "Flag").select("order_key", "line", "Flag", "Flag_Freq")

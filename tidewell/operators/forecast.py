"""Forecast tables: naive forecast (M10), prediction rows (K1, F13, M4b), scaffold.

M10 is this library's own deterministic forecast (the rolling mean of the
previous four weeks); it gives every report and drift operator a prediction
column that the SQL oracle can recompute exactly.  ``month_ahead_model`` (M8) scores
the next month with a fitted MLlib model; it produces the same table shape.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.calendar import month_fridays, year_month
from tidewell.functions.keys import series_keys
from tidewell.functions.scalars import zero_for_null
from tidewell.operators.features import LAGS, ROLL_WINDOWS, add_series_features, align_to, transform
from tidewell.operators.models import ForecastModel, predict, predict_with_interval
from tidewell.operators.reconcile import months_without_rows
from tidewell.session import cut_lineage

TAIL = max(LAGS + ROLL_WINDOWS)

PREDICTION_COLUMNS = ["Store", "Product", "Date", "Demand", "Predicted", "CI_Lower", "CI_Upper",
                      "Abs_Error", "Error_Pct", "month"]


def prediction_rows(df: DataFrame, pred_col: str, lower: F.Column | None = None,
                    upper: F.Column | None = None) -> DataFrame:
    """The per-month prediction table (K1): interval, absolute and percentage error.

    Without an interval the reference's fallback of +-15 % applies (M4b). ``Store`` is
    carried where the data has it.
    """
    p = F.col(pred_col)
    lower = lower if lower is not None else p * 0.85
    upper = upper if upper is not None else p * 1.15
    err = F.abs(F.col("Demand") - p)
    return df.select(
        *series_keys(df), "Date", "Demand",
        F.round(p, 2).alias("Predicted"),
        F.round(lower, 2).alias("CI_Lower"),
        F.round(upper, 2).alias("CI_Upper"),
        F.round(err, 2).alias("Abs_Error"),
        F.round(err / (F.abs(F.col("Demand")) + 1e-9) * 100, 2).alias("Error_Pct"),
        year_month("Date").alias("month"),
    )


def naive_forecast(demand: DataFrame, window: int = 4) -> DataFrame:
    """Rolling mean of the previous ``window`` rows of each series, 0 when none."""
    feats = add_series_features(demand, series_keys(demand))
    return feats.withColumn("_naive", F.coalesce(F.col(f"Rolling_Mean_{window}"), F.lit(0.0)))


def naive_predictions(demand: DataFrame, test_year: int) -> DataFrame:
    """Prediction table of the test year, with features from the whole history."""
    scored = naive_forecast(demand).where(F.year("Date") == test_year)
    return prediction_rows(scored, "_naive")


def future_scaffold(history: DataFrame, target_month: str | F.Column) -> DataFrame:
    """Rows to forecast for a month: every series seen in ``history`` x Fridays of the month.

    Generated per series with ``explode`` (no join): the output is
    (#series x <= 5) rows.  Other columns carry the value of the row with the
    latest date (J8), a one-row aggregate attached as literals; missing values -> 0.
    Series are the (Store, Product) pairs, or products, present in the history.
    """
    tm = F.lit(target_month) if isinstance(target_month, str) else target_month
    keys = series_keys(history)
    series = history.select(*keys).distinct()
    rows = series.select(*keys, F.explode(month_fridays(tm)).alias("Date"),
                         F.lit(None).cast("double").alias("Demand"))
    extra = [c for c in history.columns if c not in ("Date", "Demand", *keys)]
    if extra:
        from tidewell.functions.scalars import row_literals
        rows = rows.withColumns(row_literals(history.agg(
            F.max_by(F.struct(*extra), F.struct("Date", *keys, "Demand")).alias("_row")).select("_row.*")))
        rows = zero_for_null(rows, extra)
    return rows


def series_tail(history: DataFrame, rows: int = TAIL) -> DataFrame:
    """The last ``rows`` rows of each series: all that the features of later weeks read."""
    newest = Window.partitionBy(*series_keys(history)).orderBy(F.desc("Date"))
    return history.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= rows).drop("_n")


def _score(rows: DataFrame, model: ForecastModel) -> DataFrame:
    """Rows with ``Predicted`` and interval: aligned to the model's feature list (P10), trees'
    deviation where the model has a forest (M4), else +-15 % (M4b)."""
    ready = align_to(rows, model.features)
    if model.forest is not None:
        return predict_with_interval(model.pipeline, model.forest, ready)
    return predict(model.pipeline, ready).withColumns({"CI_Lower": F.col("Predicted") * 0.85,
                                                       "CI_Upper": F.col("Predicted") * 1.15})


def month_ahead_model(history: DataFrame, model: ForecastModel, target_month: str,
                      recursive: bool = True) -> DataFrame:
    """Forecast of ``target_month`` by a fitted model (M8).

    Where the history has no row of that month (J12), its weeks come from the scaffold. They
    are scored in date order: week k's lags and rolling statistics read the forecasts of the
    weeks before it (at most five passes over the last twelve rows of each series, the same
    feature code as in training). ``recursive=False`` scores all weeks at once with unknown
    demand read as 0. A month the history already has rows for is scored on those rows.

    Returns series keys, Date, month, ``Predicted_Demand``, ``CI_Lower``, ``CI_Upper``."""
    spark = history.sparkSession
    keys = series_keys(history)
    history = history.select(*[c for c in history.columns if c.lower() != "month"])
    asked = spark.createDataFrame([(target_month,)], "month string")
    of_month = year_month("Date") == target_month

    def features_of(rows):
        return transform(rows, model.state, keep_unknown=True)[0]

    if not months_without_rows(asked, history).count():
        scored = _score(features_of(history.fillna(0, subset=["Demand"])).where(of_month), model)
    else:
        known = cut_lineage(series_tail(history))
        scaffold = cut_lineage(future_scaffold(history, target_month))
        if not recursive:
            both = known.unionByName(scaffold.withColumn("Demand", F.lit(0.0)))
            scored = _score(features_of(both).where(of_month), model)
        else:
            weeks = sorted(r["Date"] for r in scaffold.select("Date").distinct().collect())   # at most five
            done = []
            for week in weeks:
                feats = features_of(known.unionByName(scaffold.where(F.col("Date") == week)))
                feats = _score(feats.where(F.col("Date") == week), model)
                done.append(cut_lineage(feats.select(*history.columns, "Predicted", "CI_Lower", "CI_Upper")))
                known = known.unionByName(done[-1].withColumn("Demand", F.col("Predicted")).select(*history.columns))
            scored = reduce(DataFrame.unionByName, done) if done else scaffold.withColumns(
                {c: F.lit(None).cast("double") for c in ("Predicted", "CI_Lower", "CI_Upper")})
    return scored.select(*keys, "Date", year_month("Date").alias("month"),
                         F.round("Predicted", 2).alias("Predicted_Demand"),
                         F.round("CI_Lower", 2).alias("CI_Lower"), F.round("CI_Upper", 2).alias("CI_Upper"))


def month_ahead_naive(weekly: DataFrame, target_months_from: str) -> DataFrame:
    """Naive forecasts for every month from ``target_months_from`` on, each made
    from the history strictly before that month (the reconcile cycle, M8 with M10).

    For a target month m and its k-th Friday, the forecast is the mean of the
    series' last four rows, of which the scaffold weeks 1..k-1 of m are empty:
    the mean of the last (5-k) rows before m (0 when none).  Computed in one pass:
    the last four values before each month come from ``lag`` over the series,
    read at the month's first row.
    """
    m = year_month("Date")
    keys = series_keys(weekly)
    w = Window.partitionBy(*keys).orderBy("Date")
    lags = weekly.select(*keys, "Date", m.alias("month"),
                         *[F.lag("Demand", j).over(w).alias(f"_l{j}") for j in range(1, 5)],
                         F.row_number().over(w).alias("_rn"))
    # first row of every (series, month) from the cut-off on: its lags are the pre-month history
    firsts = (lags.where(F.col("month") >= target_months_from)
              .withColumn("_first", F.min("_rn").over(Window.partitionBy(*keys, "month")))
              .where(F.col("_rn") == F.col("_first"))
              .select(*keys, "month", *[f"_l{j}" for j in range(1, 5)]))
    fridays = firsts.select("*", F.posexplode(month_fridays(F.col("month"))).alias("_k0", "Date"))
    vals = [F.col(f"_l{j}") for j in range(1, 5)]

    def mean_from(k0):
        # Friday k (= k0 + 1) sees lags 1 .. 4 - k0 of the pre-month history
        usable = [F.when(F.lit(j) <= 4 - k0, v) for j, v in zip(range(1, 5), vals)]
        total = F.aggregate(F.array(*usable), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
        cnt = F.aggregate(F.array(*usable), F.lit(0), lambda acc, x: acc + F.when(x.isNotNull(), 1).otherwise(0))
        return F.when(cnt > 0, total / cnt).otherwise(F.lit(0.0))

    pred = F.coalesce(*[F.when(F.col("_k0") == k0, mean_from(k0)) for k0 in range(4)], F.lit(0.0))
    return fridays.select(*keys, "Date", "month", pred.alias("Predicted_Demand"))

"""Reports over the prediction table.

Every report is a ``groupBy`` with partial aggregation, so the shuffle carries
one row per group and input partition.  Global orderings and ``over ()``
windows are applied only to the already aggregated, group-level tables (one row
per store, product or month), never to prediction rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scalars import row_literals
from tidewell.operators.analysis import display_label

EPS = 1e-9


def complete_pairs(pred: DataFrame) -> DataFrame:
    """Rows with both an actual and a prediction."""
    return pred.where(F.col("Demand").isNotNull() & F.col("Predicted").isNotNull())


def slice_rows(pred: DataFrame, months=None, stores=None, products=None) -> DataFrame:
    """Optional month / store / product slicers (P13). ``months`` is a list, whose filter
    prunes the partitions of a month-partitioned table when it is planned, or a DataFrame with
    a ``month`` column (the months of a severity, say), by which Spark prunes them at run time."""
    if isinstance(months, DataFrame):
        pred = pred.join(months.select("month").distinct(), "month", "left_semi")
    elif months:
        pred = pred.where(F.col("month").isin(list(months)))
    if stores:
        pred = pred.where(F.col("Store").isin(list(stores)))
    if products:
        pred = pred.where(F.col("Product").isin(list(products)))
    return pred


def _abs_err():
    return F.abs(F.col("Demand") - F.col("Predicted"))


def _err_pct():
    return _abs_err() / (F.abs(F.col("Demand")) + EPS) * 100


def with_error_columns(pred: DataFrame) -> DataFrame:
    """Abs_Error / Error_Pct when a prediction table lacks them."""
    cols = {}
    if "Abs_Error" not in pred.columns:
        cols["Abs_Error"] = F.round(_abs_err(), 2)
    if "Error_Pct" not in pred.columns:
        cols["Error_Pct"] = F.round(F.coalesce(F.col("Abs_Error"), _abs_err()) / (F.abs(F.col("Demand")) + EPS) * 100, 2) \
            if "Abs_Error" in pred.columns else F.round(_err_pct(), 2)
    return pred.withColumns(cols) if cols else pred


def _r2(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 2) for c, t in df.dtypes if t == "double"})


def store_error_stats(pred: DataFrame) -> DataFrame:
    """MAE, mean actual and count per store (A10)."""
    return _r2(complete_pairs(pred).groupBy("Store").agg(
        F.avg(_abs_err()).alias("mae"), F.avg("Demand").alias("avg_sales"),
        F.count("Demand").alias("count")))


def product_forecast(pred: DataFrame) -> DataFrame:
    """Per-product accuracy (A11): accuracy = clip(100 - MAPE, 0, 100)."""
    agg = complete_pairs(pred).groupBy("Product").agg(
        F.avg("Demand").alias("avg_demand"), F.avg("Predicted").alias("avg_predicted"),
        F.avg(_abs_err()).alias("mae"), F.avg(_err_pct()).alias("mape"),
        F.sum("Demand").alias("total_demand"), F.count("Demand").alias("count"))
    agg = agg.withColumns({
        "name": display_label("Product", "Product"),
        "accuracy": F.least(F.greatest(100 - F.col("mape"), F.lit(0.0)), F.lit(100.0)),
    })
    return _r2(agg)


def product_monthly(pred: DataFrame) -> DataFrame:
    """Mean demand and prediction per (month, product)."""
    return _r2(complete_pairs(pred).groupBy("month", "Product").agg(
        F.avg("Demand").alias("demand"), F.avg("Predicted").alias("predicted"))
        .withColumn("name", display_label("Product", "Product")))


def store_product_forecast(pred: DataFrame) -> DataFrame:
    """Per (store, product) accuracy."""
    agg = complete_pairs(pred).groupBy("Store", "Product").agg(
        F.avg("Demand").alias("avg_demand"), F.avg("Predicted").alias("avg_predicted"),
        F.avg(_abs_err()).alias("mae"), F.avg(_err_pct()).alias("mape"),
        F.count("Demand").alias("count"))
    return _r2(agg.withColumns({
        "name": display_label("Product", "Product"),
        "accuracy": F.least(F.greatest(100 - F.col("mape"), F.lit(0.0)), F.lit(100.0))}))


def store_monthly(pred: DataFrame) -> DataFrame:
    """Mean demand and prediction per (month, store)."""
    return _r2(complete_pairs(pred).groupBy("month", "Store").agg(
        F.avg("Demand").alias("demand"), F.avg("Predicted").alias("predicted")))


def store_drift(pred: DataFrame) -> DataFrame:
    """Per (store, month) MAE, means, count and error %."""
    agg = complete_pairs(pred).groupBy("Store", "month").agg(
        F.avg(_abs_err()).alias("mae"), F.avg("Demand").alias("avg_demand"),
        F.avg("Predicted").alias("avg_predicted"), F.count("Demand").alias("count"))
    return _r2(agg.withColumn("error_pct", F.col("mae") / (F.abs(F.col("avg_demand")) + EPS) * 100))


# Levels of ``grouped_reports``: the keys each report groups by.
REPORT_LEVELS = {"product_forecast": ("Product",), "product_monthly": ("month", "Product"),
                 "store_product_forecast": ("Store", "Product"), "store_monthly": ("month", "Store"),
                 "store_drift": ("Store", "month")}
_KEYS = ("Store", "Product", "month")


def grouped_reports(pred: DataFrame) -> DataFrame:
    """The aggregates of A11-A15 in one pass: grouping sets of (Store, Product, month) with
    partial aggregation and one exchange. ``level`` names the grouping's keys, joined by "+";
    ``report_of`` reads one report off the result."""
    sets = sorted({tuple(k for k in _KEYS if k in keys) for keys in REPORT_LEVELS.values()})
    out = complete_pairs(pred).groupingSets([[F.col(k) for k in s] for s in sets], *_KEYS).agg(
        F.grouping_id(*_KEYS).alias("gid"),
        F.avg("Demand").alias("avg_demand"), F.avg("Predicted").alias("avg_predicted"),
        F.avg(_abs_err()).alias("mae"), F.avg(_err_pct()).alias("mape"),
        F.sum("Demand").alias("total_demand"), F.count("Demand").alias("count"))
    name = F.coalesce(*[F.when(F.col("gid") == _grouping_id(s), "+".join(s)) for s in sets])
    return out.withColumn("level", name).drop("gid")


def _grouping_id(kept: tuple[str, ...]) -> int:
    return sum(1 << i for i, k in enumerate(reversed(_KEYS)) if k not in kept)


def report_of(grouped: DataFrame, report: str) -> DataFrame:
    """One of the reports of ``REPORT_LEVELS`` from the result of ``grouped_reports``."""
    keys = REPORT_LEVELS[report]
    rows = grouped.where(F.col("level") == "+".join(k for k in _KEYS if k in keys))
    accuracy = F.least(F.greatest(100 - F.col("mape"), F.lit(0.0)), F.lit(100.0)).alias("accuracy")
    label = display_label("Product", "Product").alias("name") if "Product" in keys else None
    if report in ("product_forecast", "store_product_forecast"):
        totals = ["total_demand"] if report == "product_forecast" else []
        rows = rows.select(*keys, "avg_demand", "avg_predicted", "mae", "mape", *totals, "count", label, accuracy)
    elif report == "store_drift":
        rows = rows.select(*keys, "mae", "avg_demand", "avg_predicted", "count",
                           (F.col("mae") / (F.abs(F.col("avg_demand")) + EPS) * 100).alias("error_pct"))
    else:
        rows = rows.select(*keys, F.col("avg_demand").alias("demand"), F.col("avg_predicted").alias("predicted"),
                           *([label] if label is not None else []))
    return _r2(rows)


def test_metrics(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """MAE, RMSE, MAPE, WMAPE, R² (100 without variance), accuracy, n.

    One aggregate; R² uses n·var_pop(y) for the total sum of squares.
    """
    e = F.col("Demand") - F.col("Predicted")
    df = complete_pairs(pred)
    aggs = [
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e) / (F.abs(F.col("Demand")) + EPS) * 100).alias("mape"),
        (F.sum(F.abs(e)) / (F.sum(F.abs(F.col("Demand"))) + EPS) * 100).alias("wmape"),
        F.sum(e * e).alias("_ss_res"),
        (F.var_pop("Demand") * F.count("Demand")).alias("_ss_tot"),
        F.count(F.lit(1)).alias("n_rows"),
    ]
    out = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    out = out.withColumns({
        "r2": F.when(F.col("_ss_tot") > 0, (1 - F.col("_ss_res") / F.col("_ss_tot")) * 100).otherwise(F.lit(100.0)),
        "accuracy": F.round(F.greatest(F.lit(0.0), 100 - F.col("mape")), 1),
    }).drop("_ss_res", "_ss_tot")
    return out.withColumns({c: F.round(c, 4) for c in ("mae", "rmse", "mape", "wmape", "r2")})


def trainer_metrics(pred: DataFrame) -> DataFrame:
    """Trainer's integer-rounded metrics (A17): MAPE over non-zero actuals, R² in %.

    Python's ``round`` is half-to-even, hence ``bround``.
    """
    y, p = F.col("Demand"), F.col("Predicted")
    e = y - p
    agg = pred.agg(
        F.sqrt(F.avg(e * e)).alias("_rmse"), F.avg(F.abs(e)).alias("_mae"),
        F.sum(e * e).alias("_ss_res"), (F.var_pop(y) * F.count(y)).alias("_ss_tot"),
        F.avg(F.when(y != 0, F.abs(e / y))).alias("_mape"),
        (F.sum(F.abs(e)) / (F.sum(F.abs(y)) + EPS) * 100).alias("_wmape"))
    r2 = F.when(F.col("_ss_tot") > 0, 1 - F.col("_ss_res") / F.col("_ss_tot")).otherwise(F.lit(0.0))
    mape = F.coalesce(F.bround(F.col("_mape") * 100, 0), F.lit(0.0)).cast("int")
    return agg.select(
        F.bround("_rmse", 0).cast("int").alias("RMSE"),
        F.bround("_mae", 0).cast("int").alias("MAE"),
        F.bround(r2 * 100, 0).cast("int").alias("R2"),
        mape.alias("MAPE"),
        F.bround("_wmape", 0).cast("int").alias("WMAPE"),
        (F.lit(100) - mape).alias("Accuracy"))


def interval_coverage(pred: DataFrame) -> DataFrame:
    """Share of actuals inside [CI_Lower, CI_Upper] and mean width."""
    inside = F.col("Demand").between(F.col("CI_Lower"), F.col("CI_Upper")).cast("double")
    return pred.agg(F.round(F.avg(inside), 6).alias("coverage"),
                    F.round(F.avg(F.col("CI_Upper") - F.col("CI_Lower")), 4).alias("avg_interval_width"))


def batch_summary(pred: DataFrame) -> DataFrame:
    """Per-month count, mean prediction, mean actual."""
    return pred.groupBy("month").agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.avg("Predicted"), 2).alias("mean_pred"),
        F.round(F.avg("Demand"), 2).alias("mean_actual"))


def monthly_sales(batches: DataFrame) -> DataFrame:
    """Actual, predicted and their absolute difference per month."""
    return batches.select(
        "month", F.col("mean_actual").alias("actual"), F.col("mean_pred").alias("predicted"),
        F.round(F.abs(F.coalesce("mean_actual", F.lit(0.0)) - F.coalesce("mean_pred", F.lit(0.0))), 2).alias("mae"))


def quality_band(err_pct) -> F.Column:
    """Excellent < 3 %, Good < 8 %, Fair < 15 %, else Poor."""
    c = F.col(err_pct) if isinstance(err_pct, str) else err_pct
    return (F.when(c < 3, "Excellent").when(c < 8, "Good").when(c < 15, "Fair").otherwise("Poor"))


def product_month_summary(pred: DataFrame) -> DataFrame:
    """Per (month, product): rounded means and a ratio-of-sums error %."""
    err = F.coalesce(F.col("Abs_Error"), _abs_err())
    agg = complete_pairs(pred).groupBy("month", "Product").agg(
        F.sum(F.coalesce("Demand", F.lit(0.0))).alias("_act"), F.sum("Predicted").alias("_pred"),
        F.sum(err).alias("_err"), F.count(F.lit(1)).alias("n"))
    return agg.select(
        "month", "Product", "n",
        F.round(F.col("_act") / F.col("n"), 0).alias("avgActual"),
        F.round(F.col("_pred") / F.col("n"), 0).alias("avgPred"),
        F.round(F.col("_err") / F.col("n"), 0).alias("mae"),
        F.when(F.col("_act") != 0, F.round(F.col("_err") / F.col("_act") * 100, 1)).otherwise(F.lit(0.0)).alias("mape"))


def product_mean_of_stores(store_product: DataFrame) -> DataFrame:
    """Product roll-up as the mean of per-store values."""
    agg = store_product.groupBy("Product").agg(
        F.first("name").alias("name"),
        F.avg("mae").alias("mae"), F.avg("mape").alias("mape"),
        F.avg("avg_demand").alias("avg_demand"), F.avg("avg_predicted").alias("avg_predicted"),
        F.sum("count").alias("count"))
    return agg.select("Product", "name", F.round("mae", 2).alias("mae"), F.round("mape", 2).alias("mape"),
                      F.round("avg_demand", 2).alias("avg_demand"),
                      F.round("avg_predicted", 2).alias("avg_predicted"),
                      F.round(100 - F.col("mape"), 2).alias("accuracy"), "count")


def macro_kpis(groups: DataFrame) -> DataFrame:
    """Mean of group MAE / MAPE."""
    return groups.agg(F.round(F.avg("mae"), 0).alias("mae"), F.round(F.avg("mape"), 0).alias("mape"),
                      F.round(100 - F.avg("mape"), 0).alias("accuracy"))


def store_mae_by_month(store_drift_rows: DataFrame, store: str | None = None) -> DataFrame:
    """Mean over stores (or one store) of the per-store monthly MAE."""
    rows = store_drift_rows if store is None else store_drift_rows.where(F.col("Store") == store)
    return rows.groupBy("month").agg(F.round(F.avg("mae"), 2).alias("MAE"))


def demand_share(totals: DataFrame, key: str = "Product") -> DataFrame:
    """Share of total demand in %, 1 decimal (A39); the total is one row, attached as a literal."""
    total = row_literals(totals.agg(F.sum("demand").alias("total")))["total"]
    return totals.select(key, "demand", F.round(F.col("demand") / total * 100, 1).alias("pct"))


def heatmap(product_month: DataFrame) -> DataFrame:
    """Long-form product x month heatmap: rounded mean demand and intensity v / row max."""
    v = F.round(F.col("demand"), 0)
    return product_month.select(
        "Product", "month", v.alias("value"),
        F.round(v / F.max(v).over(Window.partitionBy("Product")), 4).alias("intensity"))


def heatmap_wide(product_month: DataFrame, months: list[str]) -> DataFrame:
    """Wide form: one column per month, explicit month list avoids a discovery pass."""
    return (product_month.groupBy("Product").pivot("month", months)
            .agg(F.first(F.round(F.col("demand"), 0))))


def normalised_scores(product_fc: DataFrame, k: int = 10) -> DataFrame:
    """First k products (by id), demand score 100·avg/max(avg), rounded accuracy."""
    first_k = product_fc.orderBy("Product").limit(k)       # top-k per partition, then merged
    mx = F.greatest(F.max("avg_demand").over(Window.partitionBy()), F.lit(1.0))
    return first_k.select("Product", "name",
                          F.round(F.col("avg_demand") / mx * 100, 1).alias("Demand"),
                          F.round("accuracy", 0).alias("Accuracy"))


def demand_vs_forecast(product_fc: DataFrame) -> DataFrame:
    """Products ordered by average demand, rounded for the report."""
    return product_fc.select("Product", "name",
                             F.round("avg_demand", 0).alias("avg_demand"),
                             F.round("avg_predicted", 0).alias("avg_forecast"),
                             F.round("accuracy", 0).alias("accuracy")).orderBy(F.desc("avg_demand"), "Product")


def top_products(product_roll: DataFrame, k: int = 8) -> DataFrame:
    """Top-k products by average demand."""
    return product_roll.orderBy(F.desc("avg_demand"), "Product").limit(k)


def first_rows(pred: DataFrame, n: int = 150) -> DataFrame:
    """First n rows of a selection in key order."""
    return pred.orderBy("Store", "Product", "Date").limit(n)


def store_stats_fallback(history: DataFrame, batches: DataFrame) -> DataFrame:
    """Store averages and counts from the history with one global MAE: the mean over
    months of |mean actual - mean prediction| (A10b). The global MAE is a one-row
    aggregate attached as a literal."""
    g = batches.agg(F.coalesce(F.avg(F.abs(F.coalesce("mean_actual", F.lit(0.0)) -
                                           F.coalesce("mean_pred", F.lit(0.0)))), F.lit(0.0)).alias("mae"))
    s = history.groupBy("Store").agg(F.avg("Demand").alias("avg_sales"), F.count("Demand").alias("count"))
    return _r2(s.withColumns(row_literals(g)))


def dataset_summary(demand: DataFrame, train_years: list[int], test_year: int, batches: DataFrame) -> DataFrame:
    """One row (A27): size, stores and range of the data, split sizes, and ``monthly_avg``, the
    months' mean actual and prediction (``batch_summary``, a row per month) in order."""
    y = F.year("Date")
    months = row_literals(batches.agg(F.array_sort(F.collect_list(F.struct("month", "mean_actual", "mean_pred")))
                                      .alias("monthly_avg")).select(F.to_json("monthly_avg").alias("j")))["j"]
    out = demand.agg(F.count(F.lit(1)).alias("rows"),
                     (F.count_distinct("Store") if "Store" in demand.columns else F.lit(0).cast("long")).alias("stores"),
                     F.min("Date").alias("date_min"), F.max("Date").alias("date_max"),
                     F.round(F.avg("Demand"), 4).alias("demand_mean"), F.min("Demand").alias("demand_min"),
                     F.max("Demand").alias("demand_max"),
                     F.count_if(y.isin(train_years)).alias("train_rows"), F.count_if(y == test_year).alias("test_rows"))
    return out.withColumn("monthly_avg", F.from_json(
        months, "array<struct<month:string,mean_actual:double,mean_pred:double>>"))


def sanitize(df: DataFrame) -> DataFrame:
    """NaN and +-Infinity in double columns become null."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.withColumns({c: F.when(bad(c), F.lit(None).cast("double")).otherwise(F.col(c))
                           for c, t in df.dtypes if t == "double"})

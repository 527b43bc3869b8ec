"""Registered queries: drift of the test months against the training baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.calendar import year_month
from tidewell.operators import drift, features as fe, reports, split
from tidewell.operators.families import feature_families, feature_family_sql
from tidewell.plans import base
from tidewell.plans.q_features import CAL_TRIG, LAG_COLS, MOM_COLS, ROLL_COLS, _GROUP_EXPR, _INTER, _STATS_CTES
from tidewell.plans.registry import query
from tidewell.session import cut_lineage, ensure_checkpoint_dir
from tidewell.sources import runs
from tidewell.plans.sqlbase import BASE_SPLIT, CAL_SQL, R, series_sql, with_ctes, ym

CAL_COLS = ["Month", "Quarter", "Year", "DayOfYear", "WeekOfYear", "Is_Q1", "Is_Q2", "Is_Q3", "Is_Q4",
            *CAL_TRIG, "Near_Holiday", "Is_Summer", "Is_Winter"]
M = "YearMonth"
FEATURES = (["Price", "Promo"] + CAL_COLS + LAG_COLS + ROLL_COLS + MOM_COLS + list(_GROUP_EXPR)
            + [n for n, _, _ in _INTER])


# ── Spark side ─────────────────────────────────────────────────────────────
def _inputs(spark, sf):
    """Feature table, baseline (train years) and current (test year, by month) frames."""
    d = base.demand_once(spark, sf)
    train_years, test_year = split.split_years(d)
    state = fe.fit(d.where(F.year("Date").isin(train_years)))
    feats, names = fe.transform(d, state)
    assert names == FEATURES, names
    # the month key is YearMonth: Spark resolves names case-insensitively and Month is a feature
    feats = feats.withColumns({M: year_month("Date"),
                               "error": F.col("Demand") - F.col("Rolling_Mean_4")})
    # baseline and current both read the feature table: computed once
    feats = cut_lineage(feats)
    baseline = feats.where(F.year("Date").isin(train_years))
    # Months with fewer than two rows are not monitored
    current = split.month_rows_at_least(feats.where(F.year("Date") == test_year), 2)
    return baseline, current


def per_feature(spark, sf) -> DataFrame:
    baseline, current = _inputs(spark, sf)
    return drift.feature_drift(baseline, current, FEATURES, month_col=M).withColumnRenamed(M, "month")


def month_reports(spark, sf, inputs=None) -> DataFrame:
    baseline, current = inputs or _inputs(spark, sf)
    pf = drift.feature_drift(baseline, current, FEATURES, month_col=M)
    trend = drift.error_trend(baseline, current, month_col=M)
    return drift.month_severity(pf, trend, month_col=M).withColumnRenamed(M, "month")


def monitor_decisions(spark, sf, inputs=None, months=None) -> DataFrame:
    """Per month, monitor when no drift, else fine_tune when the second half's MAE
    is at least 5 % worse than the first half's (positional halves, P21)."""
    inputs = inputs or _inputs(spark, sf)
    months = months if months is not None else month_reports(spark, sf, inputs)
    _, current = inputs
    return drift.decisions(months, current.select("Store", "Product", "Date", F.col(M).alias("month"), "error"))


# ── SQL side ───────────────────────────────────────────────────────────────
def _ft_cte() -> str:
    inter = {n: f"s.{a} * s.{b}" for n, a, b in _INTER}
    cols = ["CAST(s.Price AS DOUBLE) AS Price", "CAST(s.Promo AS DOUBLE) AS Promo"]
    cal = CAL_SQL.replace("(Date)", "(s.Date)")
    cols.append(cal)
    cols += [f"coalesce(s.{c}, 0.0) AS {c}" for c in LAG_COLS + ROLL_COLS + MOM_COLS]
    cols += [f"coalesce({e.replace('d.Demand', 's.Demand')}, 0.0) AS {c}" for c, e in _GROUP_EXPR.items()]
    cols += [f"coalesce({e}, 0.0) AS {n}" for n, e in inter.items()]
    body = ",\n       ".join(cols)
    return f"""
ft AS (
SELECT s.Store, s.Product, s.Date, s.Demand, {ym('s.Date')} AS YearMonth,
       s.Demand - coalesce(s.Rolling_Mean_4, 0.0) AS error, y.yr, y.ny,
       {body}
FROM series s LEFT JOIN sstats ss ON s.Store = ss.Store LEFT JOIN pstats ps ON s.Product = ps.Product
JOIN years y ON year(s.Date) = y.y
WHERE s.Demand IS NOT NULL),
base_rows AS (SELECT * FROM ft WHERE yr <= 3),
cur_rows AS (SELECT * FROM ft WHERE yr = CASE WHEN ny > 3 THEN 4 ELSE ny END
             AND YearMonth IN (SELECT YearMonth FROM ft WHERE yr = CASE WHEN ny > 3 THEN 4 ELSE ny END
                               GROUP BY 1 HAVING count(*) >= 2)),
long_b AS (UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FEATURES)} FROM base_rows)
           ON {', '.join(FEATURES)} INTO NAME feature VALUE raw),
long_c AS (UNPIVOT (SELECT YearMonth, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FEATURES)} FROM cur_rows)
           ON {', '.join(FEATURES)} INTO NAME feature VALUE raw),
bc AS (SELECT feature, {R('raw', 9)} AS value, count(*) AS cnt FROM long_b WHERE raw IS NOT NULL GROUP BY 1, 2),
cc0 AS (SELECT YearMonth AS month, feature, {R('raw', 9)} AS value, count(*) AS cnt FROM long_c WHERE raw IS NOT NULL
        GROUP BY 1, 2, 3),
nb AS (SELECT feature, CAST(sum(cnt) AS BIGINT) AS n_b, min(value) AS bmin, max(value) AS bmax FROM bc GROUP BY 1),
nc AS (SELECT month, feature, CAST(sum(cnt) AS BIGINT) AS n_c, min(value) AS cmin, max(value) AS cmax FROM cc0 GROUP BY 1, 2
       HAVING sum(cnt) >= 5),
parts AS (SELECT nc.month, nc.feature, nb.n_b, nc.n_c, least(bmin, cmin) AS lo, greatest(bmax, cmax) AS hi
          FROM nc JOIN nb ON nc.feature = nb.feature),
merged AS (
  SELECT month, feature, value, sum(cb) AS cb, sum(cc) AS cc FROM (
    SELECT p.month, b.feature, b.value, b.cnt AS cb, 0 AS cc FROM bc b JOIN parts p ON b.feature = p.feature
    UNION ALL
    SELECT c.month, c.feature, c.value, 0 AS cb, c.cnt AS cc FROM cc0 c
    JOIN parts p ON c.month = p.month AND c.feature = p.feature) u
  GROUP BY 1, 2, 3),
mp AS (SELECT m.*, p.n_b, p.n_c, p.lo, p.hi FROM merged m JOIN parts p ON m.month = p.month AND m.feature = p.feature),
cdf AS (SELECT *, sum(cb) OVER w AS cum_b, sum(cc) OVER w AS cum_c,
               lead(value) OVER (PARTITION BY month, feature ORDER BY value) AS next_value
        FROM mp WINDOW w AS (PARTITION BY month, feature ORDER BY value ROWS UNBOUNDED PRECEDING)),
kw AS (SELECT month, feature, max(n_b) AS n_b, max(n_c) AS n_c,
              max(abs(cum_b / n_b - cum_c / n_c)) AS ks,
              sum(abs(cum_b / n_b - cum_c / n_c) * coalesce(next_value - value, 0.0)) AS wasserstein
       FROM cdf GROUP BY 1, 2),
{_bins_cte('psib', 10)},
{_bins_cte('jsb', 20)},
psi AS (SELECT month, feature,
               CASE WHEN bool_and(lo = hi) THEN 0.0 ELSE abs(sum((cp - bp) * ln(cp / bp))) END AS psi
        FROM (SELECT *, CASE WHEN cb / n_b = 0 THEN 1e-6 ELSE cb / n_b END AS bp,
                        CASE WHEN cc / n_c = 0 THEN 1e-6 ELSE cc / n_c END AS cp FROM psib) t
        GROUP BY 1, 2),
js AS (SELECT month, feature, bool_and(lo = hi) AS constant,
              greatest((sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2, 0.0) AS div
       FROM (SELECT *, (cb + 1e-10) / (n_b + 20 * 1e-10) AS p, (cc + 1e-10) / (n_c + 20 * 1e-10) AS q FROM jsb) t
       GROUP BY 1, 2),
pf AS (SELECT kw.month, kw.feature, kw.n_b, kw.n_c, kw.ks, kw.wasserstein, psi.psi,
              CASE WHEN kw.ks < 0.05 THEN 'none' WHEN kw.ks < 0.15 THEN 'mild' ELSE 'severe' END AS ks_severity,
              CASE WHEN psi.psi < 0.1 THEN 'none' WHEN psi.psi < 0.25 THEN 'mild' ELSE 'severe' END AS psi_severity,
              CASE WHEN js.constant THEN 0.0 ELSE {R('sqrt(js.div)', 4)} END AS js_distance,
              CASE WHEN js.constant THEN 0.0 ELSE {R('js.div', 4)} END AS js_divergence
       FROM kw JOIN psi ON kw.month = psi.month AND kw.feature = psi.feature
       JOIN js ON kw.month = js.month AND kw.feature = js.feature),
trend AS (SELECT c.month, {R('b.e', 2)} AS baseline_error, {R('c.e', 2)} AS current_error,
                 {R('(c.e - b.e) / (b.e + 1e-9)', 4)} AS error_increase, (c.e - b.e) / (b.e + 1e-9) > 0.10 AS drift
          FROM (SELECT YearMonth AS month, avg(abs(error)) AS e FROM cur_rows GROUP BY 1) c,
               (SELECT avg(abs(error)) AS e FROM base_rows) b),
cnts AS (SELECT month,
                count(*) FILTER (WHERE ks_severity = 'severe') + count(*) FILTER (WHERE psi_severity = 'severe')
                    AS severe_features,
                count(*) FILTER (WHERE ks_severity = 'mild') AS mild_features, count(*) AS total_features
         FROM pf GROUP BY month),
months AS (SELECT t.*, coalesce(c.severe_features, 0) AS severe_features, coalesce(c.mild_features, 0) AS mild_features,
                  coalesce(c.total_features, 0) AS total_features
           FROM trend t LEFT JOIN cnts c ON t.month = c.month),
sev AS (SELECT *, CASE WHEN severe_features > 0 OR drift THEN 'severe'
                       WHEN total_features > 0 AND mild_features > total_features * 0.3 THEN 'mild'
                       ELSE 'none' END AS severity FROM months)"""


def _bins_cte(name: str, bins: int) -> str:
    step = "((hi - lo) / " + str(bins) + ")"
    edges = " + ".join(f"CAST(value >= lo + {i} * {step} AS INTEGER)" for i in range(1, bins))
    return f"""{name}_c AS (SELECT month, feature, {edges} AS bin, sum(cb) AS cb, sum(cc) AS cc
          FROM mp GROUP BY 1, 2, 3),
{name} AS (SELECT p.month, p.feature, p.n_b, p.n_c, p.lo, p.hi, g.bin,
                  coalesce(c.cb, 0) AS cb, coalesce(c.cc, 0) AS cc
           FROM parts p CROSS JOIN (SELECT range AS bin FROM range(0, {bins})) g
           LEFT JOIN {name}_c c ON p.month = c.month AND p.feature = c.feature AND g.bin = c.bin)"""


DRIFT = with_ctes(*BASE_SPLIT, series_sql(), _STATS_CTES, _ft_cte())


@query("baseline_counts", DRIFT + "\nSELECT feature, value, cnt FROM bc", ids="D0")
def q_baseline_counts(spark, sf):
    baseline, _ = _inputs(spark, sf)
    return drift.baseline_counts(baseline, FEATURES)


def _stored_baseline(spark, sf):
    """The baseline stored year by year, one year twice, and read back; with the inputs."""
    baseline, current = _inputs(spark, sf)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/baseline-{runs.new_run_id()}"
    years = sorted(r[0] for r in baseline.select(F.year("Date")).distinct().collect())
    for y in [*years, years[0]]:
        drift.store_baseline(spark, baseline.where(F.year("Date") == y), FEATURES, root, f"{root}/staging", M)
    return baseline, current, drift.stored_baseline(spark, root)


@query("baseline_stored", DRIFT + "\nSELECT feature, value, cnt FROM bc", ids="D0")
def q_baseline_stored(spark, sf):
    return _stored_baseline(spark, sf)[2][0]


@query("ks_by_month", DRIFT + f"""
SELECT month, feature, n_b, n_c, {R('ks', 6)} AS ks, ks_severity, 0.05::DOUBLE AS threshold_mild, 0.15::DOUBLE AS threshold_severe
FROM pf""", ids="D1 W10 D7")
def q_ks(spark, sf):
    return per_feature(spark, sf).select("month", "feature", "n_b", "n_c", F.round("ks", 6).alias("ks"),
                                         "ks_severity", "threshold_mild", "threshold_severe")


@query("psi_by_month", DRIFT + f"""
SELECT month, feature, {R('psi', 6)} AS psi, psi_severity FROM pf""", ids="D2")
def q_psi(spark, sf):
    return per_feature(spark, sf).select("month", "feature", F.round("psi", 6).alias("psi"), "psi_severity")


@query("wasserstein_by_month", DRIFT + f"""
SELECT month, feature, {R('wasserstein', 4)} AS wasserstein FROM pf""", ids="D3 W10")
def q_wasserstein(spark, sf):
    return per_feature(spark, sf).select("month", "feature", "wasserstein")


@query("js_by_month", DRIFT + """
SELECT month, feature, js_distance, js_divergence FROM pf""", ids="D4")
def q_js(spark, sf):
    return per_feature(spark, sf).select("month", "feature", "js_distance", "js_divergence")


@query("error_trend", DRIFT + "\nSELECT * FROM trend", ids="D5")
def q_error_trend(spark, sf):
    baseline, current = _inputs(spark, sf)
    return drift.error_trend(baseline, current, month_col=M).withColumnRenamed(M, "month")


_SEV_COLS = "month, severity, severe_features, mild_features, total_features, baseline_error, current_error, error_increase, drift"


@query("drift_severity", DRIFT + f"\nSELECT {_SEV_COLS} FROM sev", ids="D8 D11")
def q_drift_severity(spark, sf):
    return month_reports(spark, sf).select(*[c.strip() for c in _SEV_COLS.split(",")])


@query("drift_severity_stored", DRIFT + f"\nSELECT {_SEV_COLS} FROM sev", ids="D0 D8 D11")
def q_drift_severity_stored(spark, sf):
    baseline, current, stored = _stored_baseline(spark, sf)
    pf = drift.feature_drift(None, current, FEATURES, month_col=M, stored=stored)
    trend = drift.error_trend(baseline, current, month_col=M)
    return drift.month_severity(pf, trend, month_col=M).withColumnRenamed(M, "month")


_DECISION = """,
hv AS (SELECT YearMonth AS month, error,
              row_number() OVER (PARTITION BY YearMonth ORDER BY Store, Product, Date) AS pos,
              count(*) OVER (PARTITION BY YearMonth) AS n FROM cur_rows),
hm AS (SELECT month, avg(CASE WHEN pos <= greatest(1, n // 2) THEN abs(error) END) AS train_mae,
              avg(CASE WHEN pos > greatest(1, n // 2) THEN abs(error) END) AS val_mae FROM hv GROUP BY month),
dec AS (SELECT s.month, s.severity,
               s.severity <> 'none' AND h.train_mae > 0 AND (h.val_mae - h.train_mae) / h.train_mae >= 0.05 AS tune,
               (h.val_mae - h.train_mae) / h.train_mae AS rel
        FROM sev s LEFT JOIN hm h ON s.month = h.month),
actions AS (SELECT month, severity, CASE WHEN tune THEN 'fine_tune' ELSE 'monitor' END AS action,
                   CASE WHEN tune THEN """ + R("rel", 4) + """ ELSE 0.0 END AS improvement,
                   false AS model_updated FROM dec)"""


@query("monitor_decision", DRIFT + _DECISION + "\nSELECT * FROM actions", ids="D12 P21 W9")
def q_monitor_decision(spark, sf):
    return monitor_decisions(spark, sf)


@query("severity_rollup", DRIFT + """
SELECT count(*) AS months_monitored,
       count(*) FILTER (WHERE severity = 'severe') AS severe_months,
       count(*) FILTER (WHERE severity = 'mild') AS mild_months,
       count(*) FILTER (WHERE severity = 'none') AS none_months,
       CASE max(CASE severity WHEN 'severe' THEN 2 WHEN 'mild' THEN 1 ELSE 0 END)
            WHEN 2 THEN 'severe' WHEN 1 THEN 'mild' ELSE 'none' END AS final_severity
FROM sev""", ids="A24 F17")
def q_severity_rollup(spark, sf):
    m = month_reports(spark, sf)
    worst = F.max(drift.severity_rank(F.col("severity")))
    return m.agg(F.count(F.lit(1)).alias("months_monitored"),
                 F.count_if(F.col("severity") == "severe").alias("severe_months"),
                 F.count_if(F.col("severity") == "mild").alias("mild_months"),
                 F.count_if(F.col("severity") == "none").alias("none_months"),
                 F.when(worst == 2, "severe").when(worst == 1, "mild").otherwise("none").alias("final_severity"))


@query("healing_stats", DRIFT + _DECISION + f"""
SELECT count(*) AS total_actions, count(*) FILTER (WHERE action = 'monitor') AS monitor_only,
       count(*) FILTER (WHERE action = 'fine_tune') AS fine_tuned,
       count(*) FILTER (WHERE action = 'rollback') AS rollbacks,
       {R('avg(improvement)', 4)} AS avg_improvement
FROM actions""", ids="A25")
def q_healing_stats(spark, sf):
    a = monitor_decisions(spark, sf)
    return a.agg(F.count(F.lit(1)).alias("total_actions"),
                 F.count_if(F.col("action") == "monitor").alias("monitor_only"),
                 F.count_if(F.col("action") == "fine_tune").alias("fine_tuned"),
                 F.count_if(F.col("action") == "rollback").alias("rollbacks"),
                 F.round(F.avg("improvement"), 4).alias("avg_improvement"))


@query("alerts", DRIFT + """,
al AS (SELECT *, row_number() OVER (ORDER BY month) AS seq FROM sev)
SELECT 'ALT-' || lpad(CAST(seq AS VARCHAR), 3, '0') AS id, severity, month, severe_features, mild_features,
       current_error AS mae, error_increase AS error_ratio
FROM al WHERE severity IN ('severe', 'mild') ORDER BY month DESC LIMIT 20""", ids="P14 W8 O3")
def q_alerts(spark, sf):
    m = month_reports(spark, sf)
    # numbering runs over all months (one row per month: a small table)
    m = m.withColumn("seq", F.row_number().over(Window.orderBy("month")))
    return (m.where(F.col("severity").isin("severe", "mild"))
            .select(F.format_string("ALT-%03d", "seq").alias("id"), "severity", "month", "severe_features",
                    "mild_features", F.col("current_error").alias("mae"), F.col("error_increase").alias("error_ratio"))
            .orderBy(F.desc("month")).limit(20))


_PRED_BATCH = f""",
batch AS (SELECT YearMonth AS month, count(*) AS records, {R('avg(Rolling_Mean_4)', 2)} AS mean_pred,
                 {R('avg(Demand)', 2)} AS mean_actual FROM cur_rows GROUP BY 1)"""


@query("batches_with_drift", DRIFT + _PRED_BATCH + f"""
SELECT b.month, b.records, b.mean_actual, b.mean_pred, {R('abs(b.mean_actual - b.mean_pred)', 2)} AS mae,
       s.error_increase AS error_ratio, coalesce(s.severity, 'N/A') AS severity
FROM batch b LEFT JOIN sev s ON b.month = s.month""", ids="J5 A19")
def q_batches_with_drift(spark, sf):
    inputs = _inputs(spark, sf)
    _, current = inputs
    batch = current.groupBy(F.col(M).alias("month")).agg(F.count(F.lit(1)).alias("records"),
                                         F.round(F.avg("Rolling_Mean_4"), 2).alias("mean_pred"),
                                         F.round(F.avg("Demand"), 2).alias("mean_actual"))
    sev = month_reports(spark, sf, inputs).select("month", "error_increase", "severity")
    return (batch.join(sev, "month", "left")
            .select("month", "records", "mean_actual", "mean_pred",
                    F.round(F.abs(F.col("mean_actual") - F.col("mean_pred")), 2).alias("mae"),
                    F.col("error_increase").alias("error_ratio"),
                    F.coalesce("severity", F.lit("N/A")).alias("severity")))


@query("drift_chart_rows", DRIFT + _DECISION + f"""
SELECT s.month, s.current_error, s.baseline_error, {R('s.error_increase * 100', 1)} AS error_increase_pct,
       s.severe_features, s.mild_features, s.total_features,
       CASE s.severity WHEN 'severe' THEN 2 WHEN 'mild' THEN 1 ELSE 0 END AS severity_rank,
       coalesce(a.action, 'monitor') AS action
FROM sev s LEFT JOIN actions a ON s.month = a.month""", ids="P22 P23 J10")
def q_drift_chart_rows(spark, sf):
    inputs = _inputs(spark, sf)
    m = month_reports(spark, sf, inputs)
    a = monitor_decisions(spark, sf, inputs, m).select("month", "action")
    return (m.join(a, "month", "left")
            .select("month", "current_error", "baseline_error",
                    F.round(F.col("error_increase") * 100, 1).alias("error_increase_pct"),
                    "severe_features", "mild_features", "total_features",
                    drift.severity_rank(F.col("severity")).alias("severity_rank"),
                    F.coalesce("action", F.lit("monitor")).alias("action")))


@query("drift_kpis", DRIFT + f"""
SELECT count(*) AS months, count(*) FILTER (WHERE severity = 'severe') AS severe_months,
       count(*) FILTER (WHERE severity = 'mild') AS mild_months,
       {R('avg(coalesce(error_increase, 0.0)) * 100', 0)} AS avg_error_increase_pct
FROM sev""", ids="A35")
def q_drift_kpis(spark, sf):
    m = month_reports(spark, sf)
    return m.agg(F.count(F.lit(1)).alias("months"),
                 F.count_if(F.col("severity") == "severe").alias("severe_months"),
                 F.count_if(F.col("severity") == "mild").alias("mild_months"),
                 F.round(F.avg(F.coalesce("error_increase", F.lit(0.0))) * 100, 0).alias("avg_error_increase_pct"))


@query("severity_histogram", DRIFT + """
SELECT lower(severity) AS severity, count(*) AS months FROM sev GROUP BY 1""", ids="A38")
def q_severity_histogram(spark, sf):
    return month_reports(spark, sf).groupBy(F.lower("severity").alias("severity")).agg(
        F.count(F.lit(1)).alias("months"))


_IMPORTANCE = """,
imp AS (UNPIVOT (SELECT """ + ", ".join(f"coalesce(abs(corr({c}, Demand)), 0.0) AS {c}" for c in FEATURES) + """
                 FROM base_rows) ON """ + ", ".join(FEATURES) + """ INTO NAME feature VALUE importance),
pct AS (SELECT quantile_cont(importance, 0.8) AS p_high, quantile_cont(importance, 0.5) AS p_medium,
               quantile_cont(importance, 0.2) AS p_low FROM imp)"""

# thresholds scaled by the importance category of the feature
_DYNAMIC = _IMPORTANCE + """,
fac AS (SELECT feature, CAST(CASE WHEN importance >= p_high THEN 0.7 WHEN importance <= p_low THEN 1.3 ELSE 1.0 END AS DOUBLE) AS f
        FROM imp, pct),
dpf AS (SELECT pf.month, CASE WHEN ks < 0.05::DOUBLE * f THEN 'none' WHEN ks < 0.15::DOUBLE * f THEN 'mild' ELSE 'severe' END AS k,
               CASE WHEN psi < 0.1::DOUBLE * f THEN 'none' WHEN psi < 0.25::DOUBLE * f THEN 'mild' ELSE 'severe' END AS p
        FROM pf JOIN fac ON pf.feature = fac.feature),
dcn AS (SELECT month, count(*) FILTER (WHERE k = 'severe') + count(*) FILTER (WHERE p = 'severe') AS severe_features,
               count(*) FILTER (WHERE k = 'mild') AS mild_features, count(*) AS total_features FROM dpf GROUP BY month)
SELECT t.month, CASE WHEN coalesce(c.severe_features, 0) > 0 OR drift THEN 'severe'
                     WHEN c.mild_features > c.total_features * 0.3 THEN 'mild' ELSE 'none' END AS severity,
       coalesce(c.severe_features, 0) AS severe_features, coalesce(c.mild_features, 0) AS mild_features,
       coalesce(c.total_features, 0) AS total_features
FROM trend t LEFT JOIN dcn c ON t.month = c.month"""


@query("drift_severity_dynamic", DRIFT + _DYNAMIC, ids="D1 D2 D6 D7 D8")
def q_drift_severity_dynamic(spark, sf):
    baseline, current = _inputs(spark, sf)
    categories = drift.importance_category(drift.correlation_importance(baseline, FEATURES))
    pf = drift.feature_drift(baseline, current, FEATURES, categories, month_col=M)
    months = drift.month_severity(pf, drift.error_trend(baseline, current, month_col=M), month_col=M)
    return months.select(F.col(M).alias("month"), "severity", "severe_features", "mild_features", "total_features")


@query("importance_thresholds", DRIFT + _IMPORTANCE + """
SELECT feature, """ + R("importance", 6) + """ AS importance,
       CASE WHEN importance >= p_high THEN 'high' WHEN importance <= p_low THEN 'low' ELSE 'medium' END AS category,
       CAST(CASE WHEN importance >= p_high THEN 0.7 WHEN importance <= p_low THEN 1.3 ELSE 1.0 END AS DOUBLE) AS factor
FROM imp, pct""", ids="D6 D7")
def q_importance_thresholds(spark, sf):
    baseline, _ = _inputs(spark, sf)
    imp = drift.correlation_importance(baseline, FEATURES)
    cat = drift.importance_category(imp)
    return cat.select("feature", F.round("importance", 6).alias("importance"), "category",
                      F.when(F.col("category") == "high", 0.7).when(F.col("category") == "low", 1.3)
                      .otherwise(1.0).alias("factor"))


@query("feature_families", DRIFT + """,
imp AS (UNPIVOT (SELECT """ + ", ".join(f"coalesce(abs(corr({c}, Demand)), 0.0) AS {c}" for c in FEATURES) + """
                 FROM base_rows) ON """ + ", ".join(FEATURES) + """ INTO NAME feature VALUE raw),
fam AS (SELECT feature, """ + R("raw", 6) + """ AS importance, """ + feature_family_sql("feature") + """ AS family FROM imp)
SELECT feature, family, importance,
       """ + R("sum(importance) OVER (PARTITION BY family) / greatest(sum(importance) OVER (), 1e-300)", 4) + """ AS family_share,
       CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank,
       CAST(row_number() OVER (PARTITION BY family ORDER BY importance DESC, feature) AS INTEGER) AS rank_in_family
FROM fam""", ids="A36 O2 O7 P17")
def q_feature_families(spark, sf):
    baseline, _ = _inputs(spark, sf)
    imp = drift.correlation_importance(baseline, FEATURES).withColumn("importance", F.round("importance", 6))
    return feature_families(imp)

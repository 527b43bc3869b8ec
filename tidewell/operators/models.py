"""Model jobs on MLlib (M1-M7): table in, table out. Versions are kept by
``sources.model_registry`` (K8), month-ahead scoring is ``forecast.month_ahead_model`` (M8).

Fitting is distributed by MLlib; the driver only loops over the handful of
parameter draws (M2) and tree models (M4) and over months in the heal job (M7).
"""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.features import FeatureState

# The reference's search space (estimators, depth, learning rate).
GRID = {"maxIter": [100, 150], "maxDepth": [6, 8], "stepSize": [0.1, 0.15]}
Z95 = 1.96
HEAL_MIN_IMPROVEMENT = 0.05


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def fit_gbt(train: DataFrame, features: list[str], maxIter: int = 100, maxDepth: int = 6,
            stepSize: float = 0.1, seed: int = 42, min_rows: int = 20) -> PipelineModel:
    """Gradient-boosted regression of Demand (M1); row subsampling 0.8 as in the reference.
    A training set under ``min_rows`` rows is refused (P8)."""
    from tidewell.operators.split import require_rows
    require_rows(train, min_rows)
    gbt = GBTRegressor(labelCol="Demand", featuresCol="features", maxIter=maxIter, maxDepth=maxDepth,
                       stepSize=stepSize, subsamplingRate=0.8, minInstancesPerNode=3, maxBins=256, seed=seed)
    return Pipeline(stages=[_assembler(features), gbt]).fit(train)


def fit_forest(train: DataFrame, features: list[str], numTrees: int = 30, maxDepth: int = 8,
               seed: int = 42) -> PipelineModel:
    """Random forest used for prediction intervals (M3)."""
    rf = RandomForestRegressor(labelCol="Demand", featuresCol="features", numTrees=numTrees,
                               maxDepth=maxDepth, seed=seed)
    return Pipeline(stages=[_assembler(features), rf]).fit(train)


def predict(model: PipelineModel, df: DataFrame, col: str = "Predicted") -> DataFrame:
    """Batch scoring (M5)."""
    return model.transform(df).withColumnRenamed("prediction", col).drop("features")


def predict_with_interval(model: PipelineModel, forest: PipelineModel | None, df: DataFrame) -> DataFrame:
    """Prediction with a 95 % interval: +-1.96 x population std over the forest's trees,
    lower bound clipped at 0; without a forest sigma = 0.1 |prediction| (M4, F14)."""
    scored = predict(model, df, "Predicted")
    if forest is None:
        sigma = F.abs(F.col("Predicted")) * 0.1
        return scored.withColumns({"CI_Lower": F.greatest(F.col("Predicted") - Z95 * sigma, F.lit(0.0)),
                                   "CI_Upper": F.col("Predicted") + Z95 * sigma})
    assembled = forest.stages[0].transform(scored)
    trees = forest.stages[-1].trees
    for i, t in enumerate(trees):
        t = t.copy()
        t.setPredictionCol(f"_tree{i}")
        t.setFeaturesCol("features")
        assembled = t.transform(assembled)
    arr = F.array(*[F.col(f"_tree{i}") for i in range(len(trees))])
    n = float(len(trees))
    mean = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    sd = F.sqrt(var)
    return (assembled.withColumns({"CI_Lower": F.greatest(F.col("Predicted") - Z95 * sd, F.lit(0.0)),
                                   "CI_Upper": F.col("Predicted") + Z95 * sd})
            .drop("features", *[f"_tree{i}" for i in range(len(trees))]))


def feature_importances(model: PipelineModel, features: list[str]) -> DataFrame:
    """(feature, importance) rows from the fitted model (M6)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    # one value per feature (tens of rows), built from the model on the driver
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")


@dataclass(frozen=True)
class ForecastModel:
    """A fitted pipeline with what scoring new weeks needs: the feature state (E3), the feature
    list the pipeline was trained on (P10), the interval forest if there is one."""
    pipeline: PipelineModel
    state: FeatureState
    features: list[str]
    forest: PipelineModel | None = None
    version: str | None = None


@dataclass
class SearchResult:
    params: dict
    mae: float
    scores: list


def _mae(model: PipelineModel, rows: DataFrame) -> float | None:
    return predict(model, rows).agg(F.avg(F.abs(F.col("Demand") - F.col("Predicted")))).first()[0]


def search(train: DataFrame, features: list[str], n_draws: int = 5, folds: int = 2, seed: int = 42,
           grid: dict | None = None, parallelism: int = 4) -> SearchResult:
    """Random draws from the grid scored by MAE on expanding time folds (M2).

    Fold k trains on the first k/(folds+1) of the dates and validates on the
    next slice (``TimeSeriesSplit``-style), cut points from approximate date
    quantiles (one aggregate). The fits of all draws and folds are independent and are
    submitted together by a small driver thread pool. ``scores`` holds (params, fold MAEs,
    mean); a fold without validation rows is left out of the mean.
    """
    grid = grid or GRID
    combos = [dict(zip(grid, vals)) for vals in product(*grid.values())]
    draws = random.Random(seed).sample(combos, min(n_draws, len(combos)))
    day = F.datediff("Date", F.lit("1970-01-01"))
    cuts = train.agg(F.percentile_approx(day, [k / (folds + 1) for k in range(1, folds + 2)], 10000)).first()[0]

    def fold_mae(task):
        params, k = task
        model = fit_gbt(train.where(day <= cuts[k]), features, **params)
        return _mae(model, train.where((day > cuts[k]) & (day <= cuts[k + 1])))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        maes = list(pool.map(fold_mae, [(params, k) for params in draws for k in range(folds)]))
    scores = []
    for i, params in enumerate(draws):
        own = maes[i * folds:(i + 1) * folds]
        known = [m for m in own if m is not None]
        scores.append((params, own, sum(known) / len(known) if known else float("inf")))
    best = min(scores, key=lambda s: s[2])
    return SearchResult(best[0], best[2], scores)


def search_scores(result: SearchResult, spark: SparkSession) -> DataFrame:
    """(draw, params, fold, mae, chosen) rows of a search (one per draw and fold)."""
    rows = [(i, {k: float(v) for k, v in params.items()}, k, m, params == result.params)
            for i, (params, maes, _) in enumerate(result.scores) for k, m in enumerate(maes)]
    return spark.createDataFrame(rows, "draw int, params map<string,double>, fold int, mae double, chosen boolean")


def heal_month(model: PipelineModel, month_rows: DataFrame, features: list[str], params: dict,
               month_col: str = "YearMonth") -> dict:
    """Heal decision for one month (M7): a candidate is fitted on the first half and kept
    when it lowers the second half's MAE by at least 5 %; the current model is never mutated."""
    from tidewell.operators.split import validation_halves
    # the month key must not be called "month": names resolve case-insensitively and Month is a feature
    halves = validation_halves(month_rows, month_col)
    first = halves.where(F.col("half") == "first")
    second = halves.where(F.col("half") == "second")
    base_mae = _mae(model, second)
    # the candidate is a refit on half a month: no minimum size, as in the reference's fine-tune
    cand = fit_gbt(first, features, **params, min_rows=1)
    new_mae = _mae(cand, second)
    improvement = (base_mae - new_mae) / (base_mae + 1e-9)
    if improvement >= HEAL_MIN_IMPROVEMENT:
        return {"action": "fine_tune", "improvement": improvement, "model_updated": True, "model": cand}
    return {"action": "rollback", "improvement": 0.0, "model_updated": False, "model": model}


def heal_months(model: PipelineModel, rows: DataFrame, features: list[str], params: dict,
                severities: DataFrame, month_col: str = "YearMonth", parallelism: int = 4) -> DataFrame:
    """M7 for every month of ``severities`` (month, severity), the drift report of ``rows``.

    A month without drift is monitored: no candidate is fitted for it. The candidate fits of
    the drifted months are independent, so they are submitted as concurrent Spark jobs from a
    small driver thread pool. A drifted month without rows is monitored as well."""
    months = {r["month"]: r["severity"] for r in severities.select("month", "severity").collect()}
    drifted = sorted(m for m, s in months.items() if s != "none")
    present = {r[0] for r in rows.where(F.col(month_col).isin(drifted)).select(month_col).distinct().collect()}

    def one(m):
        if m not in present:
            return m, months[m], "monitor", 0.0, False
        d = heal_month(model, rows.where(F.col(month_col) == m), features, params, month_col)
        return m, months[m], d["action"], float(d["improvement"]), bool(d["model_updated"])

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        healed = list(pool.map(one, drifted))
    calm = [(m, s, "monitor", 0.0, False) for m, s in months.items() if s == "none"]
    return rows.sparkSession.createDataFrame(
        sorted(calm + healed), "month string, severity string, action string, improvement double, model_updated boolean")

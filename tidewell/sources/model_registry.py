"""Model versions (K8): a folder per version, a metadata table, a pointer to the current one.

``register`` writes the pipeline, the interval forest and the feature state into a new version
folder, then one metadata row (parameters, metrics, features), and switches the pointer last.
Both tables are append-only, so an older version can be made current again and the history of
switches stays readable. A version without a metadata row is incomplete and can't be current.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import features as fe
from tidewell.operators.models import ForecastModel
from tidewell.sources import runs

_META = ("version string, saved_at timestamp, model_type string, params map<string,string>, "
         "metrics map<string,double>, features array<string>, has_forest boolean")
_POINTER = "switch_id string, version string"


def register(spark: SparkSession, root: str, model: ForecastModel, params: dict | None = None,
             metrics: dict | None = None, make_current: bool = True) -> str:
    """Save ``model`` as a new version; returns its name."""
    root = root.rstrip("/")
    version = f"v{runs.new_run_id()}"
    folder = f"{root}/versions/{version}"
    model.pipeline.write().overwrite().save(f"{folder}/model")
    if model.forest is not None:
        model.forest.write().overwrite().save(f"{folder}/forest")
    fe.save_state(model.state, model.features, f"{folder}/state", spark)
    kind = type(model.pipeline.stages[-1]).__name__
    row = [(version, kind, {k: str(v) for k, v in (params or {}).items()},
            {k: float(v) for k, v in (metrics or {}).items()}, list(model.features), model.forest is not None)]
    meta = spark.createDataFrame(row, _META.replace("saved_at timestamp, ", ""))
    (meta.select("version", F.current_timestamp().alias("saved_at"), "model_type", "params", "metrics", "features",
                 "has_forest").coalesce(1).write.mode("append").parquet(f"{root}/metadata"))
    if make_current:
        switch(spark, root, version)
    return version


def _metadata(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root.rstrip('/')}/metadata"
    return spark.read.schema(_META).parquet(path) if runs.exists(spark, path) else spark.createDataFrame([], _META)


def switch(spark: SparkSession, root: str, version: str) -> None:
    """Make a complete version the current one."""
    if not _metadata(spark, root).where(F.col("version") == version).limit(1).count():
        raise LookupError(f"no complete model version {version!r} below {root}")
    (spark.createDataFrame([(runs.new_run_id(), version)], _POINTER).coalesce(1)
     .write.mode("append").parquet(f"{root.rstrip('/')}/current"))


def current_version(spark: SparkSession, root: str) -> str | None:
    path = f"{root.rstrip('/')}/current"
    if not runs.exists(spark, path):
        return None
    return spark.read.schema(_POINTER).parquet(path).agg(F.max_by("version", "switch_id").alias("v")).first()["v"]


def versions(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of every complete version, newest first, with ``is_current``."""
    now = current_version(spark, root)
    return (_metadata(spark, root).withColumn("is_current", F.col("version") == F.lit(now or ""))
            .orderBy(F.desc("version")))


def load(spark: SparkSession, root: str, version: str | None = None) -> ForecastModel:
    """The current version (or ``version``) ready to score."""
    root = root.rstrip("/")
    version = version or current_version(spark, root)
    meta = _metadata(spark, root).where(F.col("version") == F.lit(version or "")).first()
    if meta is None:
        raise LookupError(f"no complete model version {version!r} below {root}")
    folder = f"{root}/versions/{version}"
    state, names = fe.load_state(spark, f"{folder}/state")
    forest = PipelineModel.load(f"{folder}/forest") if meta["has_forest"] else None
    return ForecastModel(PipelineModel.load(f"{folder}/model"), state, names, forest, version)

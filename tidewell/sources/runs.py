"""Published runs (K7, K10, S16): a set of tables that becomes visible as a whole.

A run's tables are written to ``<root>/data/<run_id>/<table>``; its manifest, one small JSON
row in ``<root>/manifests/run_id=<run_id>``, is written last. Readers look at manifests only,
so a run that is still being written, or whose job died half way, does not exist for them,
and a job that started on one run keeps reading that run while a newer one is published.
Run ids begin with the UTC time of publication, so the newest complete run has the greatest id.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "tables array<string>, info map<string,string>, run_id string"


@dataclass(frozen=True)
class Run:
    run_id: str
    tables: list[str]
    info: dict[str, str]


def new_run_id() -> str:
    return dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f") + "-" + uuid.uuid4().hex[:8]


def _path(spark: SparkSession, path: str):
    """(file system, path) of any storage Spark can reach."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder (none when it does not exist)."""
    fs, p = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_table(spark: SparkSession, root: str, run_id: str, name: str, df: DataFrame,
                partition_by: str | None = None) -> None:
    """One table of a run, not visible to readers yet."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(f"{root.rstrip('/')}/data/{run_id}/{name}")


def complete(spark: SparkSession, root: str, run_id: str, tables: list[str], info: dict[str, str] | None = None) -> None:
    """Write the manifest: from here on the run is visible."""
    row = spark.createDataFrame([(tables, info or {})], "tables array<string>, info map<string,string>")
    row.coalesce(1).write.mode("overwrite").json(f"{root.rstrip('/')}/manifests/run_id={run_id}")


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], info: dict[str, str] | None = None,
            partition_by: dict[str, str] | None = None, keep: int | None = None) -> str:
    """Write all tables, then the manifest; ``keep`` purges all but that many newest runs."""
    run_id = new_run_id()
    for name, df in tables.items():
        write_table(spark, root, run_id, name, df, (partition_by or {}).get(name))
    complete(spark, root, run_id, list(tables), info)
    if keep is not None:
        purge(spark, root, keep)
    return run_id


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, tables, info) of every complete run."""
    path = f"{root.rstrip('/')}/manifests"
    if not exists(spark, path):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).json(path).where(F.col("tables").isNotNull())


def resolve(spark: SparkSession, root: str, run_id: str | None = None) -> Run:
    """The newest complete run, or the complete run ``run_id``."""
    found = manifests(spark, root)
    if run_id is not None:
        found = found.where(F.col("run_id") == run_id)
    row = found.agg(F.max_by(F.struct("run_id", "tables", "info"), "run_id").alias("r")).first()["r"]
    if row is None:
        raise LookupError(f"no complete run below {root}" if run_id is None else f"no complete run {run_id} below {root}")
    return Run(row["run_id"], list(row["tables"]), dict(row["info"] or {}))


def read(spark: SparkSession, root: str, table: str, run_id: str | None = None) -> DataFrame:
    """A table of the newest complete run (or of ``run_id``)."""
    run = resolve(spark, root, run_id)
    if table not in run.tables:
        raise LookupError(f"run {run.run_id} has no table {table!r}: {run.tables}")
    return spark.read.parquet(f"{root.rstrip('/')}/data/{run.run_id}/{table}")


def purge(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Remove all but the ``keep`` newest complete runs, and data older than them that no
    manifest names (runs that died half way). A manifest goes before its data, so readers
    never resolve a run whose files are going. Data newer than the newest complete run may
    be a run under way and stays."""
    root = root.rstrip("/")
    complete_ids = sorted(r["run_id"] for r in manifests(spark, root).select("run_id").collect())
    kept = set(complete_ids[-keep:]) if keep > 0 else set()
    newest = complete_ids[-1] if complete_ids else ""
    gone = [r for r in children(spark, f"{root}/data") if r not in kept and r <= newest]
    for run_id in gone:
        delete(spark, f"{root}/manifests/run_id={run_id}")
    for run_id in gone:
        delete(spark, f"{root}/data/{run_id}")
    return gone


# ── S16: saved months ──────────────────────────────────────────────────────
def month_summary(forecasts: DataFrame, month: str | None = None) -> DataFrame:
    """Rows and mean forecast per saved month, or of one month (the filter prunes partitions)."""
    rows = forecasts if month is None else forecasts.where(F.col("month") == month)
    return rows.groupBy("month").agg(F.count(F.lit(1)).alias("count"),
                                     F.round(F.avg("Predicted_Demand"), 2).alias("mean_predicted"))


def saved_comparison(comparisons: DataFrame, month: str) -> DataFrame:
    """The stored comparison record of one month."""
    return comparisons.where(F.col("month") == month)

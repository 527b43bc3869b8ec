"""Table writes.

Month-partitioned Parquet tables; a month is replaced with dynamic partition
overwrite (only the partitions present in the written frame are replaced), and
a frame is never written over the path it is read from in the same plan: the
new content goes to a staging path first (SURVEY §7.6-6).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.sources import runs


def by_month_parts(df: DataFrame, month_col: str = "month") -> DataFrame:
    """Deal rows by month in parts of about the advisory partition size: AQE splits a large
    month over as many tasks as its bytes need and lets one task write several small months."""
    return df.hint("rebalance", month_col)


MONITOR_COLUMNS = ["Store", "Product", "Date", "Demand", "Predicted"]


def write_monitor_predictions(pred: DataFrame, path: str, run_ts: str) -> None:
    """The monitor's form of a prediction run (K1b): keys, actual and prediction only."""
    write_predictions(pred.select(*[c for c in MONITOR_COLUMNS if c in pred.columns], "month"), path, run_ts)


def write_predictions(pred: DataFrame, path: str, run_ts: str) -> None:
    """Per-month prediction rows of one run (K1): partitioned by month and run,
    rows in the canonical Store, Product, Date order inside each file (O1)."""
    series = [k for k in ("Store", "Product") if k in pred.columns]
    (by_month_parts(pred.withColumn("run_ts", F.lit(run_ts)))
     .sortWithinPartitions(*series, "Date")
     .write.mode("append").partitionBy("month", "run_ts").parquet(path))


def write_forecast(fc: DataFrame, current_path: str, history_path: str, run_ts: str) -> None:
    """Forecast of a month: the "current" table per month (replaced) plus a timestamped copy (K2)."""
    by_month_parts(fc).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(current_path)
    by_month_parts(fc.withColumn("run_ts", F.lit(run_ts))).write.mode("append").partitionBy("month", "run_ts").parquet(history_path)


def append_log(records: DataFrame, path: str) -> None:
    """Append-only log table (K3, K9)."""
    records.write.mode("append").parquet(path)


def replace_month_partitions(df: DataFrame, path: str, staging_root: str, month_col: str = "month") -> None:
    """Replace the months present in ``df`` inside the table at ``path`` (K4, K5, K6).

    ``df`` may be derived from the table itself: it is written to a fresh
    staging path first, then the staged partitions overwrite the target's.
    """
    staging = f"{staging_root.rstrip('/')}/stage-{uuid.uuid4().hex}"
    by_month_parts(df, month_col).write.mode("overwrite").partitionBy(month_col).parquet(staging)
    staged = df.sparkSession.read.schema(df.schema).parquet(staging)
    (by_month_parts(staged, month_col).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(month_col).parquet(path))
    runs.delete(df.sparkSession, staging)


def save_state_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Fitted statistics and dictionaries (K7) as small Parquet tables."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}")


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """Outputs of one run: overwrite that run only; readers take the latest run."""
    (df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path))

"""Structured Streaming jobs.

The reference is batch-only; these are the streaming forms of its repeated
uploads (T1), of a windowed demand signal (T2) and of the error-trend monitor
(T3).  All run with ``trigger(availableNow=True)`` for bounded runs and keep
their progress in a checkpoint location on shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.calendar import year_month
from tidewell.functions.keys import series_keys
from tidewell.operators.reconcile import dedupe_last
from tidewell.session import cut_lineage
from tidewell.sources import runs
from tidewell.sources.sinks import replace_month_partitions


def ingest_actuals_stream(spark: SparkSession, source_dir: str, schema, table_path: str,
                          checkpoint: str, staging_root: str, file_format: str = "parquet",
                          max_files: int | None = None):
    """Uploaded files of actuals replace their months in the history table (K5).

    An upload is a file, or the part files of one Spark write, which share the write's id. A
    month's content is the newest upload that holds it (by modification time, then path),
    however the files fall into micro-batches and in whatever order they arrive; part files of
    the upload that a month holds already are added to it. The stream's
    ledger of (month, modification time, file), kept next to its checkpoint, says which upload
    a month holds: a batch replaces a month only by an upload newer than the ledger's. Each
    batch writes its own ledger partition after the months; a retried batch reads the ledger of
    earlier batches only, so it decides alike and rewrites the same partitions. Inside an upload
    the last row per series and date wins (A22); rows without a date are dropped. ``Store`` is
    optional."""
    stream = spark.readStream.schema(schema).format(file_format)
    if file_format == "csv":
        stream = stream.option("header", True)
    if max_files is not None:
        stream = stream.option("maxFilesPerTrigger", max_files)
    stream = stream.load(source_dir).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_modification_time").alias("_mtime"),
        F.col("_metadata.file_block_start").alias("_block"))
    part = r"/part-\d+-([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})[^/]*$"
    stream = stream.withColumn("_upload", F.regexp_replace("_file", part, "/$1"))
    ledger_path = f"{checkpoint.rstrip('/')}/month-ledger"
    helpers = ["_upload", "_mtime", "_file", "_block", "_line"]

    def upsert(batch: DataFrame, epoch: int) -> None:
        rows = (batch.where(F.col("Date").isNotNull())
                .withColumns({"month": year_month("Date"), "_line": F.monotonically_increasing_id()}))
        claims = rows.groupBy("month", "_upload").agg(F.max("_mtime").alias("_mtime"))
        held = read_ledger(spark, ledger_path).where(F.col("epoch") < epoch)
        held = held.groupBy("month").agg(F.max(F.struct("mtime", "file")).alias("_held"))
        held = held.select("month", F.col("_held.mtime").alias("_held_mtime"), F.col("_held.file").alias("_held_upload"))
        claims = claims.join(held, "month", "left")
        # further part files of the upload held count with it, whichever was written last
        claims = claims.withColumn("_more", F.coalesce(F.col("_upload") == F.col("_held_upload"), F.lit(False)))
        claims = claims.withColumn("_mtime", F.when(F.col("_more"), F.greatest("_mtime", "_held_mtime")).otherwise(F.col("_mtime")))
        newest = F.max(F.struct("_mtime", "_upload", "_more", "_held_mtime", "_held_upload")).alias("_claim")
        c, h = F.struct("_mtime", "_upload"), F.struct("_held_mtime", "_held_upload")
        wins = cut_lineage(claims.groupBy("month").agg(newest).select("month", "_claim.*")
                           .where(F.col("_more") | F.col("_held_upload").isNull() | (c > h))
                           .select("month", "_mtime", "_upload", "_more"))
        if wins.limit(1).count():
            found = rows.join(wins.select("month", "_upload"), ["month", "_upload"])
            added_to = [r.month for r in wins.where("_more").select("month").collect()]
            if added_to:
                table = spark.read.schema(rows.drop(*helpers).schema).parquet(table_path)
                found = found.unionByName(table.where(F.col("month").isin(added_to)), allowMissingColumns=True)
            keys = [*series_keys(found), "Date"]
            # rows of the table have no file: they come first
            found = dedupe_last(found, keys, ["_mtime", "_file", "_block", "_line"]).drop(*helpers)
            replace_month_partitions(found, table_path, staging_root)
        (wins.select("month", F.col("_mtime").alias("mtime"), F.col("_upload").alias("file"))
         .coalesce(1).write.mode("overwrite").parquet(f"{ledger_path}/epoch={epoch}"))

    return (stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


_LEDGER = "month string, mtime timestamp, file string, epoch bigint"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(month, mtime, file, epoch): the uploads that replaced a month, batch by batch."""
    if not runs.exists(spark, path):
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).parquet(path)


def _with_watermark(df: DataFrame, watermark: str | None) -> DataFrame:
    """Watermarks need an instant type: wall-clock (NTZ) times are read in the session
    time zone for streaming; batch use (no watermark) windows the wall clock directly."""
    if watermark is None:
        return df
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def windowed_event_values(events: DataFrame, window: str = "1 day", watermark: str | None = "1 hour") -> DataFrame:
    """Tumbling-window count and mean value per event type; data later than the watermark is dropped."""
    return (_with_watermark(events, watermark)
            .groupBy(F.window("ts", window).alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("events"), F.avg("value").alias("mean_value"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "event_type", "events", "mean_value"))


def windowed_error_trend(errors: DataFrame, baseline: DataFrame, window: str = "1 day",
                         watermark: str | None = "1 hour", error_col: str = "error") -> DataFrame:
    """Windowed mean |error| of a stream against a static baseline mean (D5 rule).

    The static baseline mean is computed once when the query is defined and
    attached as a literal.
    """
    from tidewell.functions.scalars import row_literals
    base = row_literals(baseline.agg(F.avg(F.abs(error_col)).alias("baseline_error")))
    cur = (_with_watermark(errors, watermark)
           .groupBy(F.window("ts", window).alias("w"))
           .agg(F.avg(F.abs(error_col)).alias("current_error"), F.count(F.lit(1)).alias("n")))
    inc = (F.col("current_error") - F.col("baseline_error")) / (F.col("baseline_error") + 1e-9)
    return (cur.withColumns(base)
            .select(F.col("w.start").alias("window_start"), "n",
                    F.round("baseline_error", 2).alias("baseline_error"),
                    F.round("current_error", 2).alias("current_error"),
                    F.round(inc, 4).alias("error_increase"), (inc > 0.10).alias("drift")))


def run_to_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Bounded run into an in-memory table (tests, smoke runs)."""
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q

"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import ensure_checkpoint_dir

SPACE_RUN = r"[\x20\x09-\x0D]+"        # white space of the word rule
SLICE_BYTES = 1 << 20                  # bytes of text handled at once inside a task


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it. (On a cluster
    the package is installed or shipped with --py-files; this covers local sessions whose
    PYTHONPATH lacks it.)"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *[p for p in paths if p]])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into a new folder below ``spark.checkpoint.dir`` and read it
    back: lineage ends at files every executor sees, and later readers prune columns."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidewell-llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bit_table(df: DataFrame, slot: Column, bits: int) -> np.ndarray:
    """``bits`` bits as 64-bit words, those of the column ``slot`` (0 to ``bits`` - 1) set. The
    words reach the driver as Arrow columns (16 bytes a word), not as a Row each."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    got = (df.select(F.shiftright(slot, 6).cast("long").alias("w"), bit.alias("b"))
           .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())               # at most bits / 64 rows
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return out


def text_slices(batches: Iterator[pa.RecordBatch], column: str,
                max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into zero-copy runs of rows of about ``max_bytes`` of text (a
    longer text stays whole, alone in its run)."""
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin, total = 0, 0
        for i in range(n):
            if total and total + size[i] > max_bytes:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += int(size[i])
        yield batch.slice(begin, n - begin)


def word_count(text):
    """Number of words of a text column (null: 0), JVM only."""
    cleaned = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " "))
    return F.when(F.length(cleaned) == 0, F.lit(0).cast("long")).otherwise(
        (F.length(cleaned) - F.length(F.replace(cleaned, F.lit(" "), F.lit(""))) + 1).cast("long"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Helper column names that no column of ``df`` has (whatever its case): a name that is
    taken gets underscores until it is free."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out

"""Distributed running sums and as-of lookups over an ordered key, per group.

A window ``sum(x) over (partition by g order by v)`` sends each group ``g``
to one task.  For distribution comparisons a group is (month, feature) and can
hold as many distinct values as the table has rows, so the work is done in two
levels, always:

1. order-preserving buckets of ``v`` by bounds that the caller computed once
   (``bucket_bounds``: approximate quantiles, one small row per group) or stored;
2. bucket totals, and their exclusive running sum over the bucket index (a
   table of #groups x #buckets rows);
3. the running sum inside each (group, bucket), plus the bucket's offset.

Results equal the plain window exactly, whatever the bounds; only the work
distribution changes.  The number of buckets follows the largest group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import cut_lineage

TARGET_ROWS = 2_000_000     # rows of the largest group in one bucket, about
LEAST_BUCKETS = 4


def bucket_count(df: DataFrame, group_cols: list[str]) -> int:
    """Buckets for which a bucket of the largest group holds about ``TARGET_ROWS`` rows."""
    largest = df.groupBy(*group_cols).count().agg(F.max("count").alias("n")).first()["n"] or 0
    return max(LEAST_BUCKETS, -(-largest // TARGET_ROWS))


def bucket_bounds(df: DataFrame, group_cols: list[str], key_col: str, buckets: int) -> DataFrame:
    """(group, ``_bounds``): inner bucket borders of ``key_col`` per group. Approximate quantiles
    depend on the order partial results are merged in, so they are written once (reliable
    checkpoint, #groups rows) and every use sees the same borders."""
    probs = [i / buckets for i in range(1, buckets)] or [0.5]
    return small_side(cut_lineage(df.groupBy(*group_cols).agg(
        F.percentile_approx(key_col, probs, max(1000, 20 * buckets)).alias("_bounds"))), F.size("_bounds"))


BROADCAST_CELLS = 1 << 19   # numbers (or rows) of a table that may be broadcast, 8 bytes or so each


def small_side(table: DataFrame, cells: Column | None = None) -> DataFrame:
    """``table``, to be broadcast where its counted size (rows, or the sum of ``cells``) is at
    most ``BROADCAST_CELLS``; larger ones join by shuffle. For tables written by a checkpoint,
    whose size the planner does not know before it has shuffled the other side."""
    n = table.agg(F.sum(cells if cells is not None else F.lit(1)).alias("n")).first()["n"] or 0
    return F.broadcast(table) if n <= BROADCAST_CELLS else table


def bucketed(df: DataFrame, bounds: DataFrame, key_col: str) -> DataFrame:
    """Add ``_b``: the number of bounds of the row's group below its key."""
    on = [c for c in bounds.columns if c != "_bounds"]
    k = F.col(key_col)
    return (df.join(bounds, on).withColumn("_b", F.size(F.filter("_bounds", lambda x: x < k))).drop("_bounds"))


def running_sums(df: DataFrame, group_cols: list[str], order_col: str, sum_cols: list[str],
                 bounds: DataFrame) -> DataFrame:
    """Add ``cum_<c>``: the inclusive running sum of c ordered by ``order_col`` per group. Rows
    must be unique per (group, order_col); ``bounds`` may be kept for part of the group only."""
    keyed = bucketed(df, bounds, order_col)
    totals = keyed.groupBy(*group_cols, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    before = Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group_cols, "_b",
                            *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sum_cols])
    inside = Window.partitionBy(*group_cols, "_b").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.join(offsets, group_cols + ["_b"])
    return (out.withColumns({f"cum_{c}": F.col(f"_o_{c}") + F.sum(c).over(inside) for c in sum_cols})
            .drop("_b", *[f"_o_{c}" for c in sum_cols]))


def as_of(source: DataFrame, queries: DataFrame, group_cols: list[str], key_col: str, columns: list[str],
          bounds: DataFrame) -> DataFrame:
    """Each query row with ``columns`` of the last source row of its group whose key is at most
    its own (null if there is none): a lookup in two levels like ``running_sums``.

    ``source`` has the group, the key and the columns. A bucket's last source row comes from one
    aggregate over the source, carried forward over the small (group, bucket) table; inside a
    bucket, source and query rows are sorted together and filled forward."""
    ends = bucketed(source, bounds, key_col).groupBy(*group_cols, "_b").agg(
        *[F.max_by(c, F.col(key_col)).alias(f"_p_{c}") for c in columns])
    every = bounds.select(*group_cols, F.explode(F.sequence(F.lit(0), F.size("_bounds"))).alias("_b"))
    before = Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    steps = every.join(ends, [*group_cols, "_b"], "left").select(
        *group_cols, "_b", *[F.last(f"_p_{c}", ignorenulls=True).over(before).alias(f"_p_{c}") for c in columns])
    both = source.withColumn("_t", F.lit(0)).unionByName(queries.withColumn("_t", F.lit(1)), allowMissingColumns=True)
    inside = (Window.partitionBy(*group_cols, "_b").orderBy(key_col, "_t")
              .rowsBetween(Window.unboundedPreceding, 0))
    out = bucketed(both, bounds, key_col).join(steps, [*group_cols, "_b"])
    return (out.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_p_{c}")) for c in columns})
            .where(F.col("_t") == 1).drop("_b", "_t", *[f"_p_{c}" for c in columns]))

"""Splits (P4, P5, P21) and the month filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.calendar import year_month


def split_years(df: DataFrame) -> tuple[list[int], int]:
    """Train years (first three) and test year (fourth, else the last).

    Collects only the distinct years (a handful of values) to the driver.
    With fewer than four years the test year is also a train year, as in the
    reference; ``year_split`` can refuse that.
    """
    years = sorted(r[0] for r in df.select(F.year("Date").alias("y")).distinct().collect())
    if len(years) < 2:
        raise ValueError(f"need at least 2 years of data, found {years}")
    return years[:3], (years[3] if len(years) > 3 else years[-1])


def year_split(df: DataFrame, allow_overlap: bool = True) -> tuple[DataFrame, DataFrame, list[int], int]:
    train_years, test_year = split_years(df)
    if not allow_overlap and test_year in train_years:
        raise ValueError(f"test year {test_year} is also a training year {train_years}")
    train = df.where(F.year("Date").isin(train_years))
    test = df.where(F.year("Date") == test_year)
    return train, test, train_years, test_year


def year_split_summary(df: DataFrame) -> DataFrame:
    """One-row split report (rows, date range, months) from a single aggregate pass."""
    train_years, test_year = split_years(df)
    y = F.year("Date")
    is_train = y.isin(train_years)
    is_test = y == test_year
    m = year_month("Date")
    return df.agg(
        F.lit(test_year).alias("test_year"),
        F.lit(train_years[0]).alias("train_year"),
        F.min(F.when(is_train, F.col("Date"))).alias("train_start"),
        F.max(F.when(is_train, F.col("Date"))).alias("train_end"),
        F.min(F.when(is_test, F.col("Date"))).alias("test_start"),
        F.max(F.when(is_test, F.col("Date"))).alias("test_end"),
        F.count_if(is_train).alias("train_rows"),
        F.count_if(is_test).alias("test_rows"),
        F.count_distinct(F.when(is_train, m)).alias("train_months"),
        F.count_distinct(F.when(is_test, m)).alias("test_months"),
    )


def month_cutoff_split(df: DataFrame, train_months: int = 12) -> DataFrame:
    """Label rows train/test by cutoff = min(Date) + n months (P5).

    The cutoff is a one-row aggregate attached as a literal.
    """
    from tidewell.functions.scalars import row_literals
    cutoff = row_literals(df.agg(F.add_months(F.min("Date"), train_months).alias("cutoff_date")))
    return (df.withColumns(cutoff)
            .withColumn("split", F.when(F.col("Date") < F.col("cutoff_date"), "train").otherwise("test")))


def month_rows_at_least(df: DataFrame, n: int = 2) -> DataFrame:
    """Keep months with at least n rows (P7): a per-month count joined back."""
    months = (df.groupBy(year_month("Date").alias("_m")).count()
              .where(F.col("count") >= n).select("_m"))
    return df.join(months, year_month("Date") == F.col("_m"), "left_semi")


def validation_halves(df: DataFrame, month_col: str = "month") -> DataFrame:
    """Positional first/second half inside each month, order Store, Product, Date.

    Position is computed without putting a month into one task: per-series counts
    give each series its offset in two levels, products inside a (month, store) and
    stores inside a month; inside a series-month the rank is over at most five
    weekly rows. Null keys keep their rows (null-safe joins); ``Store`` is optional.
    """
    outer = [month_col] + [k for k in ("Store",) if k in df.columns]
    keys = outer + ["Product"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    inner = Window.partitionBy(*outer).orderBy("Product").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_inside", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
    stores = counts.groupBy(*outer).agg(F.sum("_n").alias("_s"))
    wm = Window.partitionBy(month_col)
    stores = stores.select(
        *[F.col(k).alias(f"_o_{k}") for k in outer],
        F.coalesce(F.sum("_s").over(wm.orderBy(*outer[1:] or [month_col]).rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_store_before"),
        F.sum("_s").over(wm).alias("_month_rows"))

    def matches(cols, prefix):
        cond = F.lit(True)
        for k in cols:
            cond = cond & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
        return cond
    offsets = counts.join(stores, matches(outer, "_o_")).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], (F.col("_store_before") + F.col("_inside")).alias("_before"), "_month_rows")
    ws = Window.partitionBy(*keys).orderBy("Date")
    return (df.join(offsets, matches(keys, "_k_"))
            .withColumn("position", F.col("_before") + F.row_number().over(ws))
            .withColumn("half", F.when(F.col("position") <= F.floor(F.col("_month_rows") / 2), "first")
                        .otherwise("second"))
            .drop("_before", *[f"_k_{k}" for k in keys]))


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """Deterministic fixed-size sample (P15): the n rows with the smallest seeded hash of
    their keys (a top-k, planned as per-partition take-ordered then merge)."""
    return df.orderBy(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), *keys).limit(n)


def require_rows(df: DataFrame, minimum: int = 20) -> None:
    """Minimum training size (P8); counts at most ``minimum`` rows."""
    if df.limit(minimum).count() < minimum:
        raise ValueError(f"Training set too small (< {minimum} rows).")

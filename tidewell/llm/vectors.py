"""Shared reading of vector tables for whitening, hard negatives and nearest neighbours.

A vector takes part where it is not null, holds neither null nor non-finite entries and has
the table's commonest length (ties: the shorter), since vectors of different lengths have no
inner product. Columns other than the named ones are never read, so they may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType


def usable(df: DataFrame, vector_column: str, **columns: Column) -> DataFrame:
    """``columns`` (name = expression) and ``vec`` (array of float or double) of the rows
    whose vector takes part."""
    vec = F.col(f"`{vector_column}`")
    if not isinstance(df.schema[vector_column].dataType.elementType, FloatType):
        vec = vec.cast("array<double>")
    out = df.select(*[c.alias(k) for k, c in columns.items()], vec.alias("vec"))
    broken = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = out.where(F.col("vec").isNotNull() & ~F.coalesce(broken, F.lit(True)))
    common = (out.groupBy(F.size("vec").alias("n")).count()
              .orderBy(F.desc("count"), "n").limit(1).collect())
    return out.where(F.size("vec") == (common[0]["n"] if common else 0))


def quantised(scale: int = 256) -> Column:
    """``vec`` as long floor(scale * x), beyond long's range its nearest end."""
    return F.transform("vec", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int, dtype=np.float64) -> np.ndarray:
    """List column of equal lengths as a 2-D array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim).astype(dtype, copy=False)


def blocks(df: DataFrame, rows: int) -> int:
    """Number of blocks of about ``rows`` rows."""
    return max(1, -(-df.count() // rows))


def block_of(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

"""One-row aggregates used as literals.

A scalar that every row needs (a cut-off date, a baseline mean, the latest
row's values) is computed by one aggregate job and attached as a literal: one
row reaches the driver, no join is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_literals(one_row: DataFrame) -> dict[str, Column]:
    """Columns of a one-row aggregate as typed literals."""
    r = one_row.first()
    types = dict(one_row.dtypes)
    return {c: F.lit(r[c]).cast(types[c]) if r is not None else F.lit(None).cast(types[c])
            for c in one_row.columns}


def zero_for_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of ``columns`` as 0 in the column's own type (text: "0")."""
    types = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(types[c])) for c in columns
                           if types[c] == "string" or types[c] in ("tinyint", "smallint", "int", "bigint", "float", "double")
                           or types[c].startswith("decimal")})

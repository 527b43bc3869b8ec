"""Series keys: ``Product``, and ``Store`` where the data has one."""

from __future__ import annotations

from pyspark.sql import DataFrame


def series_keys(df: DataFrame) -> list[str]:
    keys = [k for k in ("Store", "Product") if k in df.columns]
    if not keys:
        raise ValueError("a demand table needs at least one of Store, Product")
    return keys

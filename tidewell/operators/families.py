"""Feature families (P17, A36, O2, O7): one rule table, read as a Spark column and as SQL.

Calendar names come from the library's own calendar features, prefixes from how the series,
group and interaction features are named.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.calendar import calendar_names

# Interactions that carry a name of their own.
NAMED_INTERACTIONS = ("Temp_Fuel", "Price_Index", "Fuel_Unemployment", "CPI_Fuel", "Temp_Holiday",
                      "Store_Holiday", "Holiday_Q4", "Unemployment_CPI", "Store_Product", "Product_Holiday")
OTHER = "Raw Inputs"


@dataclass(frozen=True)
class Family:
    """A feature belongs here by one of its prefixes, by a part of its name, or by name."""
    label: str
    prefixes: tuple[str, ...] = ()
    part: str | None = None
    names: tuple[str, ...] = ()


FAMILIES = (
    Family("Interaction", part="_x_", names=NAMED_INTERACTIONS),
    Family("Lag", ("Lag_",)),
    Family("Rolling", ("Rolling_", "Momentum_", "Volatility_")),
    Family("Temporal", ("Weeks_To_",), names=tuple(calendar_names())),
    Family("Product Stats", ("Store_", "Product_", "Demand_vs_")),
)


def feature_family(col) -> F.Column:
    """Family label of a feature name: the first family that takes it, else raw input."""
    c = F.col(col) if isinstance(col, str) else col
    label = F.lit(OTHER)
    for fam in reversed(FAMILIES):
        tests = [c.startswith(p) for p in fam.prefixes] + ([c.contains(fam.part)] if fam.part else [])
        tests += [c.isin(*fam.names)] if fam.names else []
        hit = tests[0]
        for t in tests[1:]:
            hit = hit | t
        label = F.when(hit, fam.label).otherwise(label)
    return label


def feature_family_sql(col: str) -> str:
    """The same rules as a SQL expression."""
    cases = []
    for fam in FAMILIES:
        tests = [f"starts_with({col}, '{p}')" for p in fam.prefixes]
        tests += [f"contains({col}, '{fam.part}')"] if fam.part else []
        tests += [f"{col} IN ({', '.join(repr(n) for n in fam.names)})"] if fam.names else []
        cases.append(f"WHEN {' OR '.join(tests)} THEN '{fam.label}'")
    return f"CASE {' '.join(cases)} ELSE '{OTHER}' END"


def feature_families(importance: DataFrame) -> DataFrame:
    """Family totals and share (A36), rank overall (O2) and within the family (O7). The
    windows run over the importance table, a row per feature."""
    fam = importance.withColumn("family", feature_family("feature"))
    total = F.sum("importance").over(Window.partitionBy())
    fam_total = F.sum("importance").over(Window.partitionBy("family"))
    return fam.select("feature", "family", "importance",
                      F.round(fam_total / F.greatest(total, F.lit(1e-300)), 4).alias("family_share"),
                      F.row_number().over(Window.orderBy(F.desc("importance"), "feature")).alias("rank"),
                      F.row_number().over(Window.partitionBy("family").orderBy(F.desc("importance"), "feature"))
                      .alias("rank_in_family"))

"""Date helpers as Column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def week_end(date, rule: str = "closed") -> Column:
    """Friday that closes the week of ``date``.

    closed: the Friday on or after the date (weeks run Saturday..Friday).
    strict: the Friday strictly after the date (a Friday moves to the next one).
    """
    d = _c(date)
    if rule == "closed":
        return F.next_day(F.date_sub(d, 1), "FRI")
    if rule == "strict":
        return F.next_day(d, "FRI")
    raise ValueError(f"unknown week rule {rule!r}")


def weekday_mon0(date) -> Column:
    """Day of week with Monday = 0."""
    return F.weekday(_c(date))


def year_month(date) -> Column:
    """Month period as ``yyyy-MM``."""
    return F.date_format(_c(date), "yyyy-MM")


def shift_month(ym, months: int) -> Column:
    """Add months to a ``yyyy-MM`` string."""
    first = F.to_date(F.concat(_c(ym), F.lit("-01")))
    return F.date_format(F.add_months(first, months), "yyyy-MM")


def month_fridays(ym) -> Column:
    """Array of the Fridays of a ``yyyy-MM`` month (F8).

    Every month has at least four Fridays, so the reference's fallback
    (days 1, 8, 15, 22 of a month without Fridays) never applies.
    """
    first = F.to_date(F.concat(_c(ym), F.lit("-01")))
    return F.sequence(F.next_day(F.date_sub(first, 1), "FRI"), F.last_day(first),
                      F.expr("INTERVAL 7 DAYS"))


def calendar_columns(date) -> dict[str, Column]:
    """Calendar features F1-F5, in the reference's order."""
    d = _c(date)
    month = F.month(d)
    quarter = F.quarter(d)
    week = F.weekofyear(d)
    two_pi = 2 * math.pi
    cols = {
        "Month": month,
        "Quarter": quarter,
        "Year": F.year(d),
        "DayOfYear": F.dayofyear(d),
        "WeekOfYear": week,
    }
    for q in range(1, 5):
        cols[f"Is_Q{q}"] = (quarter == q).cast("int")
    cols.update({
        "Month_Sin": F.sin(two_pi * month / 12),
        "Month_Cos": F.cos(two_pi * month / 12),
        "Quarter_Sin": F.sin(two_pi * quarter / 4),
        "Quarter_Cos": F.cos(two_pi * quarter / 4),
        "Week_Sin": F.sin(two_pi * week / 52),
        "Week_Cos": F.cos(two_pi * week / 52),
        # Holiday months 11, 12; summer 6, 7, 8; winter 12, 1, 2.
        "Near_Holiday": month.isin(11, 12).cast("int"),
        "Is_Summer": month.isin(6, 7, 8).cast("int"),
        "Is_Winter": month.isin(12, 1, 2).cast("int"),
    })
    return cols


def calendar_names() -> list[str]:
    """Names of the calendar features."""
    return ["Month", "Quarter", "Year", "DayOfYear", "WeekOfYear", *[f"Is_Q{q}" for q in range(1, 5)],
            *[f"{unit}_{wave}" for unit in ("Month", "Quarter", "Week") for wave in ("Sin", "Cos")],
            "Near_Holiday", "Is_Summer", "Is_Winter"]

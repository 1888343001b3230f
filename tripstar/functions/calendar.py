"""Calendar parts of a ride timestamp, all JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English day names in Monday-first order (the dashboard's axis order)
# and English month names. Names come from these lists, not from date_format, so
# they do not depend on the JVM locale and cost an array lookup per row.
DAY_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August", "September",
               "October", "November", "December"]


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hour(ts) -> Column:
    return F.hour(col_(ts))


def dow_sunday0(ts) -> Column:
    """Day of week with 0 = Sunday … 6 = Saturday (the SQL ``DOW`` convention)."""
    return F.dayofweek(col_(ts)) - 1


def dow_monday0(ts) -> Column:
    """Day of week with 0 = Monday … 6 = Sunday."""
    return F.weekday(col_(ts))


def day_of_week(ts, week_start: str = "sunday") -> Column:
    if week_start == "sunday":
        return dow_sunday0(ts)
    if week_start == "monday":
        return dow_monday0(ts)
    raise ValueError(f"week_start must be 'sunday' or 'monday', got {week_start!r}")


def day_name(ts) -> Column:
    names = F.array(*[F.lit(d) for d in DAY_ORDER])
    return F.element_at(names, F.weekday(col_(ts)) + 1)


def month_name(ts) -> Column:
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    return F.element_at(names, F.month(col_(ts)))


def month(ts) -> Column:
    return F.month(col_(ts))


def year(ts) -> Column:
    return F.year(col_(ts))


def date_only(ts) -> Column:
    return F.to_date(col_(ts))

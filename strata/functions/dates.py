"""Date/time expressions with pandas/DuckDB semantics made explicit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday labels in Monday-first order (index 0 = Monday).
DAY_LABELS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def coerce_date(x, fmt: str | None = None) -> Column:
    """``to_datetime(errors='coerce')`` for dates: NULL on bad input.

    Plain casts raise under ANSI mode (the Spark 4 default)."""
    c = _c(x)
    return F.try_to_date(c.cast("string"), F.lit(fmt)) if fmt else F.try_to_date(c.cast("string"))


def coerce_timestamp(x, fmt: str | None = None) -> Column:
    c = _c(x).cast("string")
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)


def day_name(x) -> Column:
    """Full weekday name (``Monday``), like SQL ``DAYNAME``."""
    return F.date_format(_c(x), "EEEE")


def sql_day_number(x) -> Column:
    """SQL ``DAYOFWEEK``: 0 = Sunday ... 6 = Saturday."""
    return F.dayofweek(_c(x)) - 1


def weekday_mon0(x) -> Column:
    """pandas ``dt.dayofweek``: 0 = Monday ... 6 = Sunday."""
    return F.weekday(_c(x))


def day_label(x) -> Column:
    """Short label from a Monday-first day index."""
    return F.element_at(F.array(*[F.lit(d) for d in DAY_LABELS]), _c(x) + 1)


def stamped(df, name: str = "generated_at"):
    """``df`` with the query's own time as ISO text in UTC, the same on every row."""
    return df.withColumn(name, F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))

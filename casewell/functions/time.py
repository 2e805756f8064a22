"""Time helpers. The clock is always an argument (`as_of`), never read inside."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_timestamp(value: Column | str | datetime) -> Column:
    """Clock argument → timestamp column; text is taken as a literal, not a column name."""
    if isinstance(value, Column):
        return value.cast("timestamp")
    return F.lit(value).cast("timestamp")


def hours_between(later: Column, earlier: Column) -> Column:
    """Fractional hours from `earlier` to `later`."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(3.6e9)


def add_hours(ts: Column | str, hours: Column | str) -> Column:
    return _col(ts).cast("timestamp") + F.make_dt_interval(F.lit(0), _col(hours).cast("int"))


def parse_created(text: Column | str) -> Column:
    """`yyyy-MM-dd` or full ISO text; unreadable text → null instead of a failed job."""
    return F.try_to_timestamp(_col(text))


def format_minute(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd HH:mm")


def month_of(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM")


def remaining_label(hours: Column | str) -> Column:
    """Below one hour in minutes, else in hours, half-up as the dashboard shows it."""
    hours = _col(hours)
    whole = lambda x: F.floor(x + F.lit(0.5)).cast("bigint").cast("string")
    return F.when(hours < 1, F.concat(whole(hours * 60), F.lit("m left"))).otherwise(
        F.concat(whole(hours), F.lit("h left"))
    )

"""Date arithmetic on DATE and TIMESTAMP_NTZ columns.

Unit differences count boundaries crossed (b - a), not whole elapsed units. Nothing here reads
the wall clock: every pipeline takes its as-of date as a parameter.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed sentinel dates of the data model: "never happened" and "still open".
NEVER = dt.date(9999, 9, 9)
OPEN_END = dt.date(9999, 12, 31)


def as_date(value) -> Column:
    """A DATE column from a column, a Python date or ISO text."""
    if isinstance(value, Column):
        return value.cast("date")
    if isinstance(value, str):
        value = parse_iso(value)
    return F.lit(value)


def parse_iso(text: str) -> dt.date:
    """Python date from text; unpadded parts are accepted."""
    year, month, day = (int(part) for part in text.split("-"))
    return dt.date(year, month, day)


def days_between(start: Column, end: Column) -> Column:
    """Calendar-day boundaries from start to end; negative when end is earlier."""
    return F.datediff(end.cast("date"), start.cast("date"))


def weeks_between(start: Column, end: Column) -> Column:
    """Monday boundaries from start to end."""
    return (F.datediff(week_start(end), week_start(start)) / 7).cast("int")


def months_between(start: Column, end: Column) -> Column:
    """Month boundaries from start to end."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def minutes_between(start: Column, end: Column) -> Column:
    """Minute boundaries from start to end, free of the session time zone."""

    def minute_of_day(at: Column) -> Column:
        return F.hour(at) * 60 + F.minute(at)

    days = F.datediff(end.cast("date"), start.cast("date")).cast("long")
    return days * 1440 + minute_of_day(end) - minute_of_day(start)


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def week_start(day: Column) -> Column:
    return F.trunc(day, "WEEK")


def add_months(day: Column, months) -> Column:
    return F.add_months(day, months)


def never_to_null(day: Column, sentinel: dt.date = NEVER) -> Column:
    return F.nullif(day, F.lit(sentinel))


def null_to_never(day: Column, sentinel: dt.date = NEVER) -> Column:
    return F.coalesce(day, F.lit(sentinel))


def trailing(day: Column, as_of, days: int, shift: int = 0, closed: bool = True) -> Column:
    """day in [as_of - days - shift, as_of - shift]; closed=False drops the lower bound day
    and leaves the upper end open, the form "later than as_of minus days"."""
    end = as_date(as_of)
    low = F.date_sub(end, days + shift)
    if not closed:
        return day > low
    return day.between(low, F.date_sub(end, shift))

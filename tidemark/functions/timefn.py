"""Date and time columns. Every operator takes an explicit as-of value, never the clock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clock_seconds(c) -> Column:
    """Whole seconds since midnight."""
    c = _col(c)
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def epoch(c) -> Column:
    """Whole seconds since 1970 on the column's own clock, whatever the session's time zone."""
    c = _col(c)
    days = F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + clock_seconds(c)


def micros(c) -> Column:
    """Microseconds since 1970 on the column's own clock."""
    c = _col(c)
    part = (F.date_part(F.lit("SECONDS"), c) * 1_000_000).cast("long")
    return (epoch(c) - F.second(c)) * 1_000_000 + part


def moment(value: str | datetime) -> Column:
    """A zone-free timestamp literal."""
    return F.to_timestamp_ntz(F.lit(str(value)))


def boundary_diff(unit: str, start, end) -> Column:
    """Number of unit boundaries between two timestamps: 09:00:59 to 09:01:01 is one minute."""
    start, end = _col(start), _col(end)
    if unit == "month":
        return (month_index(end) - month_index(start)).cast("long")
    if unit == "day":
        return F.datediff(end, start).cast("long")
    size = {"second": 1, "minute": 60, "hour": 3600}[unit]
    return F.floor(epoch(end) / size) - F.floor(epoch(start) / size)


def month_index(c) -> Column:
    c = _col(c)
    return F.year(c) * 12 + F.month(c)


def month_start(c) -> Column:
    return F.trunc(_col(c), "MM")


def local_ts(c, minutes: int = 330) -> Column:
    """Shift a UTC timestamp to local time."""
    return F.timestamp_add("MINUTE", F.lit(minutes), _col(c))


def time_of_day(c) -> Column:
    return F.date_format(_col(c), "HH:mm:ss")


def seconds_of_day(text: str) -> int:
    hours, minutes, seconds = (int(p) for p in text.split(":"))
    return hours * 3600 + minutes * 60 + seconds


def at_time(day, text: str) -> Column:
    """The timestamp at a clock time of a date."""
    midnight = F.to_date(_col(day)).cast("timestamp_ntz")
    return F.timestamp_add("SECOND", F.lit(seconds_of_day(text)), midnight)


def office_seconds(start, end, opens: str = "08:30:00", closes: str = "23:00:00",
                   clamp: bool = False) -> Column:
    """Seconds between two timestamps counted in office hours.

    Whole days in between count as the open span. Without `clamp` the last day
    runs from opening to `end` as it stands, so an end before opening subtracts
    and an end after closing counts in full.
    """
    start, end = _col(start), _col(end)
    o, c = seconds_of_day(opens), seconds_of_day(closes)
    s, e = clock_seconds(start), clock_seconds(end)
    if clamp:
        e = F.greatest(F.lit(o), F.least(F.lit(c), e))
    days = F.datediff(end, start)
    tail = (days - 1) * (c - o) + e - o
    first_day = F.when(s <= o, F.lit(c - o)).when(s < c, F.lit(c) - s).otherwise(F.lit(0))
    same_day = F.when(s < o, e - o).otherwise(
        F.greatest(e - s, F.lit(0)) if clamp else epoch(end) - epoch(start))
    return F.when(days == 0, same_day).otherwise(first_day + tail).cast("long")


def office_minutes(start, end, **hours) -> Column:
    return office_seconds(start, end, **hours) / F.lit(60)


def months_back(as_of, months: int) -> Column:
    """First day of the month `months` before the as-of date."""
    return F.add_months(F.trunc(_col(as_of), "MM"), -months)


def month_to_date(c, as_of) -> Column:
    day = F.to_date(_col(c))
    return day.between(F.trunc(_col(as_of), "MM"), F.to_date(_col(as_of)))

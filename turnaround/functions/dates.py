"""Timestamps without zone: parsing, parts and spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month-first forms, on a 12-hour and on a 24-hour clock.
_MONTH_FIRST = ("M/d/yyyy[ h:mm[:ss[.SSSSSS]] a] xxx", "M/d/yyyy[ H:mm[:ss[.SSSSSS]]] xxx")


def parse_timestamp(text: Column) -> Column:
    """Read `01/15/2026 11:22:33 PM`, `2026-01-05 10:00:00`, ISO `T` form or a bare date.

    Month-first texts are read as if in UTC and put on a zone-free clock by their distance from the
    epoch, so neither the session zone nor its clock changes can shift them. A text that is no valid
    moment becomes null.
    """
    in_utc = F.concat(F.trim(text), F.lit(" +00:00"))
    instant = F.coalesce(*[F.try_to_timestamp(in_utc, F.lit(form)) for form in _MONTH_FIRST])
    month_first = moment("1970-01-01 00:00:00") + F.expr("INTERVAL '0.000001' SECOND") * F.unix_micros(instant)
    return F.when(text.contains("/"), month_first).otherwise(F.trim(text).try_cast("timestamp_ntz"))


def hours_between(start: Column, end: Column) -> Column:
    """Hours as a fraction, from the exact span in microseconds between two zone-free clocks."""
    seconds = (end - start).cast("interval second").cast("decimal(18,6)")
    return seconds.cast("double") / 3600


def monday_day(ts: Column) -> Column:
    """Day of week, 0 = Monday."""
    return F.weekday(ts)


def sunday_day(ts: Column) -> Column:
    """Day of week, 0 = Sunday."""
    return F.dayofweek(ts) - 1


def is_weekend(monday_based: Column) -> Column:
    return monday_based >= 5


def is_night(hour: Column) -> Column:
    return (hour >= 22) | (hour < 6)


def day_text(ts: Column) -> Column:
    return F.to_date(ts).cast("string")


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")

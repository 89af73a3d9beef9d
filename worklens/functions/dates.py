"""Date functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _weekdays_until(day: Column) -> Column:
    """Weekdays from Monday 1970-01-05 up to and with ``day``, in closed form."""
    n = F.datediff(day, F.lit("1970-01-05").cast("date")) + 1
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def business_days(start: Column, end: Column) -> Column:
    """Weekdays from ``start`` to ``end``, both included, at least 1; 0 if the end is not after the start; null for a null."""
    a, b = F.to_date(start), F.to_date(end)
    n = _weekdays_until(b) - _weekdays_until(F.date_sub(a, 1))
    return F.when(start.isNull() | end.isNull(), None).when(end <= start, 0).otherwise(F.greatest(n, F.lit(1))).cast("int")


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3_600_000_000.0)


def days_left(end: Column, now: Column) -> Column:
    """Whole days until ``end``, begun ones counted, 0 if it is past; null for a null."""
    days = F.ceil((F.unix_micros(end) - F.unix_micros(now)) / F.lit(86_400_000_000.0))
    return F.when(end.isNotNull(), F.greatest(days, F.lit(0))).cast("bigint")


def elapsed_percent(start: Column, end: Column, now: Column) -> Column:
    """The share of the time from ``start`` to ``end`` that is over, from 0 to 100; null for a null or an empty time."""
    whole = F.unix_micros(end) - F.unix_micros(start)
    part = F.floor(F.lit(100.0) * F.try_divide(F.unix_micros(now) - F.unix_micros(start), whole) + 0.5)
    return F.when(whole != 0, F.greatest(F.lit(0), F.least(F.lit(100), part))).cast("int")

"""Date keys, weekdays and horizon segments as column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DateLike = str | dt.date


def as_date(value: DateLike) -> dt.date:
    """A Python date from a date or an ISO string."""
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def end_of(start: DateLike, days: int) -> dt.date:
    """First day after a horizon of ``days`` days."""
    return as_date(start) + dt.timedelta(days=days)


def date_key(col: Column | str) -> Column:
    """Date to integer ``YYYYMMDD``."""
    d = F.col(col) if isinstance(col, str) else col
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def from_date_key(col: Column | str) -> Column:
    """Integer ``YYYYMMDD`` to date; null for a key that is no date, such as 0 or 20200232."""
    k = (F.col(col) if isinstance(col, str) else col).cast("int")
    return F.try_to_date(F.lpad(k.cast("string"), 8, "0"), "yyyyMMdd")


def shift_date_key(col: Column | str, days: Column | int) -> Column:
    """Integer ``YYYYMMDD`` moved by ``days`` (negative moves back)."""
    return date_key(F.date_add(from_date_key(col), days))


def month_start(month_key: Column | str) -> Column:
    """Integer ``YYYYMM`` to the first day of that month."""
    k = (F.col(month_key) if isinstance(month_key, str) else month_key).cast("int")
    return F.make_date(F.floor(k / 100).cast("int"), k % 100, F.lit(1))


def weekday_of(col: Column | str) -> Column:
    """Day of the week, Monday = 0."""
    return F.weekday(col)


def segment_of(date: Column | str, start: DateLike, days: int, parts: int) -> Column:
    """Segment number of a day when ``days`` days from ``start`` are cut into ``parts`` runs.

    Runs are contiguous and differ by at most one day, the longer ones first. Days outside the
    horizon get null. Pure arithmetic on the day offset: no window, no shuffle.
    """
    short, longer = divmod(days, parts)
    offset = F.datediff(F.col(date) if isinstance(date, str) else date, F.lit(as_date(start)))
    cut = longer * (short + 1)
    seg = F.when(offset < cut, F.floor(offset / (short + 1)))
    if short:
        seg = seg.otherwise(longer + F.floor((offset - cut) / short))
    return F.when((offset >= 0) & (offset < days), seg).cast("int")


def segment_starts(start: DateLike, days: int, parts: int) -> list[tuple[dt.date, dt.date]]:
    """(first day, last day) of every segment, in order."""
    short, longer = divmod(days, parts)
    out, day = [], as_date(start)
    for part in range(parts):
        size = short + (part < longer)
        if size:
            out.append((day, day + dt.timedelta(days=size - 1)))
            day += dt.timedelta(days=size)
    return out


def daily_values(date: Column | str, value: Column | str, first: DateLike, n: int) -> Column:
    """Aggregate: the values of a group on ``n`` days from ``first`` as an array of longs, 0 on missing days.

    Days are sorted, not looked up one by one, which would take n steps for each. A day must not come twice or lie outside.
    """
    zero = F.lit(0).cast("long")
    day = F.datediff(F.col(date) if isinstance(date, str) else date, F.lit(as_date(first))).alias("day")
    there = F.collect_list(F.struct(day, F.coalesce((F.col(value) if isinstance(value, str) else value).cast("long"), zero).alias("value")))
    missing = F.array_except(F.sequence(F.lit(0), F.lit(n - 1)), there["day"])
    full = F.array_sort(F.concat(there, F.transform(missing, lambda d: F.struct(d.alias("day"), zero.alias("value")))))
    twice = F.raise_error(F.lit("a day comes twice or lies outside")).cast("array<bigint>")
    return F.when(F.size(full) == n, full["value"]).otherwise(twice)

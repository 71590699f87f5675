"""Day tables, month expansion and horizon segments."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.functions.calendar import DateLike, as_date, month_start, segment_of


def date_spine(
    spark: SparkSession, start: DateLike, end: DateLike, inclusive: bool = True, name: str = "date"
) -> DataFrame:
    """One row per day from ``start`` to ``end``."""
    last = as_date(end) if inclusive else as_date(end) - dt.timedelta(days=1)
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(as_date(start)), F.lit(last))).alias(name)
    )


def observed_span(df: DataFrame, *date_cols: str, name: str = "date") -> DataFrame:
    """One row per day between the first and the last date found in ``date_cols``."""
    bounds = df.agg(
        F.least(*(F.min(c) for c in date_cols), F.min(date_cols[0])).alias("lo"),
        F.greatest(*(F.max(c) for c in date_cols), F.max(date_cols[0])).alias("hi"),
    )
    return bounds.where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias(name))


def expand_monthly_to_daily(
    df: DataFrame,
    start: DateLike,
    end: DateLike,
    month_col: str = "month_key",
    name: str = "date",
) -> DataFrame:
    """Repeat each monthly row for every day of its month between ``start`` and ``end`` (both in).

    Each row carries its own month, so its days are generated in place; no join, no shuffle. Months
    outside the range are dropped before that.
    """
    first = month_start(month_col)
    lo = F.greatest(first, F.lit(as_date(start)))
    hi = F.least(F.last_day(first), F.lit(as_date(end)))
    lo_key, hi_key = (d.year * 100 + d.month for d in (as_date(start), as_date(end)))
    return (
        df.where(F.col(month_col).between(lo_key, hi_key))
        .withColumn(name, F.explode(F.sequence(lo, hi)))
        .drop(month_col)
    )


def split_horizon(
    days: DataFrame, start: DateLike, n_days: int, parts: int, date_col: str = "date"
) -> DataFrame:
    """Add the segment number of each day of the horizon; other days are dropped."""
    return days.withColumn("segment", segment_of(date_col, start, n_days, parts)).where(
        F.col("segment").isNotNull()
    )


def slice_by_segment(
    table: DataFrame, start: DateLike, n_days: int, parts: int, date_col: str = "date"
) -> DataFrame:
    """Cut a dated parameter table into the segments of the horizon.

    The segment is a column, so all segments stay one table that can be filtered or partitioned by
    it. Tables without a date are shared by all segments and need no cut.
    """
    return split_horizon(table, start, n_days, parts, date_col)


def in_horizon(date: Column | str, start: DateLike, end: DateLike) -> Column:
    """start <= date < end."""
    d = F.col(date) if isinstance(date, str) else date
    return (d >= F.lit(as_date(start))) & (d < F.lit(as_date(end)))

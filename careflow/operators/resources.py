"""Beds, staff and infection exposure per facility and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow import fixed_values as fv
from careflow.functions.calendar import DateLike
from careflow.operators.calendar import expand_monthly_to_daily


def daily_beds(beds: DataFrame, start: DateLike, end: DateLike, qty_col: str = "qty") -> DataFrame:
    """(facility_id, patient_type, date, beds): monthly bed counts on every planning day, end included.

    ``beds`` comes from ``classify_beds``; rows without a group are dropped and so are days without beds.
    Monthly totals are unique per facility and group, so stretching them needs no further distinct.
    """
    monthly = (
        beds.dropna(subset=["facility_id", "bed_group", "month_key"])
        .groupBy("facility_id", F.col("bed_group").alias("patient_type"), "month_key")
        .agg(F.sum(qty_col).cast("long").alias("beds"))
        .where("beds > 0")
    )
    return expand_monthly_to_daily(monthly, start, end).select(
        "facility_id", "patient_type", "date", "beds"
    )


def daily_staff(
    staff: DataFrame,
    start: DateLike,
    end: DateLike,
    overflow: int = fv.OVERFLOW_FACILITY,
    overflow_size: int = fv.OVERFLOW_STAFF,
) -> DataFrame:
    """(facility_id, occupation, hours, headcount, date) with the overflow facility on every staffed day.

    ``staff`` comes from ``classify_staff``.
    """
    real = expand_monthly_to_daily(staff, start, end).select(
        "facility_id", "occupation", "hours", "headcount", "date"
    )
    # A month with any staff row covers all its planning days, so the staffed days follow from the
    # months (a calendar-sized table) and not from the expanded rows.
    months = staff.select("month_key").where("month_key is not null").distinct()
    ghost = expand_monthly_to_daily(months, start, end).select(
        F.lit(overflow).cast(real.schema["facility_id"].dataType).alias("facility_id"),
        F.lit(fv.OVERFLOW_OCCUPATION).alias("occupation"),
        F.lit(overflow_size).cast("long").alias("hours"),
        F.lit(overflow_size).cast("long").alias("headcount"),
        "date",
    )
    return real.unionByName(ghost)


def staff_headcount(staff_days: DataFrame) -> DataFrame:
    """(facility_id, date, headcount) over all occupations."""
    return staff_days.groupBy("facility_id", "date").agg(F.sum("headcount").alias("headcount"))


def staff_hours(staff_days: DataFrame, divisor: int = fv.HOURS_DIVISOR) -> DataFrame:
    """(facility_id, date, hours): hours x head count over ``divisor``, rounded up.

    The hours of one person were already divided once in ``classify_staff``; both divisions are part of
    the model. 64-bit sums: the overflow facility alone is near 10^12.
    """
    total = F.sum(F.col("hours") * F.col("headcount"))
    return staff_days.groupBy("facility_id", "date").agg(
        F.ceil(total / divisor).cast("long").alias("hours")
    )


def overflow_census(
    covid: DataFrame,
    overflow: int = fv.OVERFLOW_FACILITY,
    census: int = fv.OVERFLOW_CENSUS,
) -> DataFrame:
    """Add the overflow facility with a prohibitive covid census on every observed date.

    ``covid`` is (date, facility_id, census).
    """
    ghost = covid.select("date").distinct().select(
        "date",
        F.lit(overflow).cast(covid.schema["facility_id"].dataType).alias("facility_id"),
        F.lit(census).cast("long").alias("census"),
    )
    return covid.select("date", "facility_id", "census").unionByName(ghost)


def infection_exposure(covid: DataFrame, headcount: DataFrame) -> DataFrame:
    """(date, facility_id, exposure): head count x covid census, positive ones only.

    Head counts are spread from months like daily beds, so without the hint they could be broadcast through the driver.
    """
    return (
        covid.where("census > 0")
        .join(headcount.hint("merge"), ["date", "facility_id"])
        .select("date", "facility_id", (F.col("headcount") * F.col("census")).alias("exposure"))
        .where("exposure > 0")
    )


def infected_census(covid: DataFrame) -> DataFrame:
    """(date, facility_id, census) with a positive covid census."""
    return covid.where("census > 0").select("date", "facility_id", "census")


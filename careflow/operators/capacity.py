"""Bed capacity: repair, borrowing between groups, and raises.

All windows here run inside one facility (or facility and type) over the days of the planning window, so
their size is bounded by the horizon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from careflow import fixed_values as fv
from careflow.functions.calendar import DateLike, as_date
from careflow.operators.calendar import date_spine

MEASURES = ("admits", "discharges", "net", "census", "releases", "beds")
HELD = ("census", "beds")


def attach_beds(ledger: DataFrame, beds: DataFrame, peak: DataFrame) -> DataFrame:
    """Add ``beds`` to the coarse ledger; a missing bed row is replaced by the peak census if there is one.

    ``beds`` holds positive rows only, so rows left without a value are those to drop.

    Daily beds are spread from months in place, which Spark's size estimate does not see; without the hint it would
    broadcast them through the driver, however many facilities there are. Peaks come first, since a ledger lies by series
    already, and are merged for the same reason.
    """
    return (
        ledger.join(peak.hint("merge"), ["patient_type", "facility_id"], "left")
        .join(beds.hint("merge"), ["patient_type", "facility_id", "date"], "left")
        .withColumn("beds", F.coalesce("beds", "peak"))
        .where("beds is not null")
        .select("date", "facility_id", "patient_type", *MEASURES)
    )


def add_overflow_beds(
    df: DataFrame, overflow: int = fv.OVERFLOW_FACILITY, beds: int = fv.OVERFLOW_BEDS
) -> DataFrame:
    """Add the overflow facility for every (observed date, observed type).

    Types travel as one small array, dates are at most calendar-sized.
    """
    kind = df.schema
    types = df.agg(F.array_sort(F.collect_set("patient_type"))).scalar()
    ghost = df.select("date").distinct().select(
        "date",
        F.lit(overflow).cast(kind["facility_id"].dataType).alias("facility_id"),
        F.explode(types).alias("patient_type"),
        *(
            F.lit(beds if m == "beds" else 0).cast(kind[m].dataType).alias(m)
            for m in MEASURES
        ),
    )
    return df.select("date", "facility_id", "patient_type", *MEASURES).unionByName(ghost)


def floor_beds_to_load(df: DataFrame, overflow: int = fv.OVERFLOW_FACILITY) -> DataFrame:
    """Real facilities get at least census + all releases of their (facility, type)."""
    whole = W.partitionBy("facility_id", "patient_type")
    need = F.col("census") + F.sum("releases").over(whole)
    return df.withColumn(
        "beds",
        F.when(F.col("facility_id") != overflow, F.greatest(F.col("beds"), need)).otherwise(F.col("beds")),
    )


def wide(measure: str, patient_type: str) -> str:
    """Column name of a measure of one type in the wide table."""
    return f"{measure}_{patient_type}"


def pivot_types(
    df: DataFrame,
    types: tuple[str, ...] = fv.COARSE_TYPES,
    measures: tuple[str, ...] = MEASURES,
    held: tuple[str, ...] = HELD,
) -> DataFrame:
    """One row per (date, facility), one column per measure and type.

    ``held`` measures are carried forward per facility, every other gap is 0. The types are given, so one
    pass with conditional aggregates is enough.
    """
    cells = [
        F.max(F.when(F.col("patient_type") == t, F.col(m))).alias(wide(m, t)) for m in measures for t in types
    ]
    table = df.groupBy("date", "facility_id").agg(*cells)
    w = W.partitionBy("facility_id").orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    zero = F.lit(0)
    return table.select(
        "date",
        "facility_id",
        *(
            F.coalesce(
                F.last(wide(m, t), ignorenulls=True).over(w) if m in held else F.col(wide(m, t)), zero
            ).alias(wide(m, t))
            for m in measures
            for t in types
        ),
    )


def borrow_beds(table: DataFrame) -> DataFrame:
    """Add ``dynamic_beds_*`` and ``free_other_*`` per treatment.

    If the other patients of a treatment exceed their own beds, they take the missing ones from cancer,
    down to zero.
    """
    out = {}
    for treatment in (fv.CLINICAL, fv.SURGERY):
        own = F.col(wide("beds", f"OTHER_{treatment}")) - F.col(wide("census", f"OTHER_{treatment}"))
        cancer = F.col(wide("beds", f"CANCER_{treatment}"))
        out[f"free_other_{treatment}"] = own
        out[f"dynamic_beds_{treatment}"] = F.when(own < 0, F.greatest(F.lit(0), cancer + own)).otherwise(cancer)
    return table.withColumns(out)


def unpivot_types(table: DataFrame) -> DataFrame:
    """Back to long form for the cancer types: (date, facility, type, beds, releases, census)."""
    rows = [
        F.struct(
            F.lit(f"CANCER_{treatment}").alias("patient_type"),
            F.col(f"dynamic_beds_{treatment}").cast("long").alias("beds"),
            F.col(wide("releases", f"CANCER_{treatment}")).cast("long").alias("releases"),
            F.col(wide("census", f"CANCER_{treatment}")).cast("long").alias("census"),
        )
        for treatment in (fv.CLINICAL, fv.SURGERY)
    ]
    return table.select("date", "facility_id", F.inline(F.array(*rows)))


def bed_adjust_audit(table: DataFrame) -> DataFrame:
    """What the borrowing did per (date, facility)."""
    return table.select(
        "date",
        "facility_id",
        (F.col("census_CANCER_SURGERY") + F.col("census_CANCER_CLINICAL")).cast("long").alias("cancer_census"),
        (F.col("census_OTHER_SURGERY") + F.col("census_OTHER_CLINICAL")).cast("long").alias("other_census"),
        F.col("dynamic_beds_CLINICAL").cast("long").alias("dynamic_beds_clinical"),
        F.col("dynamic_beds_SURGERY").cast("long").alias("dynamic_beds_surgery"),
    )


def release_balance(long: DataFrame) -> DataFrame:
    """Add ``remaining``: census at the first date of the table minus the releases so far.

    The first date is that of the whole table; a series without a row on it starts from 0.
    """
    keys = ("facility_id", "patient_type")
    first = long.agg(F.min("date")).scalar()
    whole = W.partitionBy(*keys).orderBy("date").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    so_far = W.partitionBy(*keys).orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    initial = F.coalesce(F.max(F.when(F.col("date") == first, F.col("census"))).over(whole), F.lit(0))
    return long.withColumn("remaining", initial - F.sum("releases").over(so_far))


def floor_beds_to_initial(long: DataFrame) -> DataFrame:
    """Beds at least as many as the initial patients still there; only rows with beds are kept.

    Rows where more patients are released than were there are flagged (``over_released``) and left as they
    are.
    """
    return (
        release_balance(long)
        .withColumn("over_released", F.col("remaining") < 0)
        .withColumn("beds", F.greatest("beds", "remaining"))
        .where("beds > 0")
        .drop("remaining")
    )


def raise_capacity(
    beds: DataFrame,
    hours: DataFrame,
    initial: DataFrame,
    history: DataFrame | None,
    releases: DataFrame,
    los: DataFrame,
    start: DateLike,
    end: DateLike,
    hours_per_patient: dict[str, int] = fv.HOURS_PER_PATIENT,
    scope: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """Raise beds and staff hours to the load that is there before any new assignment.

    Load of a (type, facility, day) = initial census - patients assigned exactly one stay earlier -
    releases of that very day. Returns (beds, hours) for start <= date < end with the old value, the new
    one and the raise; nothing is changed in place. ``scope`` names extra key columns (such as the weight)
    that all dated tables then carry.

    Everything is one union of signed amounts and one aggregation per output.
    """
    spark = beds.sparkSession
    keys = [*scope, "patient_type", "facility_id", "date"]
    days = date_spine(spark, start, end, inclusive=False)
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    in_days = lambda df: df.join(F.broadcast(days), "date", "left_semi")

    def part(df: DataFrame, load, old) -> DataFrame:
        return df.select(*keys, load.alias("load"), old.alias("old"))

    day_array = F.sequence(F.lit(as_date(start)), F.date_sub(F.lit(as_date(end)), 1))
    parts = part(in_days(beds), zero, F.col("beds").cast("long"))
    parts = parts.unionByName(
        part(initial.withColumn("date", F.explode(day_array)), F.col("census").cast("long"), none)
    )
    parts = parts.unionByName(part(in_days(releases), -F.col("releases").cast("long"), none))
    if history is not None:
        left = (
            history.groupBy(*keys).agg(F.sum("qty").alias("qty"))
            .join(los, "patient_type")
            .withColumn("date", F.date_add("date", F.col("los").cast("int")))
        )
        parts = parts.unionByName(part(in_days(left), -F.col("qty").cast("long"), none))

    load = parts.groupBy(*keys).agg(
        F.sum("load").alias("load"), F.max("old").alias("old")
    )
    old = F.coalesce("old", zero)
    raised_beds = (
        load.where("old is not null or load > 0")
        .select(*keys, old.alias("before"), F.greatest(old, F.col("load")).alias("beds"))
        .withColumn("raised", F.col("beds") - F.col("before"))
    )

    need = F.col("load") * hours_needed(hours_per_patient)
    hour_keys = [*scope, "facility_id", "date"]
    raised_hours = (
        load.select(*hour_keys, need.cast("long").alias("need"), none.alias("old"))
        .unionByName(
            in_days(hours).select(*hour_keys, none.alias("need"), F.col("hours").cast("long").alias("old"))
        )
        .groupBy(*hour_keys)
        .agg(F.max("need").alias("need"), F.max("old").alias("old"))
        .where("old is not null or need > 0")
        .select(
            *hour_keys,
            F.coalesce("old", zero).alias("before"),
            F.greatest(F.coalesce("old", zero), F.coalesce("need", zero)).alias("hours"),
        )
        .withColumn("raised", F.col("hours") - F.col("before"))
    )
    return raised_beds, raised_hours


def hours_needed(hours: dict[str, int]) -> Column:
    items = list(hours.items())
    expr = F.when(F.col("patient_type") == items[0][0], F.lit(items[0][1]))
    for name, value in items[1:]:
        expr = expr.when(F.col("patient_type") == name, F.lit(value))
    return expr.otherwise(F.lit(0))


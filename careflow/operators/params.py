"""Parameter tables, index sets and what-if edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow import fixed_values as fv
from careflow.functions.calendar import DateLike, as_date, date_key

SHORT_NAMES = {"patient_type": "p", "area_id": "a", "facility_id": "h", "date": "t"}


def initial_census(long: DataFrame) -> DataFrame:
    """(patient_type, facility_id, census): positive census on the first date of the table."""
    first = long.agg(F.min("date")).scalar()
    return long.where((F.col("date") == first) & (F.col("census") > 0)).select(
        "patient_type", "facility_id", "census"
    )


def release_table(long: DataFrame) -> DataFrame:
    """(patient_type, facility_id, date, releases), positive ones."""
    return long.where("releases > 0").select("patient_type", "facility_id", "date", "releases")


def capacity_table(long: DataFrame) -> DataFrame:
    """(patient_type, facility_id, date, beds)."""
    return long.select("patient_type", "facility_id", "date", "beds")


def demand_table(demand: DataFrame) -> DataFrame:
    """(patient_type, area_id, date, qty)."""
    return demand.select("patient_type", "area_id", "date", "qty")


def distance_table(od: DataFrame) -> DataFrame:
    """(area_id, facility_id, km)."""
    return od.select("area_id", "facility_id", "km")


def index_sets(
    demand: DataFrame,
    episodes: DataFrame,
    start: DateLike,
    days: int,
    overflow: int = fv.OVERFLOW_FACILITY,
) -> DataFrame:
    """(set_name, member): types and areas with demand, facilities seen (and overflow), model days.

    Members are strings so that the four sets fit one table; days are date keys.
    """
    def members(df: DataFrame, col: str, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("set_name"), F.col(col).cast("string").alias("member")).distinct()

    first = F.lit(as_date(start))
    day_set = demand.sparkSession.range(1).select(
        F.explode(F.sequence(first, F.date_add(first, days - 1))).alias("date")
    )
    seen = episodes.select("facility_id").where("facility_id is not null")
    extra = demand.sparkSession.range(1).select(F.lit(overflow).cast("long").alias("facility_id"))
    return (
        members(demand, "patient_type", "types")
        .unionByName(members(demand, "area_id", "areas"))
        .unionByName(members(seen.unionByName(extra), "facility_id", "facilities"))
        .unionByName(day_set.select(F.lit("days").alias("set_name"), date_key("date").cast("string").alias("member")))
    )


def param_to_table(
    table: DataFrame, value_col: str, types: Column | None = None, value_name: str = "value"
) -> DataFrame:
    """Parameter in exchange form: key columns p, a, h, t as far as present, plus the value.

    Dates become integer keys. With ``types`` (the sorted type array) p is the 0-based type index.
    """
    cols = []
    for long_name, short in SHORT_NAMES.items():
        if long_name not in table.columns:
            continue
        col = F.col(long_name)
        if long_name == "date":
            col = date_key(col)
        elif long_name == "patient_type" and types is not None:
            col = F.array_position(types, col).cast("int") - 1
        cols.append(col.alias(short))
    return table.select(*cols, F.col(value_col).alias(value_name))


def zero_param(table: DataFrame, value_col: str) -> DataFrame:
    """What-if: the parameter is 0 everywhere."""
    return table.withColumn(value_col, F.lit(0).cast(table.schema[value_col].dataType))


def relax_param(table: DataFrame, value_col: str, value: int = fv.RELAXED_VALUE) -> DataFrame:
    """What-if: the parameter no longer binds."""
    return table.withColumn(value_col, F.lit(value).cast(table.schema[value_col].dataType))


def total_param(table: DataFrame, value_col: str, name: str = "total") -> DataFrame:
    """Sum of a parameter, one row."""
    return table.agg(F.coalesce(F.sum(value_col), F.lit(0)).alias(name))


def weights(step: float = fv.WEIGHT_STEP) -> list[float]:
    """Objective weights 1.0 ... 0.0."""
    n = round(1 / step)
    return [round(1 - i / n, 4) for i in range(n + 1)]


def other_weight(weight: Column) -> Column:
    """The weight of the other objective: what is missing to 1, to the four digits that weights have."""
    return F.round(1 - weight, 4)


def weight_array(values: list[float]) -> Column:
    """The weights as an array literal, to be exploded onto any table."""
    return F.array(*(F.lit(float(v)) for v in values))


def weight_grid(table: DataFrame, step: float = fv.WEIGHT_STEP) -> DataFrame:
    """Repeat a table for every weight pair: ``weight`` on distance, ``weight_infection`` on infection."""
    return table.select("*", F.explode(weight_array(weights(step))).alias("weight")).withColumn(
        "weight_infection", other_weight(F.col("weight"))
    )

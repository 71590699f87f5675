"""Observed and projected demand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from careflow.functions.calendar import DateLike, as_date, weekday_of
from careflow.operators.calendar import date_spine, in_horizon


def flow_counts(
    episodes: DataFrame,
    type_col: str = "patient_type",
    id_col: str = "episode_id",
    date_col: str = "admit_date",
) -> DataFrame:
    """Admissions per (date, area, type)."""
    return (
        episodes.dropna(subset=[date_col, "area_id", type_col])
        .groupBy(F.col(date_col).alias("date"), "area_id", F.col(type_col).alias("patient_type"))
        .agg(F.count(id_col).alias("qty"))
    )


def daily_demand(
    episodes: DataFrame,
    start: DateLike,
    end: DateLike,
    types: tuple[str, ...] | None = None,
    type_col: str = "patient_type",
    id_col: str = "episode_id",
) -> DataFrame:
    """Admissions per (date, area, type) in the baseline window start <= date < end."""
    rows = episodes.where(in_horizon("admit_date", start, end))
    if types is not None:
        rows = rows.where(F.col(type_col).isin(*types))
    return flow_counts(rows, type_col, id_col)


def weekday_profile(daily: DataFrame) -> DataFrame:
    """Mean demand per (area, type, weekday).

    The sum of a weekday is divided by the number of distinct dates of that weekday which occur
    anywhere in ``daily``, not by the dates of the single area. The divisors are seven rows.
    """
    marked = daily.withColumn("weekday", weekday_of("date"))
    observed = (
        marked.select("date", "weekday").distinct().groupBy("weekday").agg(F.count("date").alias("_n"))
    )
    return (
        marked.groupBy("area_id", "patient_type", "weekday")
        .agg(F.sum("qty").alias("_sum"))
        .join(F.broadcast(observed), "weekday")
        .select("area_id", "patient_type", "weekday", (F.col("_sum") / F.col("_n")).alias("qty"))
    )


def project_demand(profile: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """Repeat the weekday profile on every planning day, the end day included."""
    days = date_spine(profile.sparkSession, start, end).withColumn("weekday", weekday_of("date"))
    return profile.join(F.broadcast(days), "weekday").select("date", "area_id", "patient_type", "qty")


def integerize_demand(
    projected: DataFrame,
    keep_prefix: str | None = None,
    seed: int | str = 0,
    total_before_filter: bool = True,
) -> DataFrame:
    """Whole-number demand.

    Rows of at least one are rounded half to even. Of the rows below one, N are chosen at random
    (seeded, without replacement) and set to one, the others dropped; N is the rounded sum of the rows
    below one, taken before the area filter unless ``total_before_filter`` is off. If there are fewer
    than N such rows, all are taken.

    The random order is the md5 of seed and keys. To find the first N without sorting everything in
    one task, rows are ranked inside 65,536 hash buckets and shifted by the running total of the
    bucket counts. Hash buckets are even whatever the keys are.
    """
    keys = ["date", "area_id", "patient_type"]
    kept = projected
    if keep_prefix is not None:
        kept = kept.where(F.col("area_id").cast("string").startswith(keep_prefix))

    source = projected if total_before_filter else kept
    wanted = (
        source.where(F.col("qty") < 1)
        .agg(F.coalesce(F.bround(F.sum("qty"), 0), F.lit(0.0)).cast("long"))
        .scalar()
    )

    small = (
        kept.where(F.col("qty") < 1)
        .select(*keys)
        .withColumn("_draw", F.md5(F.concat_ws("|", F.lit(str(seed)), *keys)))
        .withColumn("_bucket", F.substring("_draw", 1, 4))
    )
    per_bucket = small.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = per_bucket.select(
        "_bucket",
        (F.sum("_size").over(W.orderBy("_bucket")) - F.col("_size")).alias("_before"),
    ).where(F.col("_before") < wanted)
    inside = W.partitionBy("_bucket").orderBy("_draw", *keys)
    chosen = (
        small.join(F.broadcast(before), "_bucket")
        .withColumn("_rank", F.col("_before") + F.row_number().over(inside))
        .where(F.col("_rank") <= wanted)
        .select(*keys, F.lit(1).cast("long").alias("qty"))
    )
    large = kept.where(F.col("qty") >= 1).select(*keys, F.bround("qty", 0).cast("long").alias("qty"))
    return large.unionByName(chosen)


def avg_length_of_stay(
    episodes: DataFrame,
    start: DateLike,
    end: DateLike,
    types: tuple[str, ...] | None = None,
    type_col: str = "patient_type",
    stay_col: str = "stay_days",
) -> DataFrame:
    """(patient_type, los): mean stay over all rows, rounded half to even.

    Only types with an admission inside start <= date < end are listed; the mean still covers every
    row. Both facts come from one pass: the count of admissions in the window rides along.
    """
    rows = episodes if types is None else episodes.where(F.col(type_col).isin(*types))
    inside = F.max(
        in_horizon("admit_date", start, end) & F.col("area_id").isNotNull()
    )
    return (
        rows.dropna(subset=[type_col])
        .groupBy(F.col(type_col).alias("patient_type"))
        .agg(F.bround(F.avg(stay_col), 0).cast("long").alias("los"), inside.alias("_inside"))
        .where("_inside")
        .drop("_inside")
    )

"""Places of rows in their group, for groups of any size."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from careflow.session import cut_lineage


def placed(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``place``, each row's place (from 1) among the rows of its group in the given order.

    Range partitions by group and order split a group of any size over many tasks; a place is the place in the partition
    plus the group's rows in the partitions before. Nulls form a group, and come last in it as a group key. Rows that
    agree in everything that is given get their places in any order; the number of their row in the input keeps even
    them apart, so that any number of equal rows is split too. The rows are written once.
    """
    keys = [*(F.col(c).asc_nulls_last() for c in group), *order, F.col("tie_")]
    # 33 low bits: the place in the partition; above them: the partition
    at = F.monotonically_increasing_id()
    numbered = df.withColumn("tie_", at).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie_")
    numbered = cut_lineage(numbered.withColumn("at_", at).withColumn("part_", F.shiftright("at_", 33)))
    runs = numbered.groupBy("part_", *group).agg(F.min("at_").alias("first"), F.count("*").alias("rows"))
    earlier = W.partitionBy(*group).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first") + 1
    runs = runs.select("part_", *group, shift.alias("shift")).toDF("r_part", *(f"r_{c}" for c in group), "shift_")
    same = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in group]
    joined = numbered.join(runs, reduce(and_, same, F.col("part_") == F.col("r_part")))
    return joined.select(*df.columns, (F.col("at_") + F.col("shift_")).alias("place"))

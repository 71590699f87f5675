"""A stored census ledger that takes new movements in batches.

The store keeps the sparse rows of every (type, facility) series with their running census, in units of a bucket of series
and a year. A batch rewrites only the units that it changes: those of the buckets of its series, from its first year in the
bucket on. What lies before is read as one opening row per series and stays as it is.

A batch is first written aside as whole new units, then noted as prepared, then moved in by overwriting just these units,
then noted as applied. A writer that was stopped in between is made good by the next call: moving in a second time changes
nothing, and a batch that is already applied isn't added again. There is one writer at a time.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careflow.operators.ledger import SERIES, census_of_nets, running_census
from careflow.session import cut_lineage

UNIT = ("bucket", "year")
BUCKETS = 256
NOTES = "batch string, state string"
PREPARED, APPLIED = "prepared", "applied"
DERIVED = ("net", "census")


def _additive(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (*SERIES, "date", *UNIT, *DERIVED)]


def _in_units(df: DataFrame, buckets: int) -> DataFrame:
    """``df`` with the unit of each row. The bucket depends on the series alone."""
    bucket = F.pmod(F.xxhash64(*SERIES), F.lit(buckets)).cast("int")
    return df.withColumns({"bucket": bucket, "year": F.year("date")})


def _write_units(df: DataFrame, path: str) -> None:
    """Rows of a unit go to one task, so a unit is one sorted file: a series has at most one row a day."""
    rows = df.repartition(*UNIT).sortWithinPartitions(*UNIT, *SERIES, "date")
    rows.write.mode("overwrite").partitionBy(*UNIT).parquet(path)


def _read_units(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _note(spark: SparkSession, path: str, batch: str, state: str) -> None:
    spark.createDataFrame([(batch, state)], NOTES).coalesce(1).write.mode("append").parquet(f"{path}/notes")


def _states(spark: SparkSession, path: str, batch: str) -> tuple[set[str], list[str]]:
    """States of ``batch``, and batches that are prepared but not applied (one at most, from a stopped writer)."""
    notes = spark.read.schema(NOTES).parquet(f"{path}/notes")
    states = notes.groupBy("batch").agg(F.collect_set("state").alias("states"))
    open_ones = ~F.array_contains("states", APPLIED)
    found = states.where((F.col("batch") == batch) | open_ones).collect()
    own = {s for r in found if r["batch"] == batch for s in r["states"]}
    return own, [r["batch"] for r in found if APPLIED not in r["states"]]


def _settings(spark: SparkSession, path: str) -> tuple[int, T.StructType]:
    row = spark.read.parquet(f"{path}/settings").first()
    return row["buckets"], T.StructType.fromJson(json.loads(row["schema"]))


def start_ledger(movements: DataFrame, path: str, buckets: int = BUCKETS, batch: str = "start") -> None:
    """A store at ``path`` from a movement table (see ``ledger.movements``); its counts are all added up by later batches.

    An existing store is replaced. The notes come last, so a start that was stopped leaves no store.
    """
    spark = movements.sparkSession
    spark.createDataFrame([], NOTES).write.mode("overwrite").parquet(f"{path}/notes")
    rows = _in_units(running_census(movements), buckets)
    _write_units(rows, f"{path}/rows")
    settings = spark.createDataFrame([(buckets, rows.schema.json())], "buckets int, schema string")
    settings.coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
    _note(spark, path, batch, APPLIED)


def running_rows(spark: SparkSession, path: str) -> DataFrame:
    """The sparse rows of the store with ``net`` and ``census``, as of ``running_census``."""
    return _read_units(spark, f"{path}/rows", _settings(spark, path)[1]).drop(*UNIT)


def _changed_units(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """New content of all units that ``delta`` (by unit) changes."""
    additive = _additive(delta)
    # one row per bucket at most
    touched = F.broadcast(delta.groupBy("bucket").agg(F.min("year").alias("_first")))
    near = stored.join(touched, "bucket")
    opening = (
        near.where("year < _first")
        .groupBy(*SERIES, "bucket")
        .agg(F.max_by("census", "date").alias("net"))
        .select(*SERIES, F.lit(None).cast("date").alias("date"), "bucket", *(F.lit(0).cast("long").alias(c) for c in additive), "net")
    )
    columns = [*SERIES, "date", "bucket", *additive]
    changes = near.where("year >= _first").select(*columns).unionByName(delta.select(*columns))
    daily = changes.groupBy(*SERIES, "date", "bucket").agg(*(F.sum(c).alias(c) for c in additive))
    daily = daily.withColumn("net", F.col("admits") - F.col("discharges"))
    # the opening row has no date, so it sorts first
    rows = census_of_nets(daily.unionByName(opening), (*SERIES, "bucket"))
    return rows.where("date is not null").withColumn("year", F.year("date")).select(*stored.columns)


def _move_in(spark: SparkSession, path: str, batch: str, schema: T.StructType) -> None:
    """Prepared units take the place of the stored ones; other units are not touched. Can be repeated.

    A prepared unit is one file, so units are copied file by file without another shuffle; one too large for a task stays
    in as many sorted files as it is read in.
    """
    units = _read_units(spark, f"{path}/prepared/{batch}", schema)
    units = units.sortWithinPartitions(*UNIT, *SERIES, "date")
    writer = units.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*UNIT)
    writer.parquet(f"{path}/rows")
    _note(spark, path, batch, APPLIED)


def add_batch(movements: DataFrame, path: str, batch: str) -> bool:
    """Add the movements of a batch of new episodes; False if the batch has been added before.

    ``batch`` names the batch for good (letters, digits, ``-`` and ``_``). ``movements`` has the columns of the table that
    the store was started with. A batch that an earlier call prepared but didn't finish is finished first; if it is this
    one, its prepared rows count and ``movements`` isn't read.
    """
    if not batch or not all(c.isalnum() or c in "-_" for c in batch):
        raise ValueError(f"batch: {batch!r}")
    spark = movements.sparkSession
    buckets, schema = _settings(spark, path)
    own, unfinished = _states(spark, path, batch)
    for other in unfinished:
        _move_in(spark, path, other, schema)
    if own:
        return APPLIED not in own
    delta = cut_lineage(_in_units(movements, buckets))
    if delta.isEmpty():
        _note(spark, path, batch, APPLIED)
        return True
    stored = _read_units(spark, f"{path}/rows", schema)
    missing = set(_additive(stored)) ^ set(_additive(delta))
    if missing:
        raise ValueError(f"columns differ from those of the store: {sorted(missing)}")
    _write_units(_changed_units(stored, delta), f"{path}/prepared/{batch}")
    _note(spark, path, batch, PREPARED)
    _move_in(spark, path, batch, schema)
    return True


def has_ledger(spark: SparkSession, path: str) -> bool:
    """Whether a complete store is there."""
    try:
        return not spark.read.schema(NOTES).parquet(f"{path}/notes").isEmpty()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise

"""Parameter tables on disk, one folder per run and table.

A run is identified by what it was built from: start day, number of days, configuration and the content of the sources.
Another window or other data is a different run, so a stale one is never picked up.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.functions.calendar import DateLike, as_date

MARKER = "name string"


def source_identity(sources: dict[str, DataFrame]) -> dict[str, list[str]]:
    """Schema and content of each source: the number of rows, and the sum and the exclusive or of the rows' hashes.

    One aggregation over all sources, of which a line each comes back. It doesn't depend on the order of rows or on the
    names of files: data replaced under the same name is seen, and the same data under another name is the same.
    """
    if not sources:
        return {}
    hashed = [
        df.select(F.lit(name).alias("source"), F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).alias("h"))
        for name, df in sorted(sources.items())
    ]
    rows = (
        reduce(DataFrame.unionByName, hashed)
        .groupBy("source")
        .agg(F.count("*"), F.sum(F.col("h").cast("decimal(19,0)")), F.bit_xor("h"))
        .collect()
    )
    content = {name: [str(x) for x in rest] for name, *rest in rows}
    return {n: [df.schema.simpleString(), *content.get(n, ["0"])] for n, df in sorted(sources.items())}


def run_id(
    start: DateLike,
    days: int,
    config: dict | None = None,
    sources: dict[str, DataFrame] | None = None,
    version: str | None = None,
) -> str:
    """Name of a run. A ``version`` of the sources, if the caller keeps one, saves reading them for their content."""
    origin = {"version": version} if version is not None else source_identity(sources or {})
    text = json.dumps([config or {}, origin], sort_keys=True, default=str)
    return f"{as_date(start):%Y%m%d}-{days}-{hashlib.sha1(text.encode()).hexdigest()[:12]}"


def _folder(base: str, run: str) -> str:
    return f"{base.rstrip('/')}/run_id={run}"


def _mark(spark: SparkSession, base: str, run: str, names: list[str]) -> None:
    rows = spark.createDataFrame([(n,) for n in names], MARKER).coalesce(1)
    rows.write.mode("overwrite").parquet(f"{_folder(base, run)}/tables_of_run")


def save_params(params: dict[str, DataFrame], base: str, run: str) -> None:
    """Write every table as Parquet, then a marker table that lists them.

    The marker is emptied first, so a run that fails on the way is not taken for a complete one.
    """
    names = sorted(params)
    spark = params[names[0]].sparkSession
    _mark(spark, base, run, [])
    for name in names:
        params[name].write.mode("overwrite").parquet(f"{_folder(base, run)}/{name}")
    _mark(spark, base, run, names)


def load_params(spark: SparkSession, base: str, run: str) -> dict[str, DataFrame] | None:
    """Tables of a complete run, or None if there is none."""
    try:
        marker = spark.read.schema(MARKER).parquet(f"{_folder(base, run)}/tables_of_run")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    names = [r["name"] for r in marker.collect()]
    return {n: spark.read.parquet(f"{_folder(base, run)}/{n}") for n in names} or None

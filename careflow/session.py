"""Lineage cutting that survives the loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written = 0  # tables written by this process, for logs


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for tables that cut lineage.

    ``spark.checkpoint.dir`` of the session comes first, then a folder already set on the context. Only a local
    master without either gets a temporary folder, which is removed when the process ends; on a cluster a
    machine-local folder would be lost with its machine, so a missing setting or a ``file:`` one is an error there.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not sc.master.startswith("local") and (not folder or folder.startswith("file:")):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if not folder:
        folder = tempfile.mkdtemp(prefix="careflow-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """Folder below the checkpoint folder that holds all written tables of this application."""
    return f"{ensure_checkpoint_dir(spark)}/careflow-{spark.sparkContext.applicationId}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from the files.

    A written table rather than an RDD checkpoint: it keeps column pruning and filter pushdown, and its size
    is known, so Spark broadcasts it only when it is small.
    """
    global _written
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written += 1
    return spark.read.schema(df.schema).parquet(path)


def written_tables() -> int:
    """How many tables ``cut_lineage`` has written in this process."""
    return _written


def clear_scratch(spark: SparkSession) -> None:
    """Remove the written tables of this application, at the end of a run: nothing made from them can be read after.

    One overwrite with an empty table empties the folder in any file system that Spark can write to.
    """
    spark.range(0).write.mode("overwrite").parquet(scratch_folder(spark))

"""Taking whole rows of a table by id and text, with repeated rows told apart from single ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_hash():
    return F.xxhash64("text")


def rows_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row (``row``, a struct of all columns) of ``docs`` for each row of ``keys``, with the columns of ``keys``.

    ``keys`` has k_id, k_hash (of the text) and k_rows (how many rows of ``docs`` have them). Only where k_rows is above
    1 are rows aggregated, so the texts of the others are joined and no more. A column k_source is matched too. Nulls
    match nulls.
    """
    # a struct keeps clear of clashing names
    marked = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("k_id")) & (F.xxhash64("row.text") == F.col("k_hash"))
    if "k_source" in keys.columns:
        same &= F.col("row.source").eqNullSafe(F.col("k_source"))
    once = marked.join(keys.where("k_rows = 1"), same)
    repeated = keys.where("k_rows > 1")
    if repeated.isEmpty():
        return once
    found = marked.join(repeated, same).groupBy(*keys.columns).agg(F.first("row").alias("row"))
    return once.union(found.select(once.columns))

"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, its source's target divided by its source's
size. Walking the documents of a source in order of size, the expected copies are summed up, one random offset is
added, and a copy is emitted for each whole number passed. Ordered by size, short and long documents are taken in the
same proportion, so the words taken stay within about one longest document of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from careflow.llm.ranks import placed
from careflow.llm.rows import rows_of, text_hash
from careflow.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the source's name and the seed only: 52 bits of an md5."""
    name = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7
) -> DataFrame:
    """One row per source: source, source_size, target, per_document (expected copies), offset.

    ``weights`` repeat over the sources in code point order, null last. The targets sum to ``share`` of all words, and
    none is above ``most`` times its source: with the sources in order of cap / weight, those at the front reach their
    cap, and the rest share what is left by weight. Both windows run over one row per source name, never over
    documents. With no words at all every target is 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    order = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    per = per.withColumn("weight", weight).withColumn("cap", cap)
    queue = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = queue.rowsBetween(W.unboundedPreceding, -1)
    after = queue.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    # the sources that are not full share the level of the first of them
    shared = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * shared["level"])
    return per.withColumn("target", target).select(
        "source",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("per_document"),
        offset(F.col("source"), seed).alias("offset"),
    )


def systematic_copies(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """How often each document is taken: doc_id, source, size, source_size, target, copies, and the columns of ``carry``.

    The texts are read once; what is sorted and written is one narrow row per document. A source of any size is ranked
    over many tasks.

    Null texts and null ids count as documents of size 0 and id null; a null source is a source of its own; rows that
    are equal share their copies in any order; an empty table gives an empty result. Other columns are ignored.
    """
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *carry)
    sizes = cut_lineage(narrow)
    order = [F.col("size"), F.col("doc_id"), *(F.col(c) for c in carry)]
    ranked = placed(sizes, ["source"], order)
    targets = source_targets(sizes, weights, share, most, seed).withColumnRenamed("source", "t_source")
    joined = ranked.join(targets, F.col("source").eqNullSafe(F.col("t_source")))
    passed = lambda rank: F.floor(rank * F.col("per_document") + F.col("offset"))
    copies = (passed(F.col("place")) - passed(F.col("place") - 1)).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), *carry)


def systematic_mix(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; rows that it doesn't take are left out.

    Parameters as in ``systematic_copies``. Rows of equal id, source and text share their copies, and one of them stands
    for all.
    """
    hashed = docs.select("doc_id", "source", "text", text_hash().alias("text_hash"))
    copies = systematic_copies(hashed, carry=("text_hash",), **parameters)
    keys = copies.groupBy(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), "source").agg(
        F.count("*").alias("k_rows"), F.sum("copies").alias("copies")
    )
    keys = cut_lineage(keys.withColumnRenamed("source", "k_source"))
    found = rows_of(docs, keys)
    return found.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")

"""From raw documents to token ids: five stages, each on all that the one before it kept.

Every stage takes an empty table, and gives an empty one; all but the last pass other columns through, whatever
their names. What nulls, empty texts and repeated rows mean to a stage stands at its function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from careflow.llm.decontaminate import with_overlap
from careflow.llm.huffman import encoded_digests
from careflow.llm.mixing import systematic_mix
from careflow.llm.ngram_join import one_of_each
from careflow.llm.toxicity import toxicity
from careflow.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below 0.5; it is fitted on the labels of these documents.

    Null and empty texts have no terms and get the score of the bias; repeated rows are judged each, and alike.
    """
    score = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(score("text") < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 on five-word sets.

    Null and empty texts are copies of each other, so one of them stays; so does one of repeated rows. Null ids come last.
    """
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item.

    Null and empty texts have no windows and stay; repeated rows are judged each, and alike.
    """
    found = with_overlap(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "overlap_")
    return found.where("not overlap_.contaminated").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as systematic sampling to the sources' targets takes it.

    Null and empty texts have size 0; a null source is a source; repeated rows share their copies.
    """
    return systematic_mix(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in Huffman-coded blocks, read back: doc_id, start, n_tokens, ids_crc32 of every document taken.

    Null and empty texts hold the end id alone; a null id comes first; repeated rows are encoded each.
    """
    return encoded_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

#: A fitted model, MinHash components and a tokenizer have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs

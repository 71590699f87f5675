"""Queries of the operators in this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.llm.decontaminate import with_overlap
from careflow.llm.huffman import encoded_digests
from careflow.llm.langid import held_out as language_held_out
from careflow.llm.langid import language_of
from careflow.llm.licenses import license_scan
from careflow.llm.maincontent import extract_main_text
from careflow.llm.merkle import document_proofs
from careflow.llm.mixing import systematic_copies
from careflow.llm.ngram_join import ngram_jaccard_join
from careflow.llm.periodic import periodic_runs, run_digests
from careflow.llm.pstable import nearest
from careflow.llm.quotes import link_quotes
from careflow.llm.shards import balanced_shards
from careflow.llm.toxicity import held_out, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation in reply order and without quotes, with the links that its quotes give."""
    return link_quotes(table(spark, sf_dir, "conversations"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a factorization machine over hashed terms."""
    docs = table(spark, sf_dir, "documents")
    score = toxicity(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every 20th vector, by multiprobe p-stable hashing."""
    return nearest(table(spark, sf_dir, "embeddings"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by minimum-cut labelling of its blocks."""
    return extract_main_text(table(spark, sf_dir, "pages"))


def op5_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, by systematic sampling to source targets."""
    mixed = systematic_copies(table(spark, sf_dir, "documents"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document, at a Jaccard similarity of 0.8 on sets of five words."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by unigram pieces summed over all segmentations."""
    docs = table(spark, sf_dir, "documents")
    language = language_of(docs)
    found = docs.select("doc_id", language_held_out(F.col("doc_id")).alias("held_out"), language("text").alias("l"))
    return found.select("doc_id", "held_out", F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of ten words of a benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = with_overlap(docs, table(spark, sf_dir, "benchmark"), "m")
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return measured.select("doc_id", *(F.col(f"m.{c}") for c in names))


def op9_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as Huffman codes, read back and digested."""
    return encoded_digests(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that every document mentions, by ordered signature rules."""
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op11_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document: copies of a text together, sizes even, by balanced label propagation."""
    placed = balanced_shards(table(spark, sf_dir, "documents"))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of every document, and what is left without the repetitions, as digests."""
    docs = table(spark, sf_dir, "documents")
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = docs.select("doc_id", periodic_runs(F.col("text"), number).alias("found"))
    return found.select("doc_id", *(c.alias(name) for name, c in run_digests(F.col("found")).items()))


def op13_merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document in a tree of digests by language, checked with every third text tampered with."""
    return document_proofs(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quotation_links,
        op2_toxicity,
        op3_nearest,
        op4_main_text,
        op5_systematic_mix,
        op6_ngram_jaccard_join,
        op7_language,
        op8_decontaminate,
        op9_huffman_ids,
        op10_licenses,
        op11_balanced_shards,
        op12_periodic_runs,
        op13_merkle_proofs,
    )
}

_DOC_WORDS = r"""
docs AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents)"""

ORACLES = {
    "op5_systematic_mix": r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM sizes GROUP BY source),
-- pour what is left over the sources that are not full, until none is above its cap
pour AS (
  SELECT 0 AS round, source, source_size, weight, false AS full_, 0.0::DOUBLE AS target FROM per
  UNION ALL
  SELECT round + 1, source, source_size, weight,
    full_ OR level * weight >= 2 * source_size,
    CASE WHEN full_ OR level * weight >= 2 * source_size THEN 2.0 * source_size ELSE level * weight END
  FROM (
    SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) FILTER (full_) OVER (), 0))
      / sum(weight) FILTER (NOT full_) OVER () AS level
    FROM pour WHERE round < (SELECT count(*) + 1 FROM per))),
targets AS (
  SELECT source, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each,
    CAST('0x' || substr(md5('7|' || coalesce('s' || source, 'n')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM pour WHERE round = (SELECT max(round) FROM pour)),
ranked AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) AS k FROM sizes)
SELECT r.doc_id, r.size, t.source_size, t.target,
  CAST((floor(k * each + u) - floor((k - 1) * each + u)) * r.size AS BIGINT) AS taken
FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source""",
    "op8_decontaminate": "WITH" + _DOC_WORDS + r""",
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT d.r, i, n, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows)) d),
hits AS (SELECT p.r, p.i, p.n, item FROM places p JOIN windows v ON p.n = v.n AND p.win = v.win),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
ids AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN ids USING (r)""",
    "op13_merkle_proofs": r"""
WITH RECURSIVE
crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
texts AS (
  SELECT row_number() OVER () AS r, doc_id, lang, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(doc_id::VARCHAR) + 1),
      lambda k: ascii((doc_id::VARCHAR)[k])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 3 = 0 AS tampered
  FROM documents, crc),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
    count(*) OVER (PARTITION BY lang) AS n
  FROM (
    SELECT r, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
      sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS changed, coalesce(tampered, false) AS tampered
    FROM texts)),
nodes AS (
  SELECT 0 AS lvl, lang, rank, n AS width, leaf AS digest FROM leaves
  UNION ALL
  SELECT lvl + 1, lang, rank // 8, (any_value(width) + 7) // 8, sha256(string_agg(digest, '' ORDER BY rank))
  FROM nodes WHERE width > 1 GROUP BY lvl, lang, rank // 8),
roots AS (
  SELECT lang, lvl AS height, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS n
  FROM nodes WHERE width = 1),
tops AS (
  SELECT 0 AS lvl, rank, n AS width, digest FROM roots
  UNION ALL
  SELECT lvl + 1, rank // 8, (any_value(width) + 7) // 8, sha256(string_agg(digest, '' ORDER BY rank))
  FROM tops WHERE width > 1 GROUP BY lvl, rank // 8),
beside AS (
  SELECT r, s.lvl, s.rank, s.rank < k.rank AS before, s.rank > k.rank AS after, s.digest
  FROM (SELECT r, lang, lvl, rank // (8 ** lvl)::BIGINT AS rank
        FROM leaves, (SELECT DISTINCT lvl FROM nodes WHERE width > 1)) k
  JOIN nodes s ON s.lang IS NOT DISTINCT FROM k.lang AND s.lvl = k.lvl AND s.width > 1 AND s.rank // 8 = k.rank // 8
  UNION ALL
  SELECT r, height + s.lvl, s.rank, s.rank < k.rank, s.rank > k.rank, s.digest
  FROM (SELECT r, height, lvl, t.rank // (8 ** lvl)::BIGINT AS rank
        FROM leaves l JOIN roots t ON l.lang IS NOT DISTINCT FROM t.lang, (SELECT DISTINCT lvl FROM tops WHERE width > 1)) k
  JOIN tops s ON s.lvl = k.lvl AND s.width > 1 AND s.rank // 8 = k.rank // 8),
levels AS (
  SELECT r, lvl, coalesce(string_agg(digest, '' ORDER BY rank) FILTER (before), '') AS lower,
    coalesce(string_agg(digest, '' ORDER BY rank) FILTER (after), '') AS upper
  FROM beside GROUP BY r, lvl),
proof AS (SELECT r, count(*) AS steps, sha256(string_agg(lower || upper, '' ORDER BY lvl)) AS proof FROM levels GROUP BY r),
fold AS (
  SELECT r, 0 AS lvl, CASE WHEN tampered THEN changed ELSE leaf END AS digest FROM leaves
  UNION ALL
  SELECT f.r, f.lvl + 1, sha256(lower || f.digest || upper) FROM fold f JOIN levels s ON f.r = s.r AND f.lvl = s.lvl)
SELECT l.doc_id, l.leaf, t.digest AS subroot, a.digest AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
  f.digest AS folded_root, f.digest = a.digest AS verified
FROM leaves l JOIN roots t ON l.lang IS NOT DISTINCT FROM t.lang
JOIN (SELECT digest FROM tops WHERE width = 1) a ON true
LEFT JOIN proof p ON l.r = p.r
JOIN fold f ON f.r = l.r AND f.lvl = coalesce(p.steps, 0)""",
}

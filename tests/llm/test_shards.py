import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from careflow.llm import entries, ranks, shards
from careflow.session import cut_lineage


def measures(rows):
    """(bytes by shard, texts in several shards, linked pairs that are cut)."""
    loads, where, slots = Counter(), defaultdict(Counter), defaultdict(list)
    for r in rows:
        loads[r["shard"]] += r["size"]
        where[r["text_crc32"], r["size"]][r["shard"]] += 1
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    cut = sum(sum(c.values()) ** 2 - sum(n * n for n in c.values()) for c in where.values()) // 2
    return loads, sum(len(c) > 1 for c in where.values()), cut


def test_query_keeps_copies_together_and_sizes_even(spark, table):
    sf = "/root/testdata/sf0.01"
    rows = entries.op11_balanced_shards(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    loads, split, cut = measures(rows)
    mean = sum(loads.values()) / 16
    assert set(loads) == set(range(16)) and max(abs(x - mean) for x in loads.values()) < 0.02 * mean
    assert (split, cut) == (0, 0)
    again = entries.op11_balanced_shards(spark, sf).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_a_text_of_a_third_of_all_rows_takes_as_few_shards_as_it_can(documents):
    rows = [(k, "hot text", "s") for k in range(3000)] + [(3000 + k, f"tex {k:04}", "s") for k in range(6000)]
    rows += [(9000 + k, f"pair {k % 400}", "s") for k in range(800)]
    found = shards.balanced_shards(documents(rows)).collect()
    loads, split, _ = measures(found)
    mean = sum(loads.values()) / 16
    assert max(abs(x - mean) for x in loads.values()) < 0.01 * mean
    hot = Counter(r["shard"] for r in found if r["doc_id"] < 3000)
    at_random = 3000**2 * 15 / 16 / 2
    cut = (3000**2 - sum(n * n for n in hot.values())) / 2
    assert sum(n > 30 for n in hot.values()) <= 7 and cut < 0.9 * at_random
    pairs = defaultdict(set)
    for r in found:
        if r["doc_id"] >= 9000:
            pairs[r["text_crc32"]].add(r["shard"])
    assert sum(len(s) > 1 for s in pairs.values()) <= 8


def test_rounds_never_cut_more(spark):
    """More rounds leave no more linked pairs in different shards, even where all documents are linked and room is short."""
    cells = spark.range(4000).select(
        (F.col("id") % 500).alias("key"), (F.col("id") % 500 % 7 + 1).alias("size"), (F.xxhash64("id") % 4 + 4).cast("int").alias("shard")
    ).withColumn("shard", F.col("shard") % 4)
    cells = cells.groupBy("key", "size", "shard").agg(F.count("*").alias("n"))
    first = before = None
    for rounds in (0, 1, 2, 12):
        now = shards.propagated(cells, 4, 16_000 / 4 * 1.05, rounds, 0.0)
        rows = now.collect()
        assert sum(r["n"] for r in rows) == 4000
        by = defaultdict(list)
        for r in rows:
            by[r["key"]].append(r["n"])
        cut = sum(sum(v) ** 2 - sum(n * n for n in v) for v in by.values())
        assert before is None or cut <= before
        first, before = first or cut, cut
    assert before < 0.15 * first


@pytest.mark.parametrize("n", [1, 2, 4, 16])
def test_messy_rows(documents, n):
    rows = [(1, None), (1, None), (None, None), (2, ""), (None, "a b"), (None, "a b"), (3, "x" * 60_000), (4, "é")]
    docs = documents(rows + [(7, "equal row")] * 40)
    found = shards.balanced_shards(docs, n).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows + [(7, "equal row")] * 40)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    assert all(0 <= r["shard"] < n for r in found)
    measures(found)
    assert shards.balanced_shards(docs.limit(0), n).collect() == []


def test_equal_rows_are_placed_over_many_partitions(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ranks, "cut_lineage", lambda df: written.append(cut_lineage(df)) or written[-1])
    equal = spark.range(20_000).select(F.lit("k").alias("k"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows go to one task
    try:
        out = ranks.placed(equal, ["k"], [F.col("v")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["place"] for r in out.collect()) == list(range(1, 20_001))
    sizes = [r["count"] for r in written[0].groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 2 and max(sizes) < 10_000

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from careflow.llm.huffman import LIMIT, Codebook, code_lengths, encoded_digests, read_ids, write_ids
from careflow.llm.tokens import Encoder, tokenizer_path

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ENCODER = Encoder(tokenizer_path())


def direct(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aAbzÉéßİΣσς '’std.,!<>|≠́　\u0085\x0b\x1c한ᄒ日12½ſ\n\t-=_`", max_size=40), max_size=5))
def test_encoder_is_the_tokenizer(texts):
    ids, sizes = ENCODER(pa.array(texts, pa.string()))
    ends = np.cumsum(sizes)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)] == [direct(t) for t in texts]


def test_encoder_on_special_strings_contractions_and_nulls():
    texts = ["<|endoftext|> it's", "we'll don't x's. 'S", None, "", "a" * 5000, "Wort,ohne;Leerzeichen.", "naïve—“q”"]
    ids, sizes = ENCODER(pa.array(texts))
    ends = np.cumsum(sizes)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)] == [direct(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 10**12), min_size=1, max_size=300))
def test_lengths_are_optimal_or_limited(counts):
    lengths = code_lengths(np.array(counts))
    assert lengths.max() <= LIMIT
    if len(counts) > 1:
        assert sum(2.0 ** -int(n) for n in lengths) == 1
        heap = sorted(counts)  # plain Huffman cost
        cost = 0
        import heapq

        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        found = sum(int(n) * c for n, c in zip(lengths, counts, strict=True))
        assert found >= cost
        if max(lengths) < LIMIT:
            assert found == cost


def test_skewed_counts_reach_the_limit():
    counts = np.array([2**k for k in range(40)])
    lengths = code_lengths(counts)
    assert lengths.max() == LIMIT
    assert (2.0 ** -lengths.astype(float)).sum() == 1
    ids = np.arange(40) * 1000
    book = Codebook(ids, lengths)
    some = np.random.default_rng(1).choice(ids, 5000).astype(np.uint32)
    blocks = [some[:1], some[1:130], some[130:]]
    assert (book.decode([(*book.encode(b), len(b)) for b in blocks]) == some).all()


@pytest.mark.parametrize("parts", [1, 5])
def test_digests_are_those_of_the_tokenizer(table, parts):
    docs = table("documents").repartition(parts)
    start = 0
    found = {r["doc_id"]: r for r in encoded_digests(docs).collect()}
    for r in table("documents").orderBy("doc_id").collect():
        ids = [*direct(r["text"]), 1]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert tuple(found[r["doc_id"]]) == (r["doc_id"], start, len(ids), crc)
        start += len(ids)


def test_round_trip_of_messy_rows(spark, documents, tmp_path):
    rows = [(2, "b"), (1, None), (None, "n"), (1, ""), (2, "b"), (3, "word " * 40_000), (4, "日本 " * 50)]
    docs = documents(rows)
    write_ids(docs, f"{tmp_path}/ids")
    found = read_ids(spark, f"{tmp_path}/ids").orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, 1, 1, 2, 2, 3, 4]
    at = 0
    texts = {None: "n", 1: "", 2: "b", 3: rows[5][1], 4: rows[6][1]}
    for r in found:
        assert r["start"] == at
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*direct(texts[r["doc_id"]]), 1]
        at += r["n_tokens"]
    write_ids(docs.limit(0), f"{tmp_path}/none")
    assert read_ids(spark, f"{tmp_path}/none").count() == 0


def test_equal_rows_are_encoded_over_many_shards(spark, tmp_path):
    equal = spark.range(0, 20_000, 1, 4).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same words here").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows go to one task
    try:
        write_ids(equal, f"{tmp_path}/ids")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    blocks = spark.read.parquet(f"{tmp_path}/ids/blocks").groupBy("shard").agg(F.sum(F.size("doc_ids")).alias("n")).collect()
    assert len(blocks) > 2 and max(r["n"] for r in blocks) < 10_000
    want = [*direct("same words here"), 1]
    found = read_ids(spark, f"{tmp_path}/ids").orderBy("start").collect()
    assert [r["start"] for r in found] == list(range(0, 20_000 * len(want), len(want)))
    assert {bytes(r["ids"]) for r in found} == {np.array(want, "<u4").tobytes()}


def test_files_follow_ascending_ids(spark, table, tmp_path):
    write_ids(table("documents").repartition(6), f"{tmp_path}/ids")
    rows = spark.read.parquet(f"{tmp_path}/ids/blocks").orderBy("start").select("shard", "doc_ids").collect()
    ids = [i for r in rows for i in r["doc_ids"]]
    assert ids == sorted(ids)
    assert [r["shard"] for r in rows] == sorted(r["shard"] for r in rows)

import re

import pytest

from careflow.llm.mixing import source_targets, systematic_copies, systematic_mix
from pyspark.sql import functions as F


def poured(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by repeated pouring of the excess."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    full = set()
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / rest for s in names}
        over = {s for s in names if s not in full and target[s] >= most * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize(
    "sizes", [{"a": 10, "b": 1, "c": 400, None: 30}, {"a": 5}, {"é": 100, "z": 100, "Z": 100}, {"a": 0, "b": 0}]
)
def test_targets_are_the_poured_ones(spark, sizes):
    rows = [(s, 1) for s, n in sizes.items() for _ in range(n)] + [(s, 0) for s in sizes]
    df = spark.createDataFrame(rows, "source string, size long")
    found = {r["source"]: r["target"] for r in source_targets(df).collect()}
    assert found == pytest.approx(poured(sizes) if any(sizes.values()) else dict.fromkeys(sizes, 0.0))


def test_copies_follow_the_targets_and_reruns_agree(documents, table):
    docs = table("documents")
    rows = systematic_copies(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")) for r in rows)
    assert all(0 <= r["copies"] <= 2 for r in rows)
    by_source = {}
    for r in rows:
        s = by_source.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0] += r["copies"] * r["size"]
        s[1] = max(s[1], r["size"])
    assert all(abs(taken - target) <= longest for taken, longest, target, _ in by_source.values())
    again = systematic_copies(docs.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_messy_rows(documents):
    rows = [(1, None), (2, ""), (None, "a b c"), (3, "x y"), (3, "x y"), (3, "p q", None), (4, "w " * 5000, None)]
    docs = documents(rows)
    found = systematic_copies(docs).collect()
    assert len(found) == len(rows)
    assert sorted(r["size"] for r in found) == [0, 0, 2, 2, 2, 3, 5000]
    mixed = systematic_mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in found)
    assert systematic_copies(docs.limit(0)).count() == 0
    assert systematic_mix(docs.limit(0)).count() == 0


def test_hot_source_is_ranked_over_many_partitions(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.when(F.col("id") % 3 > 0, "s").alias("source")
    )
    rows = systematic_copies(docs).groupBy("source").agg(F.sum(F.col("copies") * 2).alias("taken"), F.first("target").alias("t"))
    assert all(abs(r["taken"] - r["t"]) <= 2 for r in rows.collect())

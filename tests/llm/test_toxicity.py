import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from careflow.llm.toxicity import Machine, fit, hashed_terms, held_out, toxicity, training_rows
from careflow.llm.words import NgramHasher


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    terms = np.arange(10, 20)
    m = Machine(terms, 0.2, rng.normal(size=10), rng.normal(size=(10, 4)))
    own = np.array([3, 11, 14, 19, 40])
    at = [1, 4, 9]
    z = 0.2 + m.weights[at].sum() + sum(m.factors[a] @ m.factors[b] for a in at for b in at if a < b)
    assert np.isclose(m.score(own), 1 / (1 + np.exp(-z)))


def exclusive(n, words, seed):
    """Toxic is a text with exactly one of two words, among random others: each of them is in half of either kind."""
    rng, hasher, rows = np.random.default_rng(seed), NgramHasher(1), []
    for _ in range(n):
        a, b = rng.integers(0, 2, 2)
        text = ["insult"] * a + ["group"] * b + [f"w{k}" for k in np.flatnonzero(rng.random(words) < 0.3)]
        rows.append((int(a != b), hashed_terms(hasher, " ".join(text)).astype("<i4").tobytes()))
    return rows


@pytest.mark.parametrize(("n", "words"), [(2000, 40), (6000, 200)])
def test_learns_a_pair_of_words_that_tell_nothing_alone(n, words):
    machine, fresh = fit(exclusive(n, words, 1)), exclusive(1000, words, 2)
    right = [(machine.score(np.frombuffer(t, "<i4")) >= 0.5) == y for y, t in fresh]
    assert np.mean(right) > 0.95


def test_no_cap_on_terms():
    hasher = NgramHasher(1)
    terms = lambda text: hashed_terms(hasher, text).astype("<i4").tobytes()
    rows = [(1, terms(f"bad{k} n{c % 9} day")) for k in range(1200) for c in range(20)]
    machine = fit(rows + [(0, terms(f"n{k % 9} day")) for k in range(len(rows))], epochs=6)
    assert (machine.weights > 0).sum() > 1024


def test_the_sample_is_bounded_in_rows_and_terms(spark, documents):
    docs = documents([(k, f"a{k} b{k} c{k}") for k in range(50)] + [(60, "same text"), (61, "same text"), (61, "same text")])
    labels = spark.createDataFrame([(k, k % 2) for k in range(62)], "doc_id long, toxic int")
    every = training_rows(docs, labels, 1000, 1000)
    assert len(every) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in [*range(50), 60, 61])
    assert len(training_rows(docs, labels, 1000, 10)) in (3, 4)  # three terms each, two in the repeated text
    assert len(training_rows(docs, labels.where("doc_id < 50"), 7, 1000)) == 7


def test_learns_words_that_are_toxic_together():
    """Each word is in half clean and half toxic texts or clean ones; only both together are always toxic."""
    hasher, rows = NgramHasher(1), []
    for k in range(600):
        text = ["insult group", "insult fine", "group fine", "fine day"][k % 4]
        rows.append((int(k % 4 == 0), hashed_terms(hasher, f"{text} w{k % 7}".encode().decode()).astype("<i4").tobytes()))
    machine = fit(rows, epochs=60)
    score = lambda t: machine.score(hashed_terms(hasher, t))
    assert score("this insult hits a group") > 0.5
    assert max(score("an insult"), score("a group"), score("")) < 0.5


def test_held_out_fold(spark):
    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    score = toxicity(docs, labels)
    scored = docs.select("doc_id", score("text").alias("s")).join(labels, "doc_id").where(held_out(F.col("doc_id")))
    rows = scored.select(F.expr("s >= 0.5").cast("int").alias("p"), "toxic").collect()
    hit = sum(r["p"] and r["toxic"] for r in rows)
    assert hit / sum(r["toxic"] for r in rows) > 0.75  # some labels are noise
    assert hit / sum(r["p"] for r in rows) > 0.95


def test_messy_rows(spark, documents):
    texts = [("idiot " + "fine day " * (k % 3), 1) if k % 2 else ("fine day today", 0) for k in range(200)]
    docs = documents([(k, t) for k, (t, _) in enumerate(texts)] + [(500, None), (501, ""), (None, "idiot"), (502, "idiot " * 20_000)])
    labels = [(k, y) for k, (_, y) in enumerate(texts)] + [(None, 1), (3, None), (9999, 1), (5, 1), (5, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("x"))
    score = toxicity(docs, labels)
    rows = {r["doc_id"]: r["s"] for r in docs.select("doc_id", score("text").alias("s")).collect()}
    assert all(0 <= s <= 1 for s in rows.values())
    assert rows[502] >= 0.5 and rows[None] >= 0.5 and rows[0] < 0.5
    assert rows[500] == rows[501]
    for none in (labels.limit(0), labels.where("toxic = 0")):
        score = toxicity(docs, none)
        assert docs.where(score("text") >= 0.5).count() == 0
    score = toxicity(docs.limit(0), labels)
    assert docs.limit(0).where(score("text") >= 0.5).count() == 0

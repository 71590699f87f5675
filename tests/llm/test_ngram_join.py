import random
import re

import pytest

from pyspark.sql import functions as F

from careflow.llm.ngram_join import banding, class_texts, ngram_jaccard_join, one_of_each, signatures, similar

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, t=0.8):
    """class_id, copy_id, n_links per row number."""
    sets = [grams(x) for _, x in rows]
    link = [
        [a != b and (len(x & y) >= t * len(x | y) if x or y else True) for b, y in enumerate(sets)] for a, x in enumerate(sets)
    ]
    out, seen = [None] * len(rows), set()
    least = lambda of: min((rows[k][0] for k in of if rows[k][0] is not None), default=None)
    for a in range(len(rows)):
        if a in seen:
            continue
        part, todo = set(), [a]
        while todo:
            x = todo.pop()
            if x not in part:
                part.add(x)
                todo += [b for b, yes in enumerate(link[x]) if yes]
        seen |= part
        for x in part:
            out[x] = (least(part), least(y for y in part if sets[y] == sets[x]), sum(link[x]))
    return out


def check(docs, rows):
    found = sorted(tuple(r)[:4] for r in ngram_jaccard_join(docs).select("doc_id", "class_id", "copy_id", "n_links").na.fill(-1).collect())
    low = lambda x: -1 if x is None else x
    want = sorted((low(i), low(c), low(e), n) for (i, _), (c, e, n) in zip(rows, brute(rows), strict=True))
    assert found == want


def variants(rng, base, n, share):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, share)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_banding_reaches_the_recall():
    for recall in (0.9, 0.99, 0.9995):
        bands, rows = banding(0.8, recall, 64)
        assert 1 - (1 - 0.8**rows) ** bands >= recall and bands * rows <= 64
    assert banding(0.8, 0.9995, 128)[1] > banding(0.8, 0.9995, 32)[1]


def test_table_and_brute_force(documents, table):
    rows = [(r["doc_id"], r["text"]) for r in table("documents").collect()]
    check(table("documents"), rows)


def test_groups_of_near_copies(documents):
    rng = random.Random(1)
    rows = []
    for _ in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(30, 150))]
        rows += variants(rng, base, 25, 3)
    rows = [(k, t) for k, t in enumerate(rng.sample(rows, len(rows)))]
    check(documents(rows), rows)


def test_blocks_of_a_large_bucket_count_each_pair_once(documents, monkeypatch):
    from careflow.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 7)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(200)]
    rows = list(enumerate(variants(rng, base, 60, 2)))
    check(documents(rows), rows)


def test_messy_rows_and_the_one_kept(documents):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, text), (3, text.upper() + "!"), (3, text.upper() + "!"), (None, text), (9, None), (8, ""), (7, " .. "), (6, "a b"),
            (4, "A, b"), (None, "alone in the world we are"), (1, "été " * 30_000), (2, "été " * 30_001), (3, "another text of id three")]
    docs = documents(rows)
    check(docs, rows)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], grams(r["text"])) for r in kept.collect()), key=str)
    want = {(3, text.upper() + "!"), (7, " .. "), (4, "A, b"), (None, rows[9][1]), (1, rows[10][1]), (3, rows[12][1])}
    assert got == sorted(((i, grams(t)) for i, t in want), key=str)
    assert kept.count() == 6
    assert ngram_jaccard_join(docs.limit(0)).count() == 0 and one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("m", [2, 3, 40])
def test_similar_is_exact(m):
    import numpy as np

    rng = np.random.default_rng(m)
    sets = [np.unique(rng.integers(0, 60, 50)).astype(np.uint64) for _ in range(m)]
    found = similar(sets, 0.6)
    for a in range(m):
        for b in range(m):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            assert found[a, b] == (a != b and len(x & y) >= 0.6 * len(x | y))


def test_repeated_rows_bring_one_text_per_class(documents):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(None, a)] * 50 + [(3, b)] * 20 + [(4, b), (5, a + " more")]
    docs = documents(rows)
    signed = signatures(docs, 5, 15, 4)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    met = signed.groupBy("set_key").agg(first, F.count("*").alias("n_docs"))
    met = met.select("set_key", F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash"), "n_docs")
    met = met.withColumn("met", F.array(F.struct(F.lit(1).alias("bucket"), F.lit(1).alias("blocks"))))
    found = sorted((r["text"], r["n_docs"]) for r in class_texts(docs, signed, met).collect())
    assert found == sorted([(a, 50), (b, 21), (a + " more", 1)])
    check(docs, rows)

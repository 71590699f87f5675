import hashlib
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from careflow.llm import decontaminate
from careflow.llm.decontaminate import finding, grouped_items, with_overlap

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, n=10):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        size = min(n, len(v))
        wins = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in wins:
                hit |= set(range(i, i + size))
                found.add(name)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(f for f in found if f is not None)).encode()).hexdigest(), bool(hit)


def measured(docs, benchmark, **parameters):
    return with_overlap(docs, benchmark, "m", **parameters).select("doc_id", "m.*")


@pytest.mark.parametrize("max_chars", [4_000_000, 500])
def test_same_as_brute_force(table, max_chars):
    docs, bench = table("documents"), table("benchmark")
    items = [(str(r["item_id"]), r["text"]) for r in bench.collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = measured(docs, bench, max_chars=max_chars).collect()
    assert len(rows) == len(texts)
    assert any(r["contaminated"] for r in rows)
    for r in rows:
        assert tuple(r)[1:6] == brute(texts[r["doc_id"]], items)


@pytest.mark.parametrize("max_chars", [4_000_000, 12])
def test_messy_items_and_texts(spark, documents, max_chars):
    items: list = [("null", "shorté été"), (1, "Short ÉTÉ item."), (1, "Short ÉTÉ item."), (2, None), (3, " ., "), (None, "a b c d e f g h i j k"), (10, "a b")]
    bench = spark.createDataFrame([(None if i is None else str(i), t) for i, t in items], "item_id string, text string").withColumn("n_hit", F.lit(1))
    texts = ["Say: SHORT...ÉTÉ   Item!", "short été", None, "", "x a b c d e f g h i j z", "shorté été item", "a b " * 9000]
    docs = documents(list(enumerate(texts)) + [(0, texts[0])])
    named = [(None if i is None else str(i), t) for i, t in items]
    rows = measured(docs, bench, max_chars=max_chars).collect()
    assert len(rows) == 8
    for r in rows:
        assert tuple(r)[1:6] == brute(texts[r["doc_id"]], named), r["doc_id"]
        for s in r["spans"]:  # offsets of the original text
            hit = words(texts[r["doc_id"]][s["first"] : s["last"]])
            assert any(hit == words(t)[k : k + len(hit)] for _, t in items for k in range(len(words(t))))
    assert measured(docs.limit(0), bench).count() == 0
    assert not any(r["contaminated"] for r in measured(docs, bench.limit(0)).collect())


def test_each_group_is_built_once_however_many_batches(spark, table, monkeypatch):
    items, groups = grouped_items(table("benchmark"), 500)
    assert groups > 3
    of = {g: [(r["item_id"], r["text"]) for r in items.where(F.col("group") == g).collect()] for g in range(3)}
    assert all(of.values())
    built, real = [], decontaminate.ahocorasick.Automaton
    monkeypatch.setattr(decontaminate.ahocorasick, "Automaton", lambda: built.append(1) or real())
    texts = [t for g in of.values() for _, t in g]
    for g, own in of.items():
        find = finding(lambda own=own: own, 10, f"test-{g}")
        found = list(find(iter([pd.Series(texts)] * 5)))
        assert len(found) == 5 and all(len(f) == len(texts) for f in found)
        assert sum(bool(h) for h in found[4]) >= len(own)
    assert len(built) == 3

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from careflow.llm import entries, periodic


def brute_runs(words):
    """Every period at every place, by its definition."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def brute(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    drop = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id,
        len(runs),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in drop)),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_the_cover_has_every_difference():
    assert {(a - b) % periodic.STEP for a in periodic.COVER for b in periodic.COVER} == set(range(periodic.STEP))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=150), st.integers(1, 9))
def test_extensions_are_those_of_letter_by_letter(letters, repeat):
    letters = np.array(letters * repeat)
    n = len(letters)
    x, y = np.meshgrid(np.arange(n + 1), np.arange(n + 1))
    x, y = x[x != y][:4000], y[x != y][:4000]
    want = []
    for a, b in zip(x.tolist(), y.tolist()):
        k = 0
        while max(a, b) + k < n and letters[a + k] == letters[b + k]:
            k += 1
        want.append(k)
    assert periodic.Extensions(letters)(x, y).tolist() == want


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.lists(
            st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=14), st.integers(1, 12)), min_size=0, max_size=6
        ),
        min_size=1,
        max_size=5,
    )
)
def test_runs_of_several_texts_are_the_brute_ones(texts):
    texts = [np.array([x for part, times in t for x in part * times], dtype=np.int64) for t in texts]
    for text, found in zip(texts, periodic.runs_of(texts), strict=True):
        assert [tuple(r) for r in found.tolist()] == brute_runs(text.tolist())


def test_grid_slices_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [np.tile(rng.integers(0, 5, k), 7) for k in (1, 3, 17, 60)] + [rng.integers(0, 2, 500)]
    want = [r.tolist() for r in periodic.runs_of(texts)]
    monkeypatch.setattr(periodic, "GRID_SLICE", 7)
    assert [r.tolist() for r in periodic.runs_of(texts)] == want
    assert all(want[:4])


def test_query_is_brute_force_on_whole_documents(spark, sf, table):
    rows = {r["doc_id"]: r for r in entries.op12_periodic_runs(spark, sf).collect()}
    docs = [r for r in table("documents").collect() if len(r["text"] or "") < 30_000]
    assert len(docs) > 190 and len(rows) == table("documents").count()
    for d in docs:
        assert tuple(rows[d["doc_id"]][c] for c in COLUMNS) == brute(d["doc_id"], d["text"])


def test_messy_rows(documents):
    planted = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    long = "x y " * 40_000 + "end"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (planted, None), (planted, "one"), (None, "a b " * 5), (7, "a b " * 5),
            (7, "a b " * 5), (8, "é x " * 6), (9, "a\x0bb\x0ca\x0db a b a b"), (10, "a a a a a b b b b b b")]
    docs = documents([*rows, (11, long)])
    got = docs.select("doc_id", periodic.periodic_runs(F.col("text"), F.crc32(F.col("doc_id").cast("string").cast("binary"))).alias("f"))
    got = got.select("doc_id", *(c.alias(k) for k, c in periodic.run_digests(F.col("f")).items())).collect()
    key = lambda r: str(r)
    want = [brute(*r) for r in rows]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got if r["doc_id"] != 11), key=key) == sorted(want, key=key)
    last = next(r for r in got if r["doc_id"] == 11)
    assert (last["n_runs"], last["start"], last["length"], last["period"]) == (1, 0, 80_000, 2)
    plain = documents(rows).limit(0).select(periodic.periodic_runs(F.col("text")).alias("f"))
    assert plain.collect() == []


@pytest.mark.parametrize("words", [20_000])
def test_long_texts_take_no_quadratic_time(words):
    import time

    rng = np.random.default_rng(1)
    started = time.perf_counter()
    for text in (np.zeros(words, dtype=np.int64), np.tile(rng.integers(0, 50, words // 5), 5), rng.integers(0, 9000, words)):
        periodic.runs_of([text])
    assert time.perf_counter() - started < 10

import numpy as np
import pytest
from pyspark.sql import functions as F

from careflow.llm.pstable import Index, nearest


def brute(rows, k=20, every=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = np.zeros(len(ids))
        for d in range(x.shape[1]):
            score += x[q, d] * x[:, d]
        order = [o for o in np.lexsort((ids, -score)) if ids[o] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[o]), score[o]) for o in order]
    return out


def test_probes_come_in_the_order_of_distance_to_the_walls():
    index = Index(dim=5, longest=1.0, planes=4)
    x = np.random.default_rng(2).normal(size=(3, 5))
    keys = index.probe_keys(x, 81)
    assert all(len(set(keys[q, t])) == 81 for q in range(3) for t in range(index.tables))
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert (keys[:, :, 0] == index.base_keys(y)).all()  # a unit vector's own cell comes first


def test_recall_on_the_table(table):
    rows = [(r["vec_id"], r["embedding"]) for r in table("embeddings").collect()]
    want, found = brute(rows), {}
    for r in nearest(table("embeddings")).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(want)
    hits = 0
    for q, top in found.items():
        top.sort()
        assert [r for r, *_ in top] == list(range(1, 21))
        exact = dict(want[q])
        assert all(exact.get(v, s) == s for _, v, s in top)
        hits += len({v for _, v, _ in top} & set(exact))
    assert hits / (20 * len(want)) >= 0.9


def test_few_rows_ties_and_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (5, [0.5, 0.5]), (3, [0.5, 0.5]), (7, [-9.0, 1.0]), (20, None), (40, [0.0, 0.0]), (60, [nan, 1.0]),
            (80, [inf, 1.0]), (100, [None, 1.0]), (120, []), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (11, [3.0, 0.0]),
            (11, [3.0, 0.0]), (11, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("v", "id", "cell")})
    found = [tuple(r) for r in nearest(df).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 11, 3.0), (0, 2, 3, 0.5), (0, 3, 5, 0.5), (0, 4, 7, -9.0)]
    assert nearest(df.limit(0)).count() == 0
    assert nearest(df.where("vec_id = 0")).count() == 0


def test_many_copies_of_one_vector(spark):
    """The copies fill many blocks of one cell; ties still go to the smallest ids."""
    rows = [(i, [1.0, 0.25, 0.5]) for i in range(3000)] + [(i, [0.1, float(i % 7), -1.0]) for i in range(3000, 3200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for q in (0, 20, 2980):
        assert [got[q][k] for k in range(1, 21)] == [i for i in range(22) if i != q][:20]


@pytest.mark.parametrize("scale", [1.0, 100.0])
def test_long_vectors_are_found_by_inner_product(spark, scale):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 8)) * rng.uniform(0.2, scale, size=(600, 1))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    want = brute(rows, k=5)
    found = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(found[q] & {v for v, _ in top}) for q, top in want.items()) / (5 * len(want)) >= 0.9


@pytest.mark.parametrize("kind", ["few", "one long"])
def test_queries_that_meet_too_few_rows_are_ranked_exactly(spark, kind):
    rng = np.random.default_rng(5)
    if kind == "few":
        x, k, every = rng.normal(size=(20, 16)), 20, 1
    else:
        x, k, every = rng.normal(size=(600, 64)) * 0.01, 20, 5
        x[0] *= 10_000
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    got = {}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for r in nearest(df, k=k, every=every).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute(rows, k=k, every=every)
    assert set(got) == set(want)
    for q, top in want.items():
        assert sorted(got[q]) == list(range(1, len(top) + 1))
        if kind == "few":
            assert [got[q][n] for n in sorted(got[q])] == top

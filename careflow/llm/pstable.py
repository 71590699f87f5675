"""Nearest neighbours by inner product, with multiprobe p-stable hashing.

Vectors are scaled to a largest norm of 1 and given one more component that makes every norm 1, so that the largest
inner product is the smallest distance. Each of a few tables hashes a vector to the cell of ``planes`` normal projections
cut into steps of ``width``. A query visits its own cell and the cells around it in the order of the squared distance to
their walls, nearest first, which is the order of estimated success. What it meets in any table is ranked by the inner
product of the original vectors.

Cells are sought with keys alone; a vector joins its keys only where a cell holds both rows and visits. How many planes
cut the cells and how many of them a query visits is fitted on a sample: few large cells where vectors hardly cluster and
most cells would be visited anyway, many small ones where neighbours share them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from careflow.session import cut_lineage

BASE_ROWS, PROBE_ROWS = 1024, 2048  # rows of a cell, and visits to it, that are compared in one unit of work, on average
VISIT_ROWS = 300  # sending a vector to a cell costs as much as comparing it with that many rows
BUFFER = 400_000


@dataclass
class Index:
    """Projections of all tables; the same numbers for the same parameters."""

    dim: int
    longest: float  # largest norm in the table
    tables: int = 4
    planes: int = 8
    width: float = 2.5
    seed: int = 17

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.a = rng.normal(size=(self.dim + 1, self.tables * self.planes))
        self.b = rng.uniform(0, self.width, size=self.tables * self.planes)
        self.r = rng.integers(0, 2**63, size=(self.tables, self.planes + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        steps = np.array(list(itertools.product((-1, 0, 1), repeat=self.planes)), dtype=np.int64)
        self.chosen = (steps[:, :, None] == np.array([-1, 0, 1])).reshape(len(steps), -1).T.astype(np.float64)
        self.shift = steps.astype(np.uint64) @ self.r[:, : self.planes].T  # what a step adds to a cell's key

    def _cells(self, x: np.ndarray) -> np.ndarray:
        return ((x @ self.a[: self.dim + 1] + self.b) / self.width).reshape(len(x), self.tables, self.planes)

    def _keys(self, cells: np.ndarray) -> np.ndarray:
        whole = np.floor(cells).astype(np.int64).astype(np.uint64)
        return (whole * self.r[None, :, : self.planes]).sum(axis=2, dtype=np.uint64) + self.r[None, :, self.planes]

    def base_keys(self, x: np.ndarray) -> np.ndarray:
        """Cell of every vector in every table."""
        y = x / self.longest
        rest = np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1, keepdims=True)))
        return self._keys(self._cells(np.concatenate((y, rest), axis=1))).view(np.int64)

    def probe_keys(self, x: np.ndarray, probes: int) -> np.ndarray:
        """Cells to visit, vector x table x probe, in estimated success order."""
        y = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        cells = self._cells(np.concatenate((y, np.zeros((len(x), 1))), axis=1))
        part = cells - np.floor(cells)
        cost = np.stack((part**2, np.zeros_like(part), (1 - part) ** 2), axis=3)
        cost = cost.reshape(len(x), self.tables, -1) @ self.chosen
        order = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
        own = self._keys(cells)
        table = np.arange(self.tables)[None, :, None]
        return (own[:, :, None] + self.shift[order, table]).view(np.int64)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, every component finite, not all zero."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dim)


def fitted_probes(sample: np.ndarray, index: Index, k: int, recall: float) -> tuple[int, float]:
    """Fewest probes with which the sample's own neighbours are found at the wanted recall, and the cost of them.

    In the whole table neighbours are nearer than in a sample, so the recall there is no lower. The cost is the number of
    visits of a query and the share of all rows that it is compared with; a row met in two tables counts twice.
    """
    every = 3**index.planes
    if len(sample) < 2:
        return 1, 0.0
    asked = np.linspace(0, len(sample) - 1, min(100, len(sample))).astype(int)
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    base, visits = index.base_keys(sample), index.probe_keys(sample[asked], every)
    rank = np.full((index.tables, *scores.shape), every)  # the probe that meets a row, by table and query
    for t in range(index.tables):
        for q in range(len(asked)):
            order = np.argsort(visits[q, t])
            at = np.minimum(np.searchsorted(visits[q, t], base[:, t], sorter=order), every - 1)
            met = visits[q, t][order[at]] == base[:, t]
            rank[t, q] = np.where(met, order[at], every)
    first = np.take_along_axis(rank.min(axis=0), best, axis=1)
    probes = min(int(np.quantile(first, recall, method="higher")) + 1, every)
    return probes, float((rank < probes).sum() / scores.size)


def fitted_index(sample: np.ndarray, rows: int, longest: float, planes: tuple[int, ...], k: int, recall: float, **shape) -> tuple[Index, int]:
    """The index of the cheapest number of planes for a table of ``rows`` rows, and its probes."""
    found = []
    for p in planes:
        index = Index(sample.shape[1], longest, planes=p, **shape)
        probes, share = fitted_probes(sample, index, k, recall)
        found.append((probes * index.tables * VISIT_ROWS + share * rows, p, index, probes))
    return min(found, key=lambda f: f[:2])[2:]


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query: larger score, then smaller id; a pair that was met twice counts once."""
    order = np.lexsort((-score, vec, query))
    query, vec, score = query[order], vec[order], score[order]
    once = np.ones(len(query), dtype=bool)
    once[1:] = (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])
    query, vec, score = query[once], vec[once], score[once]
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    starts = np.flatnonzero(np.diff(query, prepend=query[0] - 1)) if len(query) else np.empty(0, int)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    keep = place < k
    return query[keep], vec[keep], score[keep]


class Ranker:
    """Keeps the k best per query over all units of work of a task."""

    def __init__(self, k: int):
        self.k = k
        self.found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        self.new: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0
        self.floor: dict[int, float] = {}  # score of a query's k-th best so far

    def add(self, q_ids: np.ndarray, q: np.ndarray, b_ids: np.ndarray, b: np.ndarray) -> None:
        rough = q @ b.T
        floor = np.array([self.floor.get(i, -np.inf) for i in q_ids.tolist()])
        if rough.shape[1] > self.k and len(np.unique(b_ids)) == len(b_ids):
            floor = np.maximum(floor, np.partition(rough, -self.k - 1, axis=1)[:, -self.k - 1])
        slack = 1e-9 * np.sqrt((q * q).sum(axis=1) * (b * b).sum(axis=1).max())
        i, j = np.nonzero((rough >= (floor - slack)[:, None]) & (q_ids[:, None] != b_ids[None, :]))
        score = np.zeros(len(i))
        for d in range(q.shape[1]):  # one order of summation for every pair, so equal vectors tie exactly
            score += q[i, d] * b[j, d]
        self.new.append((q_ids[i], b_ids[j], score))
        self.waiting += len(i)
        if self.waiting > BUFFER:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        columns = [np.concatenate(c) for c in zip(self.found, *self.new, strict=True)]
        self.found, self.new, self.waiting = list(_best(*columns, self.k)), [], 0
        query, _, score = self.found
        last = np.flatnonzero(np.diff(query, append=query[-1] + 1)) if len(query) else np.empty(0, int)
        full = last[last >= self.k - 1]
        full = full[query[full - self.k + 1] == query[full]]
        self.floor = dict(zip(query[full].tolist(), score[full].tolist(), strict=True))
        return tuple(self.found)


def nearest(
    embeddings: DataFrame,
    k: int = 20,
    every: int = 20,
    recall: float = 0.97,
    sample_rows: int = 4096,
    tables: int = 4,
    planes: tuple[int, ...] = (4, 5, 6, 8),
    width: float = 2.5,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by ``every``.

    All rows are indexed and are candidates; only the numbers of planes (one of ``planes``) and probes are fitted, on at
    most ``sample_rows`` vectors.
    A query that meets fewer than k rows is ranked against all rows, so it gets k of them, or all if there are fewer.
    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an id,
    nor vectors of another length than most have (the longer of two equally frequent ones). Rows of one vec_id count
    as one, with the largest of their inner products. Score ties go to the smaller vec_id. Extra columns are ignored; no
    usable rows give an empty result.

    A cell of any size is cut into blocks of about ``BASE_ROWS`` rows and ``PROBE_ROWS`` visits, and each pair of
    blocks is one unit of work; a task keeps the k best of each query over all its units.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("longest"))
    common = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = common["dim"]
    rows = rows.where(F.size("v") == dim)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").collect()
    sample = np.array([r["v"] for r in sample], dtype=np.float64)
    index, probes = fitted_index(sample, common["n"], common["longest"], planes, k, recall, tables=tables, width=width)

    def keyed(asked: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for low in range(0, whole.num_rows, 128 if asked else 4096):
                    batch = whole.slice(low, 128 if asked else 4096)
                    x = _matrix(batch.column("v"), dim)
                    keys = index.probe_keys(x, probes) if asked else index.base_keys(x)
                    keys = np.sort(keys.reshape(len(x), -1), axis=1)
                    once = np.ones(keys.shape, dtype=bool)  # a cell that is visited twice counts once
                    once[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    bounds = np.concatenate(([0], np.cumsum(once.sum(axis=1))))
                    cells = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys[once], pa.int64()))
                    yield pa.RecordBatch.from_pydict({"id": batch.column("vec_id"), "v": batch.column("v"), "cells": cells})

        return run

    kind = rows.schema["v"].dataType.simpleString()

    def indexed(side: DataFrame, asked: bool) -> DataFrame:
        """id, v, cells, row: one written row per vector, with a number, since ids may repeat."""
        found = side.mapInArrow(keyed(asked), f"id long, v {kind}, cells array<long>")
        return cut_lineage(found.withColumn("row", F.monotonically_increasing_id()))

    base, visits = indexed(rows, False), indexed(rows.where(F.col("vec_id") % every == 0), True)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(k)
        at, b_ids, b = None, [], []
        for batch in batches:
            cell, i, j = (batch.column(c).to_numpy() for c in ("cell", "i", "j"))
            visit = batch.column("visit").to_numpy(zero_copy_only=False)
            ids, x = batch.column("id").to_numpy(), _matrix(batch.column("v"), dim)
            change = np.ones(len(ids), dtype=bool)
            change[1:] = (np.diff(cell) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0) | (visit[1:] != visit[:-1])
            starts = np.flatnonzero(change)
            for a, z in zip(starts, np.append(starts[1:], len(ids)), strict=True):
                unit = (cell[a], i[a], j[a])
                if unit != at:
                    at, b_ids, b = unit, [], []
                if not visit[a]:
                    b_ids.append(ids[a:z])
                    b.append(x[a:z])
                elif b:
                    ranker.add(ids[a:z], x[a:z], np.concatenate(b_ids), np.concatenate(b))
        query, vec, score = ranker.settle()
        yield pa.RecordBatch.from_arrays(
            [pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())],
            names=["query_id", "vec_id", "score"],
        )

    def ranked(base: DataFrame, visits: DataFrame) -> DataFrame:
        """query_id, vec_id, score, rank: the k best of each query among the rows of the cells it visits."""
        keys = {side: side.select("row", F.explode("cells").alias("cell")) for side in (base, visits)}
        met = keys[base].groupBy("cell").agg(F.count("*").alias("n")).join(
            keys[visits].groupBy("cell").agg(F.count("*").alias("m")), "cell"
        )
        blocks = cut_lineage(
            met.select(
                F.col("cell").alias("c"),
                F.ceil(F.col("n") / BASE_ROWS).cast("int").alias("base_blocks"),
                F.ceil(F.col("m") / PROBE_ROWS).cast("int").alias("visit_blocks"),
            )
        )

        def units(side: DataFrame, own: str, other: str, visit: bool) -> DataFrame:
            mine = F.pmod(F.xxhash64("row"), F.col(own)).cast("int").alias("mine")
            placed = keys[side].join(blocks, F.col("cell") == F.col("c")).select("row", "cell", mine, other)
            placed = placed.join(side.select("row", "id", "v"), "row")
            theirs = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("theirs")
            placed = placed.select("cell", "id", "v", "mine", theirs)
            i, j = ("theirs", "mine") if visit else ("mine", "theirs")
            return placed.select("cell", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(visit).alias("visit"), "id", "v")

        both = units(base, "base_blocks", "visit_blocks", False).union(units(visits, "visit_blocks", "base_blocks", True))
        both = both.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "visit")
        found = both.mapInArrow(rank, "query_id long, vec_id long, score double")
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    found = cut_lineage(ranked(base, visits))
    wanted = min(k, rows.select("vec_id").distinct().limit(k + 1).count() - 1)
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= wanted).select("query_id")
    short = cut_lineage(visits.join(full, F.col("id") == F.col("query_id"), "left_anti"))
    if wanted and not short.isEmpty():
        one_cell = F.array(F.lit(0).cast("long"))
        exact = ranked(base.withColumn("cells", one_cell), short.withColumn("cells", one_cell))
        found = found.join(full, "query_id", "left_semi").unionByName(exact)
    return found.select("query_id", "rank", "vec_id", "score")

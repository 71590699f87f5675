"""Toxicity with a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.llm.words import NgramHasher, normal_bytes
from careflow.session import cut_lineage

BITS = 22
FOLDS = 5


@dataclass
class Machine:
    """score = sigmoid(bias + sum w_i + sum over pairs <v_i, v_j>) over the terms of a text that the machine knows."""

    terms: np.ndarray  # sorted hashed terms
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, terms: np.ndarray) -> float:
        at = np.searchsorted(self.terms, terms)
        at = at[at < len(self.terms)] if not len(self.terms) else np.minimum(at, len(self.terms) - 1)
        at = at[self.terms[at] == terms] if len(self.terms) else at
        v = self.factors[at]
        total = v.sum(axis=0)
        z = self.bias + self.weights[at].sum() + 0.5 * float((total * total).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def hashed_terms(hasher: NgramHasher, text: str | None) -> np.ndarray:
    """The distinct words of a whole text as hashed terms of ``BITS`` bits."""
    return np.unique(hasher(normal_bytes(text)) >> np.uint64(64 - BITS)).astype(np.int64)


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = 0) -> Column:
    """True where crc32(doc_id as text) mod ``folds`` is ``fold``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, max_terms: int) -> list:
    """(toxic, hashed terms) of at most ``max_rows`` labelled documents with ``max_terms`` terms, outside the held-out fold.

    The rows with the smallest hashes are taken, so the sample does not depend on partitions; repeated
    rows of an id count once. Only the sample is collected, and its two bounds are checked in Spark before.
    """
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select(F.col("doc_id").alias("l_id"), (F.col("toxic") > 0).cast("int").alias("y")).distinct()
    rows = rows.orderBy(F.xxhash64("l_id"), "l_id", "y").limit(max_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("l_id")).select("l_id", "y", "text")

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = NgramHasher(1)
        for part in batches:
            packed = [hashed_terms(hasher, t).astype("<i4").tobytes() for t in part["text"]]
            yield pd.DataFrame({"l_id": part["l_id"], "y": part["y"], "terms": packed})

    ids = rows.schema["l_id"].dataType.simpleString()
    packed = cut_lineage(found.mapInPandas(terms, f"l_id {ids}, y int, terms binary").dropDuplicates())
    rank = F.struct(F.xxhash64("l_id", "terms").alias("hash"), F.col("y").alias("label"))
    sizes = packed.select(rank.alias("rank"), (F.octet_length("terms") / 4).cast("long").alias("n"))
    sizes = sizes.orderBy("rank").limit(max_rows).collect()
    total, last = 0, None
    for row in sizes:
        total += row["n"]
        if last is not None and total > max_terms:
            break
        last = row["rank"]
    if last is None:
        return []
    upto = F.struct(F.lit(last["hash"]).alias("hash"), F.lit(last["label"]).alias("label"))
    return packed.where(rank <= upto).orderBy(rank).limit(max_rows).select("y", "terms").collect()


def _train(
    sets: list[np.ndarray], y: np.ndarray, size: int, rank: int, epochs: int, sparse: float, rng: np.random.Generator, batch: int = 128
) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors of ``size`` terms by AdaGrad on the logistic loss, touching the terms of a batch only.

    ``sparse`` shrinks weights (lasso) and whole rows of factors (group lasso) to 0 unless they help.
    """
    rate = y.mean()
    w, v, b = np.zeros(size), rng.normal(0, 0.02, (size, rank)), float(np.log(rate / (1 - rate)))
    gw, gv = np.full(size, 1e-6), np.full((size, 1), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            chosen = order[at : at + batch]
            row = np.repeat(np.arange(len(chosen)), [len(sets[d]) for d in chosen])
            known, code = np.unique(np.concatenate([sets[d] for d in chosen]), return_inverse=True)
            x = np.zeros((len(chosen), len(known)), np.float32)
            x[row, code] = 1
            own_w, own_v = w[known], v[known]
            s = x @ own_v.astype(np.float32)
            z = b + x @ own_w + 0.5 * ((s * s).sum(1) - x @ (own_v * own_v).sum(1))
            e = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[chosen]) / len(chosen)).astype(np.float32)
            dw = (x.T @ e).astype(float)
            dv = (x.T @ (e[:, None] * s)).astype(float) - dw[:, None] * own_v
            gw[known] += dw * dw
            gv[known] += (dv * dv).mean(1, keepdims=True)
            step_w, step_v = 0.2 / np.sqrt(gw[known]), 0.1 / np.sqrt(gv[known])
            new_w, new_v = own_w - step_w * dw, own_v - step_v * dv
            length = np.sqrt((new_v * new_v).sum(1, keepdims=True)) + 1e-12
            w[known] = np.sign(new_w) * np.maximum(0, np.abs(new_w) - step_w * sparse)
            v[known] = new_v * np.maximum(0, 1 - step_v * 5 * sparse / length)
            b -= 0.05 * float(e.sum())
    return b, w, v


def fit(rows: list, rank: int = 8, epochs: int = 20, least_docs: int = 5, least_share: float = 0.005, seed: int = 5) -> Machine:
    """A machine over all terms that at least ``least_docs`` rows and this share of them hold, however they go with the label.

    Rarer terms (but of ``least_docs`` rows) are added where their presence alone goes with the label (chi-square).
    A first machine with a lasso on weights and a group lasso on factors sets most terms to 0, but none that tells alone
    or in pairs; a second one is fitted without lasso on the rest.
    """
    y = np.array([r[0] for r in rows], dtype=np.float64)
    sets = [np.frombuffer(r[1], dtype="<i4") for r in rows]
    none = Machine(np.empty(0, np.int64), -30.0, np.empty(0), np.empty((0, rank)))
    if not len(y) or y.sum() == 0:
        return none
    if y.sum() == len(y):
        none.bias = 30.0
        return none
    terms, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    df = np.bincount(code, minlength=len(terms)).astype(float)
    hit = np.bincount(code, weights=y[owner], minlength=len(terms))
    n, rate = len(y), y.mean()
    expected = df * rate
    chi = (hit - expected) ** 2 / (expected * (1 - rate) * (1 - df / n) + 1e-9)
    usable = (df >= least_docs) & ((df >= least_share * n) | (chi >= 15))
    rng = np.random.default_rng(seed)
    b, w, v = none.bias, none.weights, none.factors
    for sparse in (2e-3, 1e-4):  # the second one hardly shrinks what is left
        terms = terms[usable]
        known = [np.searchsorted(terms, s[np.isin(s, terms, assume_unique=True)]) for s in sets]
        b, w, v = _train(known, y, len(terms), rank, epochs, sparse, rng)
        usable = (w != 0) | v.any(axis=1)
    return Machine(terms.astype(np.int64), b, w, v)


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_terms: int = 8_000_000):
    """A column function: text -> score in [0, 1].

    Fitted on at most ``max_rows`` labelled documents with ``max_terms`` terms outside the held-out fold (see
    ``training_rows``); whole texts are scored. Null and empty texts have no terms and get the score of the bias. Repeated
    rows are scored each and learned from once; an empty table has no scores, and without documents to learn from all are
    near 0. Other columns are ignored. Without labels, or with none that is
    toxic, every score is near 0; labels of unknown documents and null labels are ignored; a document with both labels
    counts as two rows. Id, language, source and labels are no input of a score.
    """
    machine = fit(training_rows(docs, labels, max_rows, max_terms))
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher, known = NgramHasher(1), sent.value
        for texts in batches:
            yield pd.Series([known.score(hashed_terms(hasher, t)) for t in texts], dtype="float64")

    return F.pandas_udf(scores, "double")

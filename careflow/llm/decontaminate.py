"""Benchmark decontamination with an Aho-Corasick automaton over the windows of the benchmark's words."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow.llm.words import normal_bytes
from careflow.session import cut_lineage

#: A word in a text before A-Z are lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
HITS = "array<struct<first:int,last:int,item_ids:array<string>>>"
RESULT = f"n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans {HITS}"
_built: dict[str, ahocorasick.Automaton] = {}

Hit = tuple[int, int, tuple[str | None, ...]]


def windows(text: str | None, length: int) -> list[str]:
    """Every run of ``length`` words of an item, or the whole item if it is shorter; each with a space on both sides."""
    words = normal_bytes(text).decode("latin-1").split(" ")
    if words == [""]:
        return []
    last = max(len(words) - length, 0)
    return [f" {' '.join(words[i : i + length])} " for i in range(last + 1)]


def grouped_items(benchmark: DataFrame, max_chars: int) -> tuple[DataFrame, int]:
    """Distinct items (item_id, text, group) and the number of groups: as few as hold ``max_chars`` characters each on average.

    Characters are counted and groups assigned, by hash, in Spark.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(1, -(-chars // max_chars))
    return items.withColumn("group", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups))), groups


def automaton(items: Iterable[tuple[str | None, str]], length: int, key: str) -> ahocorasick.Automaton | None:
    """The automaton of all windows of ``items`` (id, text), built once per Python worker; None without any window."""
    if key not in _built:
        _built.clear()  # a pass over the documents needs one only
        patterns: dict[str, dict[str | None, None]] = {}
        for name, text in items:
            for w in windows(text, length):
                patterns.setdefault(w, {})[name] = None
        found = ahocorasick.Automaton()
        for w, names in patterns.items():
            found.add_word(w, (w.count(" ") - 1, tuple(sorted(names, key=lambda s: (s is not None, s or "")))))
        if patterns:
            found.make_automaton()
        _built[key] = found if patterns else None
    return _built[key]


def scan(text: str | None, machine: ahocorasick.Automaton | None) -> tuple[int, list[Hit]]:
    """Number of words, and (first word, last word, items) of each occurrence, in one pass over the text."""
    normal = normal_bytes(text)
    if not normal:
        return 0, []
    line = f" {normal.decode('latin-1')} "
    n = normal.count(b" ") + 1
    if machine is None:
        return n, []
    hits = list(machine.iter(line))
    if not hits:
        return n, []
    ends = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)[1:]  # the space behind each word
    at = np.searchsorted(ends, [e for e, _ in hits])
    return n, [(int(k) - length + 1, int(k), items) for k, (_, (length, items)) in zip(at, hits, strict=True)]


def summary(n: int, hits: list[Hit]) -> tuple:
    edge = np.zeros(n + 1, dtype=np.int64)
    for first, last, _ in hits:
        edge[first] += 1
        edge[last + 1] -= 1
    n_hit = int((np.cumsum(edge[:n]) > 0).sum()) if hits else 0
    items = {i for *_, ids in hits for i in ids}
    names = sorted((i for i in items if i is not None), key=lambda s: s.encode())
    digest = hashlib.sha256(",".join(names).encode()).hexdigest()
    return n, n_hit, len(items), digest, n_hit > 0


def char_spans(text: str, hits: list[Hit]) -> list[tuple[int, int, list[str | None]]]:
    """The occurrences as character offsets (first, last + 1) in the text as it was given."""
    if not hits:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    return [(places[a][0], places[b][1], list(items)) for a, b, items in hits]


def _measured(texts: Iterable[str | None], counts: Iterable[int], hits: Iterable[list[Hit]]) -> pd.DataFrame:
    rows = []
    for text, n, found in zip(texts, counts, hits, strict=True):
        found = sorted(found, key=lambda h: h[:2])
        rows.append((*summary(n, found), char_spans(text, found)))
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
    return pd.DataFrame(rows, columns=names).astype({"items_sha256": "object"})


def measuring(items: Callable[[], Iterable], length: int, key: str):
    """Batches of texts -> batches of results, with all items in one automaton."""

    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            machine = automaton(items(), length, key)
            scanned = [scan(t, machine) for t in texts]
            yield _measured(texts, (n for n, _ in scanned), (h for _, h in scanned))

    return measure


def finding(items: Callable[[], Iterable], length: int, key: str):
    """Batches of texts -> batches of the occurrences in them, as words."""

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            machine = automaton(items(), length, key)
            yield pd.Series([[(a, b, list(ids)) for a, b, ids in scan(t, machine)[1]] for t in texts], dtype="object")

    return find


def summing(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Batches of texts and their occurrences -> batches of results."""
    for texts, found in batches:
        hits = [[(h["first"], h["last"], tuple(h["item_ids"])) for h in ([] if row is None else row)] for row in found]
        yield _measured(texts, (scan(t, None)[0] for t in texts), hits)


def with_overlap(docs: DataFrame, benchmark: DataFrame, name: str, length: int = 10, max_chars: int = 4_000_000) -> DataFrame:
    """``docs`` with a struct ``name``: n_words, n_hit, n_items, items_sha256, contaminated, spans of each row's text.

    Each whole text is normalised and scanned by one automaton. Only a benchmark of more than ``max_chars`` characters is
    split, into groups of about that size: each has an automaton of its own and a pass of its own over the documents, and
    the occurrences are joined by the digest of the text. So the driver and a worker hold one group's texts and automaton
    at a time (or one longer item); the number of items and the documents are unbounded.

    A null or empty text has no words and no hits; items with null text or without words have no windows; an item without an
    id counts as one item, and is no part of ``items_sha256``; repeated items count once per id, repeated documents each.
    Without items, or with an empty ``docs``, nothing is hit. ``spans`` holds the occurrences as offsets in the original
    text. Other columns pass through; one that is called ``name`` is replaced.
    """
    spark = docs.sparkSession
    items, groups = grouped_items(benchmark, max_chars)

    def sent(rows: DataFrame):
        return spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows.select("item_id", "text").collect()])

    if groups == 1:
        all_items = sent(items)
        measure = measuring(lambda: all_items.value, length, uuid.uuid4().hex)
        return docs.withColumn(name, F.pandas_udf(measure, RESULT)("text"))
    items, passes = cut_lineage(items), []
    for number in range(groups):
        group = sent(items.where(F.col("group") == number))
        find = F.pandas_udf(finding(lambda group=group: group.value, length, uuid.uuid4().hex), HITS)
        found = docs.where("text is not null").select(F.sha2("text", 256).alias("digest_"), find("text").alias("hits_"))
        # all rows of a text have the same hits; the written rows are few and small
        passes.append(cut_lineage(found.where(F.size("hits_") > 0).dropDuplicates(["digest_"])))
        group.unpersist()
    every = reduce(DataFrame.unionByName, passes)
    every = every.groupBy("digest_").agg(F.flatten(F.collect_list("hits_")).alias("hits_"))  # one per group
    joined = docs.join(every, F.sha2(docs["text"], 256) == F.col("digest_"), "left")
    measured = joined.withColumn(name, F.pandas_udf(summing, RESULT)("text", "hits_"))
    return measured.drop("digest_", "hits_")

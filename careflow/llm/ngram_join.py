"""Self-join of documents by the Jaccard similarity of their word n-gram sets, with MinHash banding.

Documents with the same n-gram set form one class before anything is compared. Each class gets ``bands`` band hashes
from ``bands * rows`` minima; classes that share a band hash are candidates, and every candidate pair is verified on
the full sets. A bucket of any size is cut into blocks of bounded size, and each pair of blocks is one unit of work,
whose similarities come from one matrix product; it returns one row per class with counts, never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow.llm.rows import rows_of, text_hash
from careflow.llm.words import NgramHasher, mix, normal_bytes
from careflow.session import cut_lineage

BLOCK_CLASSES = 1024  # at most about so many classes, and so many n-grams, in a block
BLOCK_NGRAMS = 500_000


def banding(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds a pair at the threshold with the wanted probability.

    A pair of similarity s shares a band with probability 1 - (1 - s**rows)**bands. More rows mean fewer false
    candidates; the bands follow from the recall, and the number of hashes bounds both.
    """
    best = (1, 1)
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


class Signer:
    """Set of n-grams, its key and its band hashes for one text."""

    def __init__(self, n: int, bands: int, rows: int):
        self.hasher, self.bands, self.rows = NgramHasher(n), bands, rows
        rng = np.random.default_rng(411)
        self.a = (rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        self.b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)[:, None]
        self.salt = np.arange(1, bands + 1, dtype=np.uint64)

    def grams(self, text: str | None) -> np.ndarray:
        return self.hasher(normal_bytes(text))

    def band_hashes(self, grams: np.ndarray) -> np.ndarray:
        if not len(grams):
            return np.empty(0, dtype=np.int64)
        low = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(grams), 8192):  # bounded memory for very long texts
            low = np.minimum(low, (self.a * grams[at : at + 8192] + self.b).min(axis=1))
        out = self.salt.copy()
        for column in low.reshape(self.bands, self.rows).T:
            out = mix(out ^ column)
        return out.view(np.int64)


def set_key(grams: np.ndarray) -> bytes:
    return hashlib.md5(grams.tobytes()).digest()


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, set_key, n_grams, bands: one narrow row per document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(n, bands, rows)
        for batch in batches:
            keys, sizes, hashes = [], [], []
            for text in batch.column("text"):
                grams = signer.grams(text.as_py())
                keys.append(set_key(grams))
                sizes.append(len(grams))
                hashes.append(signer.band_hashes(grams))
            offsets = np.concatenate(([0], np.cumsum([len(h) for h in hashes]))).astype(np.int32)
            flat = pa.array(np.concatenate(hashes) if hashes else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(keys, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat),
                ],
                names=["doc_id", "text_hash", "set_key", "n_grams", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_hash().alias("text_hash"), "text").mapInArrow(
        sign, f"doc_id {kind}, text_hash long, set_key binary, n_grams long, bands array<long>"
    )


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold; n-grams of only one set do not enter the products."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if m == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        common = np.array([[0, both], [both, 0]])
    else:
        owner = np.repeat(np.arange(m), sizes)
        _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1
        number = np.cumsum(shared) - 1
        keep = shared[code]
        owner, code = owner[keep], number[code[keep]]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        common = np.zeros((m, m), dtype=np.float32)
        total, step = int(shared.sum()), 2048
        for low in range(0, total, step):
            a, b = np.searchsorted(code, (low, low + step))
            part = np.zeros((m, min(step, total - low)), dtype=np.float32)
            part[owner[a:b], code[a:b] - low] = 1
            common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    out = common >= threshold * union - 1e-9
    np.fill_diagonal(out, False)
    return out


def _local_roots(links: np.ndarray, keys: list[bytes]) -> list[bytes]:
    """Smallest key of each member's component inside one unit of work."""
    root = np.full(len(keys), -1)
    for start in sorted(range(len(keys)), key=keys.__getitem__):
        if root[start] >= 0:
            continue
        root[start] = start
        front = np.array([start])
        while len(front):
            reached = links[front].any(axis=0) & (root < 0)
            front = np.flatnonzero(reached)
            root[front] = start
    return [keys[r] for r in root]


def _verify(n: int, threshold: float, rows: list[dict]) -> list[tuple]:
    """(set_key, root, number of linked classes, their documents) of one pair of blocks of one bucket."""
    hasher = NgramHasher(n)
    members, seen = [], set()
    for row in rows:  # a repeated id can bring a text that is not the class's
        key = row["set_key"]
        if key in seen:
            continue
        grams = hasher(normal_bytes(row["text"]))
        if set_key(grams) == key:
            seen.add(key)
            members.append((row, grams))
    if len(members) < 2:
        return []
    links = similar([g for _, g in members], threshold)
    this = rows[0]["bucket"]
    if rows[0]["i"] != rows[0]["j"]:
        block = np.array([r["block"] for r, _ in members])
        links &= block[:, None] != block[None, :]
    a, b = np.nonzero(np.triu(links))
    if not len(a):
        return []
    own = [set(r["buckets"]) for r, _ in members]
    # a pair that meets in several buckets belongs to the smallest of them
    mine = np.array([min(own[x] & own[y]) == this for x, y in zip(a, b, strict=True)])
    counted = np.zeros_like(links)
    counted[a[mine], b[mine]] = True
    counted |= counted.T
    docs = np.array([r["n_docs"] for r, _ in members], dtype=np.int64)
    keys = [r["set_key"] for r, _ in members]
    roots = _local_roots(counted, keys)
    number = counted.sum(axis=1)
    weight = counted.astype(np.int64) @ docs
    return [
        (k, r, int(c), int(w)) for k, r, c, w in zip(keys, roots, number, weight, strict=True) if c
    ]


def _by_bucket(n: int, threshold: float):
    names = ("set_key", "root", "class_links", "doc_links")
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=list(names)
            )

        unit, at, out = [], None, []
        for b in batches:
            for row in b.to_pylist():
                key = (row["bucket"], row["i"], row["j"])
                if key != at:
                    out += _verify(n, threshold, unit) if len(unit) > 1 else []
                    unit, at = [], key
                    if len(out) >= 10_000:
                        yield batch(out)
                        out = []
                unit.append(row)
        out += _verify(n, threshold, unit) if len(unit) > 1 else []
        yield batch(out)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, from (node, root) edges, by alternating star steps.

    Minima are aggregated before they are joined back, so a node with very many neighbours is one aggregated row and
    a join key that adaptive execution can split. Each round is written, and the rounds end when nothing changes.
    """
    stars = cut_lineage(edges.where("node > root").select("node", "root").distinct())
    before = None
    while True:
        both = stars.union(stars.select("root", "node"))
        low = both.groupBy("node").agg(F.min("root").alias("low"))
        low = low.select(F.col("node").alias("at"), F.least("node", "low").alias("low"))
        large = both.join(low, F.col("node") == F.col("at")).where("root > node")
        large = large.select(F.col("root").alias("node"), F.col("low").alias("root")).distinct()
        low = large.groupBy(F.col("node").alias("at")).agg(F.min("root").alias("low"))
        small = large.join(low, F.col("node") == F.col("at"))
        small = small.select("root", "low").where("root > low").union(low.select("at", "low"))
        stars = cut_lineage(small.toDF("node", "root").distinct())
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "root"))).first()
        if now == before:
            return stars
        before = now


def class_texts(docs: DataFrame, signed: DataFrame, met: DataFrame) -> DataFrame:
    """set_key, n_docs, met, text: one row per class of ``met``, also where its id and text are in many rows."""
    texts = docs.select("doc_id", text_hash().alias("text_hash"), "text")
    texts = texts.join(met, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
    texts = texts.select("set_key", "n_docs", "met", "text")
    repeated = signed.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    # two texts of one id and hash both stay: the one that is not the class's is dropped when it is verified
    return texts if repeated.isEmpty() else texts.distinct()


def ngram_links(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, most_hashes: int = 64
) -> tuple[DataFrame, DataFrame]:
    """(signatures, facts per class): the written signatures, and set_key, copy_id, n_docs, links and group of each class.

    ``group`` is the component of linked classes. A pair at the threshold itself is found with probability ``recall``,
    a closer one more often; what is found is exact.
    """
    bands, rows = banding(threshold, recall, most_hashes)
    signed = cut_lineage(signatures(docs, n, bands, rows))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    classes = cut_lineage(
        signed.groupBy("set_key").agg(
            first.alias("first"),
            F.count("*").alias("n_docs"),
            F.any_value("n_grams").alias("n_grams"),
            F.any_value("bands").alias("bands"),
        )
    )
    slots = classes.select("set_key", "n_grams", F.posexplode("bands").alias("band", "hash"))
    buckets = slots.groupBy("band", "hash").agg(
        F.count("*").alias("n"),
        F.sum("n_grams").alias("grams"),
        F.bit_xor(F.xxhash64("set_key")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "set_key")).alias("y"),
    )
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_CLASSES, F.col("grams") / BLOCK_NGRAMS))
    # buckets with the same members are one bucket
    buckets = buckets.where("n > 1").select(
        "band", "hash", F.xxhash64("x", "y", "n").alias("bucket"), blocks.cast("int").alias("blocks")
    )
    met = slots.join(buckets, ["band", "hash"]).groupBy("set_key").agg(
        F.collect_set(F.struct("bucket", "blocks")).alias("met")  # at most one per band
    )
    met = cut_lineage(
        classes.drop("bands", "n_grams")
        .join(met, "set_key")
        .select("set_key", F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash"), "n_docs", "met")
    )
    units = class_texts(docs, signed, met).select("set_key", "n_docs", "text", F.col("met.bucket").alias("buckets"), F.explode("met").alias("m"))
    block = F.pmod(F.xxhash64("set_key", "m.bucket"), F.col("m.blocks")).cast("int")
    units = units.select("set_key", "n_docs", "text", "buckets", "m.bucket", "m.blocks", block.alias("block"))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        "block",
        "set_key",
        "n_docs",
        "buckets",
        "text",
    )
    units = units.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = cut_lineage(
        units.mapInArrow(_by_bucket(n, threshold), "set_key binary, root binary, class_links long, doc_links long")
    )
    links = found.groupBy("set_key").agg(F.sum("class_links").alias("class_links"), F.sum("doc_links").alias("doc_links"))
    roots = components(found.select(F.col("set_key").alias("node"), "root")).toDF("set_key", "root")
    facts = classes.drop("bands", "n_grams").join(links, "set_key", "left").join(roots, "set_key", "left")
    facts = facts.withColumn("root", F.coalesce("root", "set_key"))
    groups = facts.groupBy("root").agg(F.min("first").alias("group"))
    return signed, facts.join(groups, "root").select(
        "set_key",
        "first",
        "group",
        "n_docs",
        F.coalesce("class_links", F.lit(0)).cast("long").alias("class_links"),
        (F.coalesce("doc_links", F.lit(0)) + F.col("n_docs") - 1).cast("long").alias("doc_links"),
    )


def ngram_jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """One row per document: doc_id, class_id, copy_id, n_links, n_class_links.

    ``copy_id`` is the smallest doc_id with the same n-gram set, ``class_id`` the smallest in the component of linked
    documents, ``n_links`` the number of other documents at the threshold or above (copies included), and
    ``n_class_links`` the number of linked classes other than its own. Texts of fewer than ``n`` words have one n-gram,
    all their words. Texts without words (null, empty, punctuation only) are copies of each other and linked to nothing
    else. Null ids take part and sort last, so an id is null only where all are. Repeated rows are copies; other columns
    are ignored; an empty table gives an empty result.
    """
    signed, facts = ngram_links(docs, n, threshold, recall)
    return signed.select("doc_id", "set_key").join(facts, "set_key").select(
        "doc_id",
        F.col("group.doc_id").alias("class_id"),
        F.col("first.doc_id").alias("copy_id"),
        F.col("doc_links").alias("n_links"),
        F.col("class_links").alias("n_class_links"),
    )


def one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """``docs`` with one document of each component: its smallest id, nulls last; of equal rows any one, whole.

    Nulls, short texts and repeated rows are treated as in ``ngram_jaccard_join``; all columns are kept.
    """
    signed, facts = ngram_links(docs, n, threshold, recall)
    groups = facts.select(F.col("group.doc_id").alias("k_id"), F.col("group.text_hash").alias("k_hash")).distinct()
    counts = signed.groupBy(F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash")).agg(
        F.count("*").alias("k_rows")
    )
    kept = counts.join(
        groups, F.col("s_id").eqNullSafe(F.col("k_id")) & (F.col("s_hash") == F.col("k_hash"))
    ).select("k_id", "k_hash", "k_rows")
    return rows_of(docs, cut_lineage(kept)).select("row.*")

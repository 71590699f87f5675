"""Token ids in a binary format: canonical length-limited Huffman codes in independent blocks with checkpoints.

A file set in a folder that all executors share:

``blocks``   one row per block, in folders ``shard=0``, ``shard=1``, ... that follow ascending doc_id: ``start`` (ids in
             all blocks before; blocks follow each other by it), ``doc_ids``, ``doc_sizes`` (ids of each document, end id included), ``bits`` (the codes,
             highest bit first) and ``marks`` (bit offset of every 128th id, 32-bit little endian).
``codebook`` ``id`` and ``length``; canonical codes follow from them: by length, then by id.

A block holds whole documents and is closed at 32,768 ids or more. Marks let a reader start at any of them; the decoder
runs all marks of many blocks side by side, one table look-up per id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from careflow.llm.tokens import encoder, tokenizer_path
from careflow.session import cut_lineage, scratch_folder

LIMIT = 16  # longest code in bits; a table of 2**LIMIT entries decodes
BLOCK_IDS = 32_768
MARK_EVERY = 128
DECODE_IDS = 1_000_000
TEXT_BYTES = 8 << 20  # read at once in a task


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by package-merge. A single symbol gets one bit."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, dtype=np.uint8)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.float64)
    levels = []  # of each level: the merged order, True where an entry is a package
    packages = np.empty(0)
    for _ in range(limit):
        both = np.concatenate((leaf, packages))
        at = np.argsort(both, kind="stable")
        levels.append(at >= n)
        merged = both[at]
        merged = merged[: len(merged) // 2 * 2]
        packages = merged[0::2] + merged[1::2]
    lengths = np.zeros(n, dtype=np.uint8)
    take = 2 * n - 2
    for is_package in reversed(levels):
        taken = int(is_package[:take].sum())
        lengths[: take - taken] += 1  # the cheapest leaves of this level
        take = 2 * taken
    out = np.empty(n, dtype=np.uint8)
    out[order] = lengths
    return out


def canonical_codes(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The code of each id: shorter first, then smaller ids."""
    order = np.lexsort((ids, lengths))
    codes = np.zeros(len(ids), dtype=np.uint32)
    if len(ids):
        width = lengths[order].astype(np.int64)
        step = np.int64(1) << (LIMIT - width)
        codes[order] = (np.cumsum(step) - step) >> (LIMIT - width)
    return codes


class Codebook:
    """Tables of both directions from ids and their code lengths."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        codes = canonical_codes(ids, lengths)
        size = int(ids.max()) + 1 if len(ids) else 1
        self.code = np.zeros(size, dtype=np.uint32)
        self.length = np.zeros(size, dtype=np.uint8)
        self.code[ids], self.length[ids] = codes, lengths
        self.symbol = np.zeros(1 << LIMIT, dtype=np.uint32)
        self.width = np.ones(1 << LIMIT, dtype=np.uint8)
        order = np.lexsort((ids, lengths))
        filled = np.repeat(order, 1 << (LIMIT - lengths[order].astype(np.int64)))
        self.symbol[: len(filled)], self.width[: len(filled)] = ids[filled], lengths[filled]

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(bits, marks)."""
        width = self.length[ids].astype(np.int64)
        ends = np.cumsum(width)
        at = ends - width
        value = self.code[ids].astype(np.int64) << (24 - width - (at & 7))
        place, size = at >> 3, int(ends[-1] + 7 >> 3) + 3 if len(ids) else 3
        out = np.zeros(size, dtype=np.int64)
        for k, shift in enumerate((16, 8, 0)):  # the bits of different codes never overlap, so adding them is exact
            out += np.bincount(place + k, weights=(value >> shift) & 255, minlength=size).astype(np.int64)
        return out.astype(np.uint8).tobytes(), at[::MARK_EVERY].astype("<u4").tobytes()

    def decode(self, blocks: list[tuple[bytes, bytes, int]]) -> np.ndarray:
        """Ids of all blocks in a row; blocks are (bits, marks, number of ids)."""
        raw = np.frombuffer(b"".join(b for b, *_ in blocks) + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
        shift = np.cumsum([0] + [len(b) for b, *_ in blocks])[:-1] * 8
        at = np.concatenate([np.frombuffer(m, "<u4").astype(np.int64) + s for (_, m, _), s in zip(blocks, shift, strict=True)])
        lanes = [len(m) // 4 for _, m, _ in blocks]
        left = np.full(len(at), MARK_EVERY, dtype=np.int64)
        for lane, (_, _, n) in zip(np.cumsum(lanes), blocks, strict=True):
            if n:
                left[lane - 1] = (n - 1) % MARK_EVERY + 1
        out = np.zeros((MARK_EVERY, len(at)), dtype=np.uint32)
        for k in range(MARK_EVERY):
            byte = at >> 3
            window = raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]
            window = window >> (24 - LIMIT - (at & 7)).astype(np.uint32) & ((1 << LIMIT) - 1)
            out[k] = self.symbol[window]
            at = np.where(k + 1 < left, at + self.width[window], at)
        return out.T[np.arange(MARK_EVERY) < left[:, None]]


def _pieces(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` bytes of a column, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, low = np.cumsum(sizes, dtype=np.int64), 0
    while low < batch.num_rows:
        base = ends[low] - sizes[low]
        high = max(low + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(low, high - low)
        low = high


def _binary(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value for each run of ``flat`` between two bounds."""
    ends = (bounds * flat.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def _tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """shard, before, doc_id, n, width, ids: written once, in ascending doc_id order, nulls first.

    A shard is a range of ids; ``before`` counts the ids in front of a document in its shard, so that any later split of
    the files still knows where it stands. ``ids`` are little endian, of ``width`` bytes each. Rows of equal id and text
    are told apart by the number of their row, so that any number of them is split over shards; ``docs`` must give its
    rows in the same order when a lost part is read again, as files do.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, done = encoder(path), 0
        for whole in batches:
            for batch in _pieces(whole, "text", TEXT_BYTES):
                ids, sizes = encode(batch.column("text"))
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                ids = np.insert(ids, bounds[1:], end_id)
                ids = ids.astype("<u2" if ids.max() < 65536 else "<u4")
                bounds += np.arange(len(bounds))
                columns = {
                    "before": pa.array(bounds[:-1] + done, pa.int64()),
                    "doc_id": batch.column("doc_id"),
                    "n": pa.array(sizes + 1, pa.int64()),
                    "width": pa.array(np.full(len(sizes), ids.itemsize), pa.int32()),
                    "ids": _binary(ids, bounds),
                }
                done += len(ids)
                yield pa.RecordBatch.from_pydict(columns)

    order = ["doc_id", "text_hash", "tie"]
    tie = F.monotonically_increasing_id().alias("tie")
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), tie)
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    tokenized = ordered.mapInArrow(run, f"before long, doc_id {kind}, n long, width int, ids binary")
    return cut_lineage(tokenized.withColumn("shard", F.spark_partition_id()))


def _ids(packed: bytes, width: int) -> np.ndarray:
    return np.frombuffer(packed, dtype="<u2" if width == 2 else "<u4")


def _counted(tokenized: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Global counts by id; at most one row per entry of the vocabulary comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for packed, width in zip(batch.column("ids"), batch.column("width"), strict=True):
                found = np.bincount(_ids(packed.as_py(), width.as_py()))
                if len(found) > len(total):
                    total = np.concatenate((total, np.zeros(len(found) - len(total), dtype=np.int64)))
                total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    counts = tokenized.select("ids", "width").mapInArrow(run, "id long, n long")
    rows = counts.groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()
    return np.array([r["id"] for r in rows], dtype=np.int64), np.array([r["n"] for r in rows], dtype=np.int64)


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 1) -> None:
    """Tokenize whole texts, append ``end_id`` to each document and write the file set described above.

    Null and empty texts hold the end id alone. Documents of equal id follow each other in the order of their texts'
    hashes; a null id comes first. An empty table writes no block. Other columns are ignored.
    """
    spark = docs.sparkSession
    tokenized = _tokenized(docs, path or tokenizer_path(), end_id)
    ids, counts = _counted(tokenized)
    lengths = code_lengths(counts)
    book = [(int(i), int(n)) for i, n in zip(ids, lengths, strict=True)]
    spark.createDataFrame(book, "id long, length int").coalesce(1).write.parquet(f"{folder}/codebook")
    earlier = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per shard
    shards = tokenized.groupBy("shard").agg(F.sum("n").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_start"))
    sent = spark.sparkContext.broadcast((ids, lengths))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, parts, filled, at = Codebook(*sent.value), [], 0, None

        def block() -> pa.RecordBatch:
            bits, marks = book.encode(np.concatenate([_ids(p["ids"], p["width"]) for p in parts]))
            columns = {
                "shard": pa.array([parts[0]["shard"]], pa.int32()),
                "before": pa.array([parts[0]["before"]], pa.int64()),
                "doc_ids": pa.array([[p["doc_id"] for p in parts]], pa.list_(arrow)),
                "doc_sizes": pa.array([[p["n"] for p in parts]], pa.list_(pa.int64())),
                "n_ids": pa.array([filled], pa.int64()),
                "bits": pa.array([bits], pa.binary()),
                "marks": pa.array([marks], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for whole in batches:
            arrow = whole.schema.field("doc_id").type
            for batch in _pieces(whole, "ids", TEXT_BYTES):
                for row in batch.to_pylist():
                    if parts and (filled >= BLOCK_IDS or (row["shard"], row["before"]) != at):
                        yield block()
                        parts, filled = [], 0
                    parts.append(row)
                    filled += row["n"]
                    at = (row["shard"], row["before"] + row["n"])
        if parts:
            yield block()

    blocks = tokenized.select("shard", "before", "doc_id", "n", "width", "ids").mapInArrow(
        run,
        f"shard int, before long, doc_ids array<{kind}>, doc_sizes array<long>, n_ids long, bits binary, marks binary",
    )
    # a row for each shuffle partition is sent along
    blocks = blocks.join(F.broadcast(shards), "shard").withColumn("start", F.col("shard_start") + F.col("before"))
    columns = ["shard", "start", "doc_ids", "doc_sizes", "n_ids", "bits", "marks"]
    blocks.select(*columns).sortWithinPartitions("shard", "start").write.partitionBy("shard").parquet(f"{folder}/blocks")


def read_ids(spark: SparkSession, folder: str, kind: str = "bigint") -> DataFrame:
    """doc_id (of the SQL type ``kind``), start, n_tokens, ids (little-endian 32 bits) of every document of a file set."""
    schema = f"start long, doc_ids array<{kind}>, doc_sizes array<long>, n_ids long, bits binary, marks binary, shard int"
    blocks = spark.read.schema(schema).parquet(f"{folder}/blocks")
    rows = spark.read.parquet(f"{folder}/codebook").collect()  # at most one row per entry of the vocabulary
    ids = np.array([r["id"] for r in rows], dtype=np.int64)
    lengths = np.array([r["length"] for r in rows], dtype=np.uint8)
    sent = spark.sparkContext.broadcast((ids, lengths))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(*sent.value)

        def documents(rows: list[dict]) -> pa.RecordBatch:
            flat = book.decode([(r["bits"], r["marks"], r["n_ids"]) for r in rows]).astype("<u4")
            sizes = [np.array(r["doc_sizes"], dtype=np.int64) for r in rows]
            starts = [r["start"] + np.cumsum(s) - s for r, s in zip(rows, sizes, strict=True)]
            sizes = np.concatenate(sizes)
            columns = {
                "doc_id": pa.array([d for r in rows for d in r["doc_ids"]], arrow),
                "start": pa.array(np.concatenate(starts), pa.int64()),
                "n_tokens": pa.array(sizes, pa.int64()),
                "ids": _binary(flat, np.concatenate(([0], np.cumsum(sizes)))),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            arrow = batch.schema.field("doc_ids").type.value_type
            rows, filled = [], 0
            for k in range(batch.num_rows):
                rows += batch.slice(k, 1).to_pylist()
                filled += rows[-1]["n_ids"]
                if filled >= DECODE_IDS:
                    yield documents(rows)
                    rows, filled = [], 0
            if rows:
                yield documents(rows)

    columns = ["start", "doc_ids", "doc_sizes", "n_ids", "bits", "marks"]
    return blocks.select(*columns).mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids binary")


def id_digests(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of decoded documents; crc32 over the little-endian 32-bit ids."""
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def encoded_digests(docs: DataFrame, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Write the documents' ids to a new folder among the written tables of the run, read them back, and digest them."""
    spark = docs.sparkSession
    folder = f"{scratch_folder(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, folder, path, end_id)
    return id_digests(read_ids(spark, folder, docs.schema["doc_id"].dataType.simpleString()))

"""A manifest of a dataset as a content-addressed tree of digests, and proofs that a row belongs to it.

Each group's rows (a language) are the leaves of a tree; eight consecutive nodes become one, whose digest is stored with
the digests of its children. The groups' roots are the leaves of one more such tree, and its root stands for the dataset.

A proof is found from the root down: the record of a node's digest gives its children, the digit of the wanted leaf's rank
says which one to open next, and the others are collected. What was collected, from the leaf up again, is the proof.
Requests that go the same way go it together: a node is opened once for all leaves below it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.llm.ranks import placed
from careflow.session import cut_lineage

FAN = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:string,right:string>>"
WHOLE = ""  # name of the tree over the trees


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of all parts in a row."""
    return F.sha2(F.concat(*parts), 256)


def row_digest(*values: Column) -> Column:
    return digest(*map(encoded, values))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and the siblings on its path, from the leaf up, lead to."""
    return F.aggregate(path, leaf, lambda below, s: digest(s["left"], below, s["right"]))


def siblings_digest(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf up and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


@dataclass(frozen=True)
class Manifest:
    """``leaves``: the given rows with tree, n (leaves of their tree) and rank (from 0).

    ``roots`` (tree, name, rank, n, digest) has the groups' trees by ``name``, as leaves of the tree over them.
    ``records[k]`` (digest, children) has the nodes whose children are k levels above the leaves, each digest once; ``upper``
    has the same for the tree over the trees. ``root`` is one row with the digest of all; no row for an empty table.
    """

    leaves: DataFrame
    roots: DataFrame
    records: list[DataFrame]
    upper: list[DataFrame]
    root: DataFrame
    fan: int


def _grow(nodes: DataFrame, fan: int) -> tuple[list[DataFrame], DataFrame]:
    """Records by level, and (tree, digest) of the roots, from the leaves (tree, rank, n, digest)."""
    level = nodes.select("tree", "rank", F.col("n").alias("width"), "digest")
    wide = level.agg(F.max("width")).first()[0] or 0
    records, tops = [], []
    while True:
        tops.append(level.where("width = 1").select("tree", "digest"))
        if wide <= 1:
            break
        run = F.array_sort(F.collect_list(F.struct("rank", "digest")))
        parents = (
            level.where("width > 1")
            .groupBy("tree", F.floor(F.col("rank") / fan).alias("rank"))
            .agg(F.ceil(F.first("width") / fan).alias("width"), run["digest"].alias("children"))
            .withColumn("digest", F.sha2(F.array_join("children", ""), 256))
        )
        level = cut_lineage(parents)
        # a digest says what is below it, so equal nodes have one record
        records.append(cut_lineage(level.groupBy("digest").agg(F.first("children").alias("children"))))
        wide = -(-wide // fan)
    return records, cut_lineage(reduce(DataFrame.unionByName, tops))


def manifest(rows: DataFrame, group: Column, order: list[Column], leaf: str = "leaf", fan: int = FAN) -> Manifest:
    """The trees over ``rows``, whose column ``leaf`` holds the digests; rows of a group in the given order.

    Groups follow each other in the byte order of their names, null first. Rows that agree in ``order`` are told apart by
    their digest, so equal rows can change places without changing anything. A group of any size is ranked over many
    tasks, and a level is one aggregation of at most ``fan`` rows a key. An empty table has no root.
    """
    name = F.coalesce(F.concat(F.lit("s"), group.cast("string")), F.lit("n"))  # n comes before every s...
    ranked = placed(cut_lineage(rows.withColumn("tree", name)), ["tree"], [*order, F.col(leaf)])
    counts = cut_lineage(ranked.groupBy("tree").agg(F.count("*").alias("n")))  # a row per group
    leaves = cut_lineage(ranked.join(counts, "tree").withColumn("rank", F.col("place") - 1).drop("place"))
    records, tops = _grow(leaves.withColumnRenamed(leaf, "digest"), fan)
    named = placed(tops.withColumnRenamed("tree", "name"), [], [F.col("name")])
    n = tops.agg(F.count("*")).scalar()
    roots = named.select(F.lit(WHOLE).alias("tree"), "name", (F.col("place") - 1).alias("rank"), n.alias("n"), "digest")
    roots = cut_lineage(roots)
    upper, root = _grow(roots, fan)
    return Manifest(leaves, roots, records, upper, root.select("digest"), fan)


def _descend(requests: DataFrame, records: list[DataFrame], start: DataFrame, fan: int) -> DataFrame:
    """``requests`` (tree, rank, n and others) with the digest found at that rank and ``path``, from the root down.

    ``start`` has a row per tree: tree, digest, path so far, and others that are handed down to what is below.
    """
    wanted = [requests]
    for _ in records:  # the nodes on the ways to what is wanted, level by level
        above = wanted[-1].select("tree", "n", F.floor(F.col("rank") / fan).alias("rank"))
        wanted.append(cut_lineage(above.distinct()))
    opened = None
    for level in range(len(records), -1, -1):
        # trees of just this height begin here
        width, lower = F.ceil(F.col("n") / fan**level), F.ceil(F.col("n") / fan ** max(level - 1, 0))
        visits = wanted[level].where((width == 1) & ((lower > 1) if level else F.lit(True))).join(start, "tree")
        if opened is not None:
            digit = (F.col("rank") % fan).cast("int")
            before, after = F.slice("children", 1, digit), F.slice("children", digit + 2, fan)
            beside = F.struct(F.array_join(before, "").alias("left"), F.array_join(after, "").alias("right"))
            met = wanted[level].withColumn("at_", F.floor(F.col("rank") / fan)).join(opened, ["tree", "at_"])
            met = met.withColumn("digest", F.get("children", digit)).withColumn("path", F.array_append("path", beside))
            visits = visits.unionByName(met.select(visits.columns))
        if not level:
            return visits
        visits = cut_lineage(visits)
        opened = visits.join(records[level - 1], "digest").drop("digest", "n").withColumnRenamed("rank", "at_")
    raise AssertionError("level 0 returns")


def proofs(tree: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (tree, rank, n as in ``tree.leaves``, and others) with digest, subroot and ``path``, from the leaf up.

    ``path`` has, for each level, the siblings to the left and to the right as digests in a row. Columns of other names are
    kept; every request gets a row, repeated ones too.
    """
    root = tree.root.select(F.lit(WHOLE).alias("tree"), "digest", F.array().cast(PATH).alias("path"))
    begin = _descend(tree.roots.select("tree", "rank", "n", "name"), tree.upper, cut_lineage(root), tree.fan)
    begin = begin.select(F.col("name").alias("tree"), "digest", "path", F.col("digest").alias("subroot"))
    found = _descend(requests, tree.records, cut_lineage(begin), tree.fan)
    return found.withColumn("path", F.reverse("path"))


def document_proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document; trees by lang, leaves by doc_id.

    A leaf digests doc_id, source, lang, n_chars and text. Where 3 divides the unsigned crc32 of the decimal id, the fold
    starts from a leaf whose text has A-Z lower-cased; ``verified`` says whether it still leads to the root.

    Nulls are values of their own; a null id comes first in its language and is never tampered with. Documents of one id are
    ordered by their leaves, repeated rows are leaves of their own, an empty text differs from null, an empty table gives an
    empty result. Whole texts are digested, once; what is shuffled are digests. Other columns are ignored.
    """
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(tampered, row_digest(*head, F.translate("text", UPPER, LOWER)))
    rows = docs.select("doc_id", "lang", row_digest(*head, F.col("text")).alias("leaf"), changed.alias("changed"))
    tree = manifest(rows, F.col("lang"), [F.col("doc_id").asc_nulls_first()])
    found = proofs(tree, tree.leaves.select("tree", "rank", "n", "doc_id", "changed"))
    root = tree.root.scalar()
    found = found.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        root.alias("root"),
        siblings_digest(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("changed", "digest"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from careflow.llm import entries, merkle

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join(parts))


def tree(leaves, fan=8):
    """(root, siblings of each leaf as (left, right) from the leaf up)."""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, place in enumerate(at):
            low = place // fan * fan
            paths[k].append(("".join(level[low:place]), "".join(level[place + 1 : low + fan])))
        level = [sha("".join(level[i : i + fan])) for i in range(0, len(level), fan)]
        at = [p // fan for p in at]
    return level[0], paths


def brute(rows):
    """From (doc_id, source, lang, n_chars, text)."""
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    names = sorted(langs, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        langs[s].sort(key=lambda x: x[:3])
        trees[s] = tree([x[2] for x in langs[s]])
    root, above = tree([trees[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for (_, _, leaf, r), path in zip(langs[s], trees[s][1], strict=True):
            path = [*path, *above[k]]
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                low = r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
                now = leaf_of(*r[:4], low)
            for a, b in path:
                now = sha(a + now + b)
            out.append((r[0], leaf, trees[s][0], root, sha("".join(a + b for a, b in path)), now, now == root))
    return out


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_query_is_brute_force_and_sql(spark, sf, table):
    got = found(entries.op13_merkle_proofs(spark, sf))
    rows = [tuple(r) for r in table("documents").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert got == sorted(brute(rows), key=str)
    assert 0 < sum(not r[-1] for r in got) < len(got)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    sql = con.execute(entries.ORACLES["op13_merkle_proofs"])
    names = [d[0] for d in sql.description]
    assert sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in sql.fetchall()), key=str) == got


@pytest.mark.parametrize("langs", [1, 3, 20])
def test_messy_rows(spark, documents, langs):
    names = [None, "", "en", "é", "Z", *(f"l{k}" for k in range(20))][:langs]
    rows = [(1, None, "s", "en"), (2, "", None, None), (None, "A b", "s", "en"), (None, "A b", "s", "en"), (3, "X" * 50_000, "s", "en")]
    rows += [(k, f"Text {k}", "s", names[k % langs]) for k in range(4, 150)] + [(7, "same ID", "s", names[0])] * 30
    if langs == 1:
        rows = [(i, t, s, None) for i, t, s, _ in rows[:70]]
    docs = documents(rows)
    plain = [(i, s, g, None if t is None else len(t), t) for i, t, s, g in rows]
    assert found(merkle.document_proofs(docs)) == sorted(brute(plain), key=str)


def test_one_row_and_no_row(documents):
    docs = documents([(5, "One", "s", "en")])
    (row,) = found(merkle.document_proofs(docs))
    assert row[1] == row[2] == row[3] and row[4] == sha("")
    assert found(merkle.document_proofs(docs.limit(0))) == []


def test_some_requests_get_the_proofs_of_all(documents):
    rows = documents([(k, f"t {k}", "s", "en" if k % 3 else "de") for k in range(100)])
    leaves = rows.select("doc_id", "lang", merkle.row_digest(F.col("text")).alias("leaf"))
    m = merkle.manifest(leaves, F.col("lang"), [F.col("doc_id")], fan=3)
    want = m.leaves.select("tree", "rank", "n", "doc_id")
    every = {r["doc_id"]: r for r in merkle.proofs(m, want).collect()}
    some = merkle.proofs(m, want.where("doc_id % 17 = 0").withColumn("note", F.lit("x"))).collect()
    assert len(every) == 100 and len(some) == 6
    for r in some:
        assert (r["digest"], r["path"], r["note"]) == (every[r["doc_id"]]["digest"], every[r["doc_id"]]["path"], "x")
    root = m.root.first()[0]
    assert merkle.proofs(m, want).select(merkle.folded(F.col("digest"), F.col("path")).alias("f")).where(F.col("f") != root).count() == 0

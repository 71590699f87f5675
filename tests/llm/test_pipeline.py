import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from careflow.llm.toxicity import toxicity
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_mixing import poured
from tests.llm.test_ngram_join import brute as classes


def offset(source):
    return int(hashlib.md5(f"7|s{source}".encode()).hexdigest()[:13], 16) / 2**52


def test_run_is_the_stages_in_plain_python(spark, sf, table):
    score = toxicity(table("documents"), table("labels"))
    rows = table("documents").select("doc_id", "text", "source", score("text").alias("s")).collect()
    docs = {r["doc_id"]: r for r in rows if r["s"] < 0.5}
    assert len(docs) <= len(rows)
    ids = sorted(docs)
    kept = [i for i, (c, *_) in zip(ids, classes([(i, docs[i]["text"]) for i in ids]), strict=True) if c == i]
    assert len(kept) < len(ids)
    items = [(str(r["item_id"]), r["text"]) for r in table("benchmark").collect()]
    clean = [i for i in kept if not contaminated(docs[i]["text"], items)[4]]
    assert len(clean) < len(kept)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", docs[i]["text"] or "")) for i in clean}
    by = defaultdict(list)
    for i in clean:
        by[docs[i]["source"]].append(i)
    total = {s: sum(size[i] for i in members) for s, members in by.items()}
    target = poured(total)
    taken = []
    for s, members in by.items():
        each = target[s] / total[s]
        for k, i in enumerate(sorted(members, key=lambda i: (size[i], i)), 1):
            taken += [i] * (math.floor(k * each + offset(s)) - math.floor((k - 1) * each + offset(s)))
    tokenizer, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i in sorted(taken):
        tokens = [*tokenizer.encode(docs[i]["text"] or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
        start += len(tokens)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == want


def test_stages_take_messy_documents(spark, documents, tmp_path):
    text = "clean words of an ordinary document that nobody minds at all today"
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, text + " twice"), (None, "something else entirely, a second one"),
            (4, "idiot " * 9), (5, "only benchmark words here", None), (6, "long " * 30_000)]
    spark.createDataFrame([(4, 1), (1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(9, "benchmark words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (documents(rows), documents(rows).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "token_ids":
                assert out.columns == docs.columns, name
            out.write.parquet(f"{tmp_path}/{name}-{docs.count()}-{len(list(tmp_path.iterdir()))}")
        kept = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
        assert kept.where(F.col("doc_id") == 5).count() == 0
    docs = documents(rows)
    near = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert sorted(map(str, (r["doc_id"] for r in near.collect()))) == sorted(map(str, [1, 2, 4, 5, 6, None]))


def test_entry_lists_the_queries_and_works_without_them():
    import __spark_entry__ as entry

    names = {n.split("_")[0] for n in entry.queries() if re.match(r"op\d+_", n)}
    assert names == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())

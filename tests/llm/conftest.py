"""Fixtures of the training-data operators."""

import pytest

SF = "/root/testdata/sf0.001"

#: Columns that clash with names used inside the operators or returned by them.
CLASHES = {
    "score": 0.1, "size": 7, "place": 3, "row": "r", "k_id": 1, "text_hash": 5, "n_words": 2, "copies": 9, "bands": 1,
    "held_out": True, "lang_pred": "x", "set_key": "s", "class_id": 4, "shard": 2, "ids": "i", "start": 0, "l_id": 8,
}


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    """doc_id, text, lang, source, n_chars from (doc_id, text[, source[, lang]]), with clashing extra columns."""

    def make(rows, extra=True):
        rows = [(*r, *(["src", "en"][len(r) - 2 :]))[:4] for r in rows]
        rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, s, lang in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({k: F.lit(v) for k, v in CLASHES.items()})
        return df

    return make


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")

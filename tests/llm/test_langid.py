import itertools

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from careflow.llm.langid import START, VOCABULARY, Pieces, drawn, expected_counts, held_out, language_of, log_probabilities, marked, words

PATH = public_tokenizers.path(VOCABULARY)
PIECES = Pieces(PATH)


def segmentations(word):
    for cut in itertools.product((False, True), repeat=len(word) - 1):
        ends = [k + 1 for k, c in enumerate(cut) if c] + [len(word)]
        parts = [word[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        if all(p in PIECES.number or len(p) == 1 for p in parts):
            yield [PIECES.number.get(p, 0) for p in parts]


def test_forward_and_expected_counts_are_sums_over_all_segmentations():
    rng = np.random.default_rng(1)
    p = rng.uniform(0.001, 1, size=(PIECES.size, 3))
    some = [START + "than", START + "die", START + "über", START + "ж", "ing"]
    logs = log_probabilities(PIECES, some, p)
    lang = np.array([0, 1, 2, 0, 1])
    n = np.array([1, 2, 5, 1, 3])
    counts = expected_counts(PIECES, some, n, lang, p)
    want = np.zeros_like(counts)
    for k, w in enumerate(some):
        ways = list(segmentations(w))
        total = sum(np.prod(p[s], axis=0) for s in ways)
        assert np.allclose(np.exp(logs[k]), total)
        for s in ways:
            for piece in s:
                want[piece, lang[k]] += n[k] * np.prod(p[s, lang[k]]) / total[lang[k]]
    assert np.allclose(counts, want)


def test_all_letter_pieces_of_the_vocabulary_take_part():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    every = {model.id_to_piece(k) for k in range(model.get_piece_size())}
    letters = {p for p in every if p.removeprefix(START).isalpha() and p == p.lower()}
    assert max(map(len, letters)) == 16
    assert letters <= set(PIECES.number)
    p = np.full((PIECES.size, 1), 0.01)
    for word in (START + "people", START + "because", "formation"):
        total = 0.0
        for cut in itertools.product((False, True), repeat=len(word) - 1):
            ends = [k + 1 for k, c in enumerate(cut) if c] + [len(word)]
            parts = [word[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            total += 0.01 ** len(parts) if all(x in every for x in parts) else 0.0
        assert np.isclose(np.exp(log_probabilities(PIECES, [word], p))[0, 0], total)


def test_words():
    assert words("The 1st, ÉTÉ!_x the") == {"the": 2, "st": 1, "été": 1, "x": 1}
    assert not words(None) and not words("") and not words("12 ½ ² !")
    assert "".join(marked(list(words("a" * 39 + "b" * 30 + "c" * 30)))) == START + "a" * 39 + "b" * 30 + "c" * 30


def test_held_out_accuracy(table):
    docs = table("documents")
    language = language_of(docs)
    rows = docs.where(held_out(F.col("doc_id"))).select("lang", language("text").alias("p")).collect()
    assert len(rows) > 30
    assert sum(r["lang"] == r["p"]["lang"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["p"]["score"] <= 1 for r in rows)


def test_messy_rows(documents):
    en, de = "the and of this that with are from", "der und die nicht ist eine von dem"
    rows = [(k, en if k % 2 else de, None, "en" if k % 2 else "de") for k in range(40)]
    rows += [(50, None, "s", "en"), (51, "", "s", "en"), (52, "123 !", "s", None), (None, "the of", "s", None), (53, "die nicht " * 50_000, "s", None),
             (54, "ж" * 300, "s", None)]
    docs = documents(rows)
    language = language_of(docs)
    found = {r["doc_id"]: r["p"] for r in docs.select("doc_id", language("text").alias("p")).collect()}
    assert [found[k]["lang"] for k in (50, 51, 52)] == ["und"] * 3
    assert found[None]["lang"] == "en" and found[53]["lang"] == "de"
    assert found[54]["lang"] in ("en", "de")
    assert all(found[k]["lang"] == ("en" if k % 2 else "de") for k in range(40))
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    language = language_of(nothing)
    assert {r["p"]["lang"] for r in docs.select(language("text").alias("p")).collect()} == {"und"}
    assert language_of(docs.limit(0)) and docs.limit(0).select(language("text")).count() == 0


def test_rows_without_ids_are_drawn_one_by_one(documents):
    some = {"en": "the and of this", "de": "der und die nicht", "es": "el los una por", "fr": "le les une dans"}
    docs = documents([(None, f"{text} {'ab' * k}", "s", lang) for lang, text in some.items() for k in range(400)])
    sample, languages = drawn(docs, 40)
    counts = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert languages == sorted(some) == sorted(counts)
    assert all(15 < n < 80 for n in counts.values())
    copies = docs.limit(1).crossJoin(docs.limit(300).select())
    assert drawn(copies, 1)[0].count() == 300  # never a language without words
    language = language_of(docs, max_docs=40)
    asked = documents([(k, text, "s", lang) for k, (lang, text) in enumerate(some.items())])
    assert all(r["lang"] == r["p"]["lang"] for r in asked.select("lang", language("text").alias("p")).collect())

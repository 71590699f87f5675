"""Language identification by unigram pieces, summed over all segmentations.

A word's probability in a language is the sum, over every way to cut it into pieces of a fixed public vocabulary, of
the product of the pieces' probabilities in that language. The forward recursion computes the sum, and expectation
maximization over the same lattice learns the probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.session import cut_lineage

VOCABULARY = "piece_bpe_32k.model"
LETTERS = re.compile(r"[^\W\d_]+")
FOLDS, FOLD = 4, 2
START = "▁"  # the vocabulary's mark of a word's beginning
GOES_ON = "\0"
LONGEST_WORD = 40  # longer runs of letters are cut into words of this length, so that no product underflows
_WORDS_KEPT, _WORDS_STAY = 300_000, 100_000  # most words in memory; those met first stay when it is full


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == FOLD


def words(text: str | None) -> Counter:
    """Lower-cased runs of letters of a whole text and how often each occurs; what follows in a long run begins with ``GOES_ON``."""
    found = Counter(LETTERS.findall(text.lower())) if text else Counter()
    if not any(c.isalpha() for w in found for c in w):  # numerals that are no digits
        return Counter()
    for w in [w for w in found if len(w) > LONGEST_WORD]:
        n = found.pop(w)
        found[w[:LONGEST_WORD]] += n
        for k in range(LONGEST_WORD, len(w), LONGEST_WORD):
            found[GOES_ON + w[k : k + LONGEST_WORD]] += n
    return found


def marked(found: list[str]) -> list[str]:
    """Words as the vocabulary spells them."""
    return [w[1:] if w[0] == GOES_ON else START + w for w in found]


class Pieces:
    """The vocabulary's pieces of letters; number 0 stands for any character that no piece covers alone."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = (model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_byte(k)))
        usable = (p for p in names if p and p == p.lower() and re.fullmatch(rf"{START}?[^\W\d_]*", p))
        self.number = {p: k for k, p in enumerate(dict.fromkeys(usable), 1)}
        self.size = len(self.number) + 1
        # every beginning of a piece, -1 where it is none itself: a search ends where no piece goes on
        self.begins = {p[:k]: -1 for p in self.number for k in range(1, len(p))} | self.number

    def lattice(self, found: list[str]) -> tuple[np.ndarray, ...]:
        """(word, first, end, piece) of every arc, in order of end, then word."""
        get, arcs = self.begins.get, []
        add = arcs.append  # each arc is one number: end, word, first and piece from the highest bits down
        for k, w in enumerate(found):
            n, k = len(w), k << 28
            for a in range(n):
                base = k | a << 20
                p = get(w[a])
                add((a + 1) << 48 | base | (p if p is not None and p > 0 else 0))
                if p is None:
                    continue
                for b in range(a + 2, n + 1):
                    p = get(w[a:b])
                    if p is None:
                        break
                    if p > 0:
                        add(b << 48 | base | p)
        packed = np.sort(np.array(arcs, dtype=np.int64))
        return packed >> 28 & 0xFFFFF, packed >> 20 & 0xFF, packed >> 48, packed & 0xFFFFF


def forward(arcs: tuple[np.ndarray, ...], n_words: int, longest: int, p: np.ndarray) -> np.ndarray:
    """alpha[word, position, language]: probability of all segmentations up to a position. ``p``: piece x language."""
    word, first, end, piece = arcs
    alpha = np.zeros((n_words, longest + 1, p.shape[1]))
    alpha[:, 0] = 1
    bounds = np.searchsorted(end, np.arange(1, longest + 2))
    for e, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), 1):
        if a < b:
            flow = alpha[word[a:b], first[a:b]] * p[piece[a:b]]
            starts = np.flatnonzero(np.diff(word[a:b], prepend=-1))
            alpha[word[a:b][starts], e] = np.add.reduceat(flow, starts)
    return alpha


def log_probabilities(pieces: Pieces, found: list[str], p: np.ndarray) -> np.ndarray:
    """log P(word | language), word x language."""
    if not found:
        return np.empty((0, p.shape[1]))
    lengths = np.array([len(w) for w in found])
    alpha = forward(pieces.lattice(found), len(found), int(lengths.max()), p)
    return np.log(np.maximum(alpha[np.arange(len(found)), lengths], 1e-300))


def expected_counts(pieces: Pieces, found: list[str], n: np.ndarray, language: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in each language, over words that occur n times in a language."""
    arcs = pieces.lattice(found)
    word, first, end, piece = arcs
    lengths = np.array([len(w) for w in found])
    longest = int(lengths.max())
    alpha = forward(arcs, len(found), longest, p)
    beta = np.zeros_like(alpha)
    beta[np.arange(len(found)), lengths] = 1
    order = np.lexsort((word, -first))  # from the back
    w, a, b, k = (x[order] for x in arcs)
    bounds = np.searchsorted(-a, -np.arange(longest, -2, -1))
    for at, (lo, hi) in zip(range(longest, -1, -1), zip(bounds[:-1], bounds[1:], strict=True), strict=True):
        if lo < hi:
            flow = beta[w[lo:hi], b[lo:hi]] * p[k[lo:hi]]
            starts = np.flatnonzero(np.diff(w[lo:hi], prepend=-1))
            beta[w[lo:hi][starts], at] = np.add.reduceat(flow, starts)
    lang = language[word]
    total = np.maximum(alpha[np.arange(len(found)), lengths, language], 1e-300)
    used = alpha[word, first, lang] * p[piece, lang] * beta[word, end, lang] * (n / total)[word]
    flat = np.bincount(piece * p.shape[1] + lang, weights=used, minlength=p.size)
    return flat.reshape(p.shape)


def drawn(known: DataFrame, max_docs: int) -> tuple[DataFrame, list[str]]:
    """(about ``max_docs`` rows of each language, languages in order), by a hash of id, language and text.

    The row with the smallest hash of a language is always drawn; exact copies of a row are drawn with it.
    """
    place = F.pmod(F.xxhash64("doc_id", "lang", "text"), F.lit(1 << 20))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("low")).collect()
    if not counts:
        return known, []
    ends = {r["lang"]: max(min(1.0, max_docs / r["n"]) * (1 << 20), r["low"] + 1.0) for r in counts}
    return known.where(place < F.coalesce(*(F.when(F.col("lang") == x, F.lit(end)) for x, end in ends.items()))), sorted(ends)


def learn(docs: DataFrame, path: str, max_docs: int, rounds: int, smooth: float) -> tuple[list[str], np.ndarray]:
    """(languages in order, log-free probabilities piece x language), by expectation maximization on Spark.

    Fitted on about ``max_docs`` documents of each language outside the held-out fold, chosen by a hash of id, language
    and text; their words and counts stay distributed, and each round brings at most one number per piece and language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sample, languages = drawn(known, max_docs)
    if not languages:
        return [], np.empty((0, 0))
    number = {x: k for k, x in enumerate(languages)}
    code = F.coalesce(*(F.when(F.col("lang") == x, F.lit(k)) for x, k in number.items()))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for language, texts in part.groupby("language")["text"]:
                total: Counter = Counter()
                for text in texts:
                    total.update(words(text))
                found = pd.Series(list(total), dtype="object")
                yield pd.DataFrame({"language": language, "word": found, "n": pd.Series(total.values(), dtype="int64")})

    found = sample.select(code.alias("language"), "text").mapInPandas(count, "language int, word string, n long")
    table = cut_lineage(found.groupBy("language", "word").agg(F.sum("n").alias("n")))
    spark, size = docs.sparkSession, Pieces(path).size
    p = np.full((size, len(languages)), 1.0 / size)
    p[0] = 1e-6  # a character outside the vocabulary says nothing about the language
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(p)

        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pieces, total = Pieces(path), np.zeros_like(sent.value)
            for part in batches:
                for low in range(0, len(part), 5000):
                    some = part.iloc[low : low + 5000]
                    total += expected_counts(
                        pieces, marked(some["word"].tolist()), some["n"].to_numpy(), some["language"].to_numpy(), sent.value
                    )
            piece, language = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "language": language, "n": total[piece, language]})

        rows = table.mapInPandas(step, "piece int, language int, n double")
        rows = rows.groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()
        n = np.full(p.shape, smooth)
        n[rows["piece"], rows["language"]] += rows["n"]
        n[0] = 0
        p = n / n.sum(axis=0)
        p[0] = 1e-6
    return languages, p


RESULT = "lang string, score double"


def language_of(docs: DataFrame, max_docs: int = 1500, rounds: int = 4, smooth: float = 0.1, path: str | None = None):
    """A column function: text -> struct of lang and score (the posterior of that language, equal priors).

    Learned from text and lang of the documents outside the held-out fold; id, source and lang are no input of a
    prediction. The whole text counts. A null text, or one without a letter, is ``und`` with score 0, as is every text
    if there is nothing to learn from. Between equal languages the first by name wins. Repeated rows are predicted each and
    learned from together, rows without an id are learned from like others, an empty table has no predictions, and other
    columns are ignored.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    languages, p = learn(docs, path, max_docs, rounds, smooth)
    sent = docs.sparkSession.sparkContext.broadcast(p)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = sent.value
        pieces, known, table = Pieces(path), {}, np.empty((1024, len(languages)))
        for texts in batches:
            rows: list[tuple[str, float]] = []
            for low in range(0, len(texts), 256):
                counts = [words(t) if languages else Counter() for t in texts.iloc[low : low + 256]]
                new = list(dict.fromkeys(w for c in counts for w in c if w not in known))
                if len(known) + len(new) > _WORDS_KEPT:
                    known = dict(islice(known.items(), _WORDS_STAY))  # their rows come first in the table
                    new = list(dict.fromkeys(w for c in counts for w in c if w not in known))
                while len(known) + len(new) > len(table):
                    table = np.concatenate((table, np.empty_like(table)))
                for a in range(0, len(new), 5000):
                    some = new[a : a + 5000]
                    table[len(known) : len(known) + len(some)] = log_probabilities(pieces, marked(some), p)
                    known.update(zip(some, range(len(known), len(known) + len(some)), strict=True))
                for c in counts:
                    if not c:
                        rows.append(("und", 0.0))
                        continue
                    at = np.fromiter(map(known.__getitem__, c), dtype=np.int64, count=len(c))
                    z = np.fromiter(c.values(), dtype=np.float64, count=len(c)) @ table[at]
                    best = int(np.argmax(z))
                    rows.append((languages[best], float(1 / np.exp(z - z[best]).sum())))
            yield pd.DataFrame(rows, columns=["lang", "score"]).astype({"lang": "object"})

    return F.pandas_udf(predict, RESULT)

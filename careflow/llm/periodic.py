"""Periodic runs of words: harmonic grids of candidate places, extended by a difference-cover LCE.

A run of period q and length of at least 4 q holds, on every grid of step 2 q, a place i from which more than q words agree
with those q places on. Only places that pass a comparison of their first words are extended, forwards and backwards, by
longest common extensions (LCE). For these the suffixes at places of a difference cover (7 of every 32) are sorted, the
common prefixes of neighbours in that order go into a sparse table, and an LCE compares at most 31 words until both places
reach the cover together, and then asks the table once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = 32
COVER = (0, 1, 2, 3, 7, 11, 19)  # every difference modulo STEP occurs between two of these
BATCH_WORDS = 1 << 17  # words of the texts that are worked on together, or one longer text
GRID_SLICE = 1 << 19
LEAST, POWER = 6, 4  # a run has at least LEAST words and POWER periods
RESULT = "runs array<struct<start:long,length:long,period:long>>, collapsed string"

_COVERED = np.isin(np.arange(STEP), COVER)
_STEPS = np.arange(STEP)
_MEET = np.array(
    [[np.argmax(_COVERED[(a + _STEPS) % STEP] & _COVERED[(b + _STEPS) % STEP]) for b in range(STEP)] for a in range(STEP)]
)


def agreeing(letters: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many letters from x and from y on are the same, word by word, up to ``most``."""
    out = np.zeros(len(x), dtype=np.int64)
    live, t = np.flatnonzero(most > 0), 0
    while len(live):
        live = live[letters[x[live] + t] == letters[y[live] + t]]
        t += 1
        out[live] = t
        live = live[most[live] > t]
    return out


class Extensions:
    """Longest common extensions of pairs of places of one array of non-negative numbers."""

    def __init__(self, letters: np.ndarray):
        n = self.n = len(letters)
        top = int(letters.max()) + 1 if n else 0
        # what follows the end differs from everything, so that no extension goes past it
        self.letters = np.concatenate((letters.astype(np.int64), top + np.arange(2 * STEP)))
        self.places = np.flatnonzero(_COVERED[np.arange(n + 1) % STEP])
        self.slot = np.full(n + 1, -1, dtype=np.int64)
        self.slot[self.places] = np.arange(len(self.places))
        levels = self._sorted()
        self.rank = levels[-1]
        self.table = self._table(levels)

    def _sorted(self) -> list[np.ndarray]:
        """Ranks of the covered suffixes by their first STEP words, then by twice as many each time until all differ."""
        places, m = self.places, len(self.places)
        bits = max(1, int(self.letters[-1]).bit_length())
        per = 63 // bits
        keys = []
        for at in range(0, STEP, per):
            key = np.zeros(m, dtype=np.int64)
            for t in range(at, min(at + per, STEP)):
                key = key << bits | self.letters[places + t]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(m, dtype=bool)
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        rank = np.empty(m, dtype=np.int64)
        rank[order] = np.cumsum(new)
        levels, length = [rank], STEP
        while rank.max(initial=0) < m - 1:
            # suffixes that still agree do not reach the end, so the place behind is a covered one
            behind = places + length
            there = np.where(behind <= self.n, rank[self.slot[np.minimum(behind, self.n)]], 0)
            key = rank * m + there
            order = np.argsort(key, kind="stable")
            rank = np.empty(m, dtype=np.int64)
            rank[order] = np.cumsum(np.concatenate(([False], key[order[1:]] != key[order[:-1]])))
            levels.append(rank)
            length *= 2
        return levels

    def _table(self, levels: list[np.ndarray]) -> list[np.ndarray]:
        """Minima over 1, 2, 4, ... neighbouring common prefixes of the sorted covered suffixes."""
        by_rank = np.empty(len(self.places), dtype=np.int64)
        by_rank[self.rank] = self.places
        a, b = by_rank[:-1].copy(), by_rank[1:].copy()
        common = np.zeros(len(a), dtype=np.int64)
        for k in reversed(range(len(levels))):
            same = np.flatnonzero(levels[k][self.slot[a]] == levels[k][self.slot[b]])
            for x in (a, b, common):
                x[same] += STEP << k
        common += agreeing(self.letters, a, b, np.full(len(a), STEP))
        table, width = [common.astype(np.int32 if self.n < 1 << 31 else np.int64)], 1
        while 2 * width <= len(common):
            last = table[-1]
            table.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        return table

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair of different places, how many words from there on are the same."""
        meet = _MEET[x % STEP, y % STEP]
        out = agreeing(self.letters, x, y, meet)
        met = np.flatnonzero(out == meet)
        a, b = self.rank[self.slot[x[met] + meet[met]]], self.rank[self.slot[y[met] + meet[met]]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(high - low)[1] - 1
        for k in np.unique(level):
            of = np.flatnonzero(level == k)
            row = self.table[k]
            out[met[of]] += np.minimum(row[low[of]], row[high[of] - (1 << k)])
        return out


def _needed(period: np.ndarray) -> np.ndarray:
    """Words that agree from the first grid place of a run on, at least: the run may begin 2 q - 1 places before it."""
    return np.maximum(LEAST - 3 * period + 1, (POWER - 3) * period + 1)


def _grid(sizes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) of the harmonic grids of all texts, in slices: period p stands at every 2 p-th place."""
    periods = np.where(sizes >= LEAST, sizes // POWER, 0)
    owner = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(owner)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = (sizes[owner] - period - _needed(period)) // (2 * period) + 1
    ends = np.concatenate(([0], np.cumsum(points)))
    for low in range(0, int(ends[-1]), GRID_SLICE):
        high = min(low + GRID_SLICE, int(ends[-1]))
        first, last = np.searchsorted(ends, low, side="right") - 1, np.searchsorted(ends, high, side="left")
        taken = np.minimum(ends[first + 1 : last + 1], high) - np.maximum(ends[first:last], low)
        row = np.repeat(np.arange(first, last), taken)
        p = period[row]
        yield offsets[owner[row]] + (np.arange(low, high) - ends[row]) * 2 * p, p


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, given as an array of word numbers: rows (start, length, period) of all runs, by start, then period."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    top = max((int(t.max()) for t in texts if len(t)), default=0) + 1
    # a number of its own ends each text, and a few more the last one
    ends = top + np.arange(len(texts) + STEP)
    letters = np.concatenate([x for t, e in zip(texts, ends) for x in (t, [e])] + [ends[len(texts) :]]).astype(np.int64)
    offsets = np.cumsum(sizes + 1) - sizes - 1
    places, periods = [], []
    for x, p in _grid(sizes, offsets):
        same = np.flatnonzero(letters[x] == letters[x + p])
        x, p = x[same], p[same]
        first = np.minimum(_needed(p), STEP)
        good = agreeing(letters, x, x + p, first) == first
        places.append(x[good])
        periods.append(p[good])
    none = np.empty((0, 3), dtype=np.int64)
    out = [none] * len(texts)
    if not any(map(len, places)):
        return out
    x, p = np.concatenate(places), np.concatenate(periods)
    owner = np.searchsorted(offsets, x, side="right") - 1
    # only texts with such a place go into the sorted suffixes
    held = np.unique(owner)
    kept = np.concatenate([letters[offsets[d] : offsets[d] + sizes[d] + 1] for d in held])
    kept = np.unique(kept, return_inverse=True)[1]
    begins = np.zeros(len(texts), dtype=np.int64)
    begins[held] = np.cumsum(sizes[held] + 1) - sizes[held] - 1
    x += (begins - offsets)[owner]
    ahead = Extensions(kept)(x, x + p)
    good = ahead >= _needed(p)
    x, p, ahead, owner = x[good], p[good], ahead[good], owner[good]
    n = len(kept)
    behind = Extensions(kept[::-1])(n - x, n - x - p)
    start, end = x - behind, x + p + ahead
    good = end - start >= np.maximum(LEAST, POWER * p)
    start, end, p, owner = start[good], end[good], p[good], owner[good]
    # multiples of a period give the same stretch: the smallest period is the run's
    order = np.lexsort((p, end, start))
    start, end, p, owner = start[order], end[order], p[order], owner[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    rows = np.stack((start - begins[owner], end - start, p), axis=1)[new]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0], owner[new]))]
    bounds = np.searchsorted(owner[new], np.arange(len(texts) + 1))
    return [rows[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space (space and 9 to 13); none for null."""
    return text.encode("utf-8", "replace").split() if text else []


def made_periodic(words: list[bytes], number: int | None) -> list[bytes]:
    """The words, from a place on replaced by repetitions of the first few there, if ``number`` is divisible by ten."""
    n = len(words)
    if number is None or number % 10 or not n:
        return words
    g = number // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _kept(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words that lie in no run behind its first period."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return list(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))


def collapsed(texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, str]]:
    """For each text, given as its words: its runs, and the words that are left, joined by one space."""
    seen: dict[bytes, int] = {}
    fresh = count()
    found = runs_of([np.fromiter(map(seen.setdefault, t, fresh), dtype=np.int64, count=len(t)) for t in texts])
    for words, runs in zip(texts, found, strict=True):
        yield runs, b" ".join(_kept(words, runs) if len(runs) else words).decode("utf-8")


def _batches(texts: Iterator[list[bytes]]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for words in texts:
        if held and size + len(words) > BATCH_WORDS:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def periodic_runs(text: Column, number: Column | None = None) -> Column:
    """Struct of ``runs`` (start, length, period in words from 0; by start, then period) and ``collapsed`` text.

    A run is a stretch of words of smallest period q and a length of at least 6 and 4 q that goes on with that period in
    neither direction. ``collapsed`` has the words, joined by one space, that lie in no run behind the run's first q words.
    With ``number`` a text whose number is divisible by ten is made periodic first (``made_periodic``); null leaves it.

    Whole texts are read. A null, empty or blank text has no words, no runs and an empty collapsed text; texts of fewer than
    six words have no runs. Repeated rows get the same result each, an empty table none, and other columns are not looked
    at. Memory goes with the longest text (about 150 bytes a word), not with the number of rows.
    """

    def collapse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, numbers in batches:
            words = (made_periodic(split_words(t), None if pd.isna(k) else int(k)) for t, k in zip(texts, numbers, strict=True))
            runs, rest = [], []
            for part in _batches(words):
                for found, left in collapsed(part):
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in found.tolist()])
                    rest.append(left)
            yield pd.DataFrame({"runs": pd.Series(runs, dtype="object"), "collapsed": pd.Series(rest, dtype="object")})

    number = F.lit(None).cast("long") if number is None else number.cast("long")
    return F.pandas_udf(collapse, RESULT)(text, number)


def run_digests(found: Column) -> dict[str, Column]:
    """Columns from the struct of ``periodic_runs``: n_runs, the run of most periods, and digests of runs and text.

    The run of greatest exact length / period is given by start, length, period and exponent_milli; ties go to the smallest
    start, then period; without a run the four are null.
    """
    runs = found["runs"]
    zero = F.lit(0).cast("long")
    none = F.struct(zero.alias("start"), zero.alias("length"), F.lit(1).cast("long").alias("period"))
    # in order of start, then period, so an equal one never replaces an earlier one
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    best = F.aggregate(runs, none, lambda a, b: F.when(more(a, b), b).otherwise(a))
    best = F.when(F.size(runs) > 0, best)
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return {
        "n_runs": F.size(runs).cast("long"),
        "start": best["start"],
        "length": best["length"],
        "period": best["period"],
        "exponent_milli": F.floor(best["length"] * 1000 / best["period"]).cast("long"),
        "runs_sha256": F.sha2(F.array_join(lines, ""), 256),
        "collapsed_sha256": F.sha2(found["collapsed"], 256),
    }

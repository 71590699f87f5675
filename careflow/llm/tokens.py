"""Token ids of whole texts, with a cache of words in front of the tokenizer."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from careflow.llm.words import byte_prefix, mix, unscale

DEFAULT = "word_bpe_49k.json"
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
_WORDS_KEPT = 500_000
_SLICE = 1 << 20

_SPACE, _LETTER, _SIGN, _OTHER = range(4)
#: An ASCII letter is never merged with the sign behind it, except for the apostrophe, which can begin a contraction.
_CLASS = np.array(
    [
        _SPACE
        if c in (9, 10, 13, 32)
        else _LETTER
        if 65 <= c <= 90 or 97 <= c <= 122
        else _SIGN
        if 33 <= c <= 126 and not 48 <= c <= 57 and c != 39
        else _OTHER
        for c in range(256)
    ],
    dtype=np.uint8,
)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)


def tokenizer_path(name: str = DEFAULT) -> str:
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids of texts with ``Tokenizer.encode(text, add_special_tokens=False)``, word by word.

    This vocabulary's merges never cross white space, so a text's ids are its words' ids in a row, and a distinct word
    goes through the library once while the bounded cache lasts. Words are found and hashed to 64 bits on the bytes of
    many texts at once. A text that holds the opening of a special token's string is encoded in one piece.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}  # hash of a word -> slot; its ids lie between ends[slot - 1] and ends[slot]
        self.store, self.ends = array("I"), array("q", [0])

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        """Append the ids of new words to the store."""
        rest = []
        for h, w in zip(hashes, words, strict=True):
            if _PLAIN.fullmatch(w):  # one piece of letters: straight to the merges
                letters = w if w.isascii() else w.encode().decode("latin-1").translate(self.letters)
                self.store.extend([t.id for t in self.model.tokenize(letters)])
                self.known[h] = len(self.ends)
                self.ends.append(len(self.store))
            else:
                rest.append((h, w))
        found = self.whole.encode_batch_fast([w for _, w in rest], add_special_tokens=False)
        for (h, _), e in zip(rest, found, strict=True):
            self.store.extend(e.ids)
            self.known[h] = len(self.ends)
            self.ends.append(len(self.store))

    def _ids(self, hashes: np.ndarray, spans: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        code, distinct = pd.factorize(hashes)
        keys = distinct.tolist()
        slots = np.fromiter(map(self.known.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        new = np.flatnonzero(slots < 0)
        if len(new):
            if len(self.known) + len(new) > _WORDS_KEPT:
                self._forget()
                new = np.arange(len(keys))
            first = np.empty(len(keys), dtype=np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            raw = lower.tobytes()
            words = [raw[a:b].decode() for a, b in spans[first[new]].tolist()]
            self._learn([keys[k] for k in new], words)
            slots[new] = [self.known[keys[k]] for k in new]
        store, ends = np.frombuffer(self.store, dtype=np.uint32), np.frombuffer(self.ends, dtype=np.int64)
        slot = slots[code]
        start = ends[slot - 1]
        count = ends[slot] - start
        last = np.cumsum(count)
        place = np.arange(int(last[-1]) if len(last) else 0) + np.repeat(start - (last - count), count)
        return store[place], count

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text); null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.asarray(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False), dtype=bool)
        n = len(texts)
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        lower = _LOWER[data]
        hashes, spans, at = [], [], 0
        while at < n:  # slices of whole texts that fit a processor's cache
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _SLICE, side="right")) - 1)
            a, b = bounds[at], bounds[to]
            if a < b:
                kind = _CLASS[data[a:b]]
                word = kind != _SPACE
                begin = word.copy()
                begin[1:] &= (kind[:-1] == _SPACE) | (kind[:-1] == _LETTER) & (kind[1:] == _SIGN)
                firsts = bounds[at:to][bounds[at:to] < bounds[at + 1 : to + 1]] - a
                begin[firsts] = word[firsts]
                stop = begin | ~word
                stop[1:] &= word[:-1]
                stop[0] = False
                starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
                ends = np.append(ends, b - a) if word[-1] else ends
                prefix = byte_prefix(lower[a:b])
                hashes.append(mix(unscale(prefix[ends] - prefix[starts], starts)))
                spans.append(np.stack((starts, ends), axis=1) + a)
            at = to
        if hashes:
            spans = np.concatenate(spans)
            flat, count = self._ids(np.concatenate(hashes), spans, lower)
            owner = np.searchsorted(bounds[1:], spans[:, 0], side="right")
            sizes = np.bincount(owner, weights=count, minlength=n).astype(np.int64)
        else:
            flat, sizes = np.empty(0, np.uint32), np.zeros(n, np.int64)
        if odd.any():
            ends = np.concatenate(([0], np.cumsum(sizes)))
            parts = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            for k in np.flatnonzero(odd):
                whole = self.whole.encode(texts[int(k)].as_py(), add_special_tokens=False)
                parts[k] = np.array(whole.ids, dtype=np.uint32)
            sizes = np.array([len(p) for p in parts], dtype=np.int64)
            flat = np.concatenate(parts)
        return flat, sizes


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per Python worker; the cache lives as long as the worker."""
    return Encoder(path)

"""Words, byte tables and word n-gram hashes shared by the text operators."""

from __future__ import annotations

import numpy as np

_KEEP = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def normal_bytes(text: str | None) -> bytes:
    """A-Z lower-cased, everything but digits, a-z and non-ASCII turned into single spaces, trimmed."""
    if not text:
        return b""
    return b" ".join(text.encode("utf-8", "replace").translate(_KEEP).split())


_MIX = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer, so that nearby values spread over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = _inverses = np.ones(1, dtype=np.uint64)


def _reserve(size: int) -> None:
    """Powers of the base and of its inverse up to ``size``, kept for the longest text so far."""
    global _powers, _inverses
    if size > len(_powers):
        size = 1 << max(16, int(size).bit_length())
        steps = np.full((2, size), [[_BASE], [_INVERSE]], dtype=np.uint64)
        steps[:, 0] = 1
        _powers, _inverses = np.multiply.accumulate(steps, axis=1)


def byte_prefix(raw: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``unscale(prefix[end] - prefix[start], start)`` is a hash of the bytes between."""
    _reserve(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_MIX[raw] * _powers[: len(raw)], out=prefix[1:])
    return prefix


def unscale(sums: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return sums * _inverses[starts]


class NgramHasher:
    """64-bit hashes of all runs of ``n`` words, from one prefix sum over the bytes of a text."""

    def __init__(self, n: int):
        self.n = n

    def __call__(self, normal: bytes) -> np.ndarray:
        """Sorted distinct hashes; a text of fewer than ``n`` words has one, an empty one none."""
        if not normal:
            return np.empty(0, dtype=np.uint64)
        raw = np.frombuffer(normal, dtype=np.uint8)
        prefix = byte_prefix(raw)
        gaps = np.flatnonzero(raw == 32)
        starts = np.concatenate(([0], gaps + 1))
        ends = np.concatenate((gaps, [len(raw)]))
        if len(starts) > self.n:
            starts, ends = starts[: len(starts) - self.n + 1], ends[self.n - 1 :]
        else:
            starts, ends = starts[:1], ends[-1:]
        return np.unique(mix(unscale(prefix[ends] - prefix[starts], starts)))

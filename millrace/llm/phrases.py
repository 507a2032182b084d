"""Word windows of a text as polynomial hashes, and the anchors that stand for them."""

from __future__ import annotations

import numpy as np
import xxhash

#: An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def _power(base: int, size: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < size:
        held = np.cumprod(np.full(max(size, 1 << 15), base, np.uint64), dtype=np.uint64)
        held = np.concatenate([np.ones(1, np.uint64), held[:-1]])
        _powers[base] = held
    return held[:size]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Windows:
    """All windows of ``size`` words of one text, dealt out over anchors of ``anchor`` words.

    Each window's anchor is the leftmost of the word groups with the least hash
    inside it, so equal windows have equal anchors at equal places. The windows of
    one anchor start in one run, ``first`` to ``last``.
    """

    def __init__(self, words: list[bytes], size: int, anchor: int):
        self.words, self.size = words, size
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(w) for w in words], np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _power(BASE, len(words)), dtype=np.uint64)])
        self.back = _power(INVERSE, len(words) + 1)
        count = len(words) - size + 1
        if count <= 0:
            self.at = self.first = self.last = np.zeros(0, np.int64)
            self.anchors = self.contexts = np.zeros(0, np.int64)
            return
        starts = np.arange(len(words) - anchor + 1)
        groups = mixed(self.between(starts, starts + anchor))
        span = size - anchor + 1
        chosen = np.arange(count) + np.lib.stride_tricks.sliding_window_view(groups, span).argmin(1)
        turns = np.flatnonzero(chosen[1:] != chosen[:-1]) + 1
        self.first = np.concatenate([[0], turns])
        self.last = np.concatenate([turns - 1, [count - 1]])
        self.at = chosen[self.first]
        self.anchors = groups[self.at].view(np.int64)
        shape = (self.at - self.first) * 4096 + (self.last - self.first) + 1
        whole = self.between(self.first, self.last + size)
        self.contexts = mixed(whole + mixed(shape.astype(np.uint64))).view(np.int64)

    def between(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the words from ``start`` up to ``stop``, independent of their place."""
        return (self.sums[stop] - self.sums[start]) * self.back[start]

    def hashes(self, starts: np.ndarray) -> np.ndarray:
        return mixed(self.between(starts, starts + self.size)).view(np.int64)


def split(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return text.encode().split() if text else []

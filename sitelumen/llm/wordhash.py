"""Words of many texts as arrays: where they lie, their hashes and the hashes of word windows.

Words are runs of bytes other than space and \\x09-\\x0D. In UTF-8 those bytes occur in no other character, so
cutting bytes and cutting code points give the same words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """``data``: all texts, a line feed after each; ``start`` and ``end`` of each word there; ``doc`` of each word;
    ``first``: the index of each text's first word, and at last the number of words; ``bounds``: of the texts in data."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(texts: list[str | None], lower: bool = False) -> Words:
    """A null text has no words. ``lower``: A-Z become a-z, other letters stay."""
    encoded = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    raw = b"\n".join([*encoded, b""])
    data = np.frombuffer(raw.translate(LOWER) if lower else raw, np.uint8)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in encoded], out=bounds[1:])
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~SPACE[data]
    edge = np.diff(solid)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.searchsorted(start, bounds)
    return Words(data, start, end, np.repeat(np.arange(len(texts)), np.diff(first)), first, bounds)


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    up, down = _power(len(w.data) + 1)
    total = np.zeros(len(w.data) + 1, np.uint64)
    np.cumsum((w.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[w.end] - total[w.start]) * down[w.start] + (w.end - w.start).astype(np.uint64))


def window_hashes(w: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's windows of ``width`` words, and the index of each window's first word.

    A text of fewer words has one window, of all its words; a text without words has none.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = w.first[1:][w.doc]  # the end of each word's text
    at = np.arange(n)
    whole = at + width <= last
    whole |= at == w.first[:-1][w.doc]
    at = at[whole]
    last = last[whole]
    out = np.full(len(at), width, np.uint64)
    for k in range(width):
        inside = at + k < last
        step = hashes[np.minimum(at + k, n - 1)]
        out = np.where(inside, mix(out * np.uint64(_BASE) + step), out)
    return out, at

"""Vectorised 64-bit hashes of the words of whole texts, for use inside tasks.

A word's hash is the sum of ``code[byte] * RADIX**offset`` modulo 2**64, taken from one
running sum over a bite of text, then mixed. ``code`` gives A-Z the codes of a-z.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_RADIX = 0x9E3779B97F4A7C15
_UNRADIX = pow(_RADIX, -1, 2**64)
U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_CODE = mix(np.arange(1, 257, dtype=U) * U(_RADIX))
_LOWER = _CODE.copy()
_LOWER[65:91] = _CODE[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_up, _down = np.ones(1, U), np.ones(1, U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the radix and of its inverse."""
    global _up, _down
    while len(_up) < n:
        k = len(_up)
        _up = np.concatenate([_up, _up * U(pow(_RADIX, k, 2**64))])
        _down = np.concatenate([_down, _down * U(pow(_UNRADIX, k, 2**64))])
    return _up[:n], _down[:n]


def running(data: np.ndarray, code: np.ndarray = _CODE) -> np.ndarray:
    """Sums of the coded bytes before each place; one longer than ``data``."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(code[data] * powers(len(data))[0], out=out[1:])
    return out


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff(_IS_SPACE[raw].astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, np.empty(0, U)
    sums = running(raw, _LOWER)
    return starts, mix((sums[ends] - sums[starts]) * powers(len(raw))[1][starts] + U(_RADIX) * (ends - starts).astype(U))


def _pieces(text: bytes, bite: int) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + bite)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def words_by_doc(texts: list[bytes], bite: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield ``first, hashes, counts``: word hashes of the texts from ``first`` on, end to end.

    About ``bite`` bytes are hashed at a time; a longer text comes alone and is cut at white
    space inside.
    """
    at = 0
    while at < len(texts):
        if len(texts[at]) > bite:
            parts = [_words(p)[1] for p in _pieces(texts[at], bite)]
            whole = np.concatenate(parts)
            yield at, whole, np.array([len(whole)])
            at += 1
            continue
        upto, total = at, 0
        while upto < len(texts) and total + len(texts[upto]) <= bite:
            total += len(texts[upto]) + 1
            upto += 1
        upto = max(upto, at + 1)
        lengths = np.fromiter(map(len, texts[at:upto]), np.int64, upto - at) + 1
        starts, hashes = _words(b"\n".join(texts[at:upto]))
        counts = np.bincount(np.searchsorted(np.cumsum(lengths), starts, "right"), minlength=upto - at)
        yield at, hashes, counts
        at = upto

"""Vectorised words and word hashes of many texts at once, on their UTF-8 bytes.

The word classes used here are sets of ASCII bytes plus every byte of a
non-ASCII character, so cutting bytes cuts characters correctly.  A word's
name is a 64-bit polynomial hash of its bytes, mixed; equal words have equal
names, and different words differ but for about one pair in 2^57.
"""

from __future__ import annotations

from functools import cache

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2^64
MULT = U(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

#: `[^\x20\x09-\x0D]`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, BASE, U), np.full(n, pow(BASE, -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(max(21, int(n).bit_length()))
    return up[:n + 1], down[:n + 1]


def spans(buf: np.ndarray, off: np.ndarray, member: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the number of words before it (one more at the end).

    A word also begins at each place in ``cuts``.
    """
    n = len(buf)
    w = np.zeros(n + 2, bool)
    w[1:-1] = member[buf]
    cut = np.zeros(n + 1, bool)  # a text begins here
    cut[off] = True
    if cuts is not None:
        cut[cuts] = True
    starts = np.flatnonzero(w[1:-1] & (~w[:-2] | cut[:-1]))
    ends = np.flatnonzero(w[1:-1] & (~w[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off, "left")


def names(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit name of each span."""
    up, down = powers(len(buf))
    sums = np.zeros(len(buf) + 1, U)
    np.cumsum(((LOWER[buf] if lower else buf).astype(U) + U(1)) * up[:len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def grams(word: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of every ``size`` consecutive words, the text of each and its first word, in text order."""
    full = np.maximum(np.diff(first) - size + 1, 0)
    text = np.repeat(np.arange(len(full)), full)
    at = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full) + np.repeat(first[:-1], full)
    name = np.full(len(at), size, U)
    for j in range(size):
        name = mix(name * MULT + word[at + j])
    return name, text, at


def shingles(word: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and texts of the ``size``-word shingles; a text with fewer words, but not none, has one of all its words."""
    parts = [grams(word, first, size)[:2]]
    for fewer in range(1, size):
        short = np.diff(first) == fewer
        if short.any():
            name, text, _ = grams(word, first, fewer)
            parts.append((name[short[text]], text[short[text]]))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

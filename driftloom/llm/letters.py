"""Hashed features of texts: character n-grams and beginnings of words, computed on arrays of code points.

Defined cases: a text without letters has no features; callers pass empty texts for null ones; no texts have no
features; letters are what ``str.isalpha`` says of the lower-cased text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

from .common import mix64, powers

CODE_BASE, SPREAD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
#: n-grams at a time
BLOCK = 1 << 15


@functools.cache
def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in lower case, each with a line feed before and after; offsets of the texts (their first line feed)."""
    low = [t.lower() for t in texts]
    lengths = np.fromiter((len(t) + 1 for t in low), np.int64, len(low))
    joined = "\n" + "\n".join(low) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(lengths)])


def compacted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts' letters, with one edge (32) for each run of other characters and before each text; the
    texts' offsets among them."""
    points, at = code_points(texts)
    letters = letter_table()[points]
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    keep[at] = True
    starts = np.cumsum(keep, dtype=np.int32)[at] - 1
    out = points[keep]
    out[~letters[keep]] = 32
    return out, starts


def ngram_blocks(points: np.ndarray, at: np.ndarray, orders: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature, text) of each n-gram of letters and edges with 1 to ``orders`` characters, a block at a time: what a block takes
    doesn't depend on the length of a text."""
    size = at[-1]  # the edge after the last text is no n-gram's start
    for low in range(0, size, BLOCK):
        high = min(low + BLOCK, size)
        some = points[low : high + orders - 1].astype(np.uint64)
        text = np.searchsorted(at, np.arange(low, low + len(some)), side="right") - 1
        h = np.zeros(high - low, np.uint64)
        for n in range(1, orders + 1):
            m = min(high - low, len(some) - n + 1)
            h = h[:m] * CODE_BASE + some[n - 1 : n - 1 + m]
            ok = text[:m] == text[n - 1 : n - 1 + m] if n > 1 else some[:m] != 32
            feature = ((h ^ (h >> np.uint64(29))) * SPREAD) >> np.uint64(64 - bits)
            yield feature[ok].astype(np.int64), text[:m][ok]


def letter_counts(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Letters of each text."""
    return np.diff(np.concatenate([[0], np.cumsum(points != 32, dtype=np.int64)])[at])


def word_features(texts: list[str], prefixes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of each word of letters: the whole word and its beginnings of the given lengths."""
    points, at = code_points(texts)
    letters = letter_table()[points]
    first = letters.copy()
    first[1:] &= ~letters[:-1]
    last = letters.copy()
    last[:-1] &= ~letters[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(at, starts, side="right") - 1
    n = len(points)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(points.astype(np.uint64) + np.uint64(1)) * powers(CODE_BASE, n), dtype=np.uint64, out=sums[1:])
    inverse = powers(np.uint64(pow(int(CODE_BASE), -1, 2**64)), n + 1)
    features, owners = [], []
    for k in (0, *prefixes):  # 0: the whole word
        some = slice(None) if not k else np.flatnonzero(ends - starts > k)
        a = starts[some]
        b = ends[some] if not k else a + k
        h = (sums[b] - sums[a]) * inverse[a] + np.uint64(k)
        features.append((mix64(h) >> np.uint64(64 - bits)).astype(np.int64))
        owners.append(text[some])
    owner, feature = np.concatenate(owners), np.concatenate(features)
    order = np.argsort(owner, kind="stable")
    return feature[order], owner[order]

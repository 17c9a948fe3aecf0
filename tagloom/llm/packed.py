"""Vectorised views of text batches: one array of code points for a whole Arrow batch.

Every function here works on NumPy arrays only, so a batch of thousands of texts costs a
handful of array passes instead of a Python loop over characters.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Odd multiplier of the polynomial hashes (ring of 64-bit integers) and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts one after the other, and the offsets of the texts (one more than texts)."""
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offsets[1:])
    return np.frombuffer(joined, np.uint32), offsets


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    k = 1
    while k < n:  # doubling: powers k..2k are powers 0..k times the k-th
        m = min(k, n - k)
        up[k : k + m] = up[:m] * np.uint64(pow(BASE, k, 1 << 64))
        down[k : k + m] = down[:m] * np.uint64(pow(INVERSE, k, 1 << 64))
        k += m
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n; computed once per process for the next power of two."""
    up, down = _powers(1 << max(10, (n - 1).bit_length()))
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the entropy of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any run of symbols comes by one subtraction and one product."""
    _, down = powers(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * down[:-1], out=sums[1:])
    return sums


def run_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs [start, end) that depend on their symbols only."""
    up, _ = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * up[starts])


def window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` symbols, by its start."""
    up, _ = powers(len(sums))
    n = len(sums) - width
    if n <= 0:
        return np.empty(0, np.uint64)
    return mix((sums[width:] - sums[:n]) * up[:n])


@lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """For each code point whether it is a Unicode letter or digit (or a mark inside a word)."""
    import unicodedata

    table = np.zeros(0x110000, bool)
    for start in range(0, 0x110000):
        if 0xD800 <= start < 0xE000:
            continue
        if unicodedata.category(chr(start))[0] in "LNM":
            table[start] = True
    return table


def words(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of letters and digits; runs never cross texts."""
    inside = word_table()[points]
    edge = np.zeros(len(points) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(points), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(points), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends

"""The sequence ratio of many pairs of short texts at once: what difflib finds, one numpy step a letter for many pairs."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: From so many letters on, difflib leaves out frequent letters; such pairs go to difflib itself. Pieces per step.
LONG, BATCH = 200, 1024


def _letters(values: list[str]) -> np.ndarray:
    """One row of code points per value, filled up with zeros."""
    longest = max(map(len, values))
    return np.array(values, dtype=f"<U{longest}").view(np.uint32).reshape(len(values), longest)


def _longest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, end in x, end in y) of the longest common piece of each column, the first of several."""
    runs, back = np.zeros((len(y) + 1, x.shape[1]), np.uint16), (255 - np.arange(len(y))).astype(np.uint16)[:, None]  # runs in the upper byte
    best, end = np.zeros(x.shape[1], np.uint16), np.zeros(x.shape[1], np.uint16)
    for k, letters in enumerate(x, 1):
        runs[1:] = (runs[:-1] + np.uint16(256)) * (y == letters).view(np.uint8).astype(np.uint16)
        top = (runs[1:] | back).max(0)  # of equal runs the one that ends first
        better = (top >> 8) > (best >> 8)
        np.copyto(best, top, where=better)
        np.copyto(end, np.uint16(k), where=better)
    return (best >> 8).astype(int), end.astype(int), 256 - (best & 255).astype(int)


def _matching(left: list[str], right: list[str]) -> np.ndarray:
    """How many letters the matching blocks of each pair hold: the longest common piece, then those on both sides of it."""
    a, b = _letters(left), _letters(right)
    total = np.zeros(len(left), int)
    n = np.arange(len(left))
    todo = np.stack([n, 0 * n, list(map(len, left)), 0 * n, list(map(len, right))])  # pair, from and to on both sides
    while todo.shape[1]:
        todo = todo[:, np.lexsort((todo[2] - todo[1], todo[4] - todo[3]))]  # pieces of like lengths need little filling up
        parts = []
        for s in range(0, todo.shape[1], BATCH):
            p, alo, ahi, blo, bhi = todo[:, s : s + BATCH]
            rows, cols = np.arange((ahi - alo).max())[:, None], np.arange((bhi - blo).max())[:, None]
            x = np.where(alo + rows < ahi, a[p, np.minimum(alo + rows, a.shape[1] - 1)], np.uint32(0xFFFFFFFE))
            y = np.where(blo + cols < bhi, b[p, np.minimum(blo + cols, b.shape[1] - 1)], np.uint32(0xFFFFFFFF))
            size, i, j = _longest(x, y)
            total += np.bincount(p, size, len(total)).astype(int)
            i, j = alo + i - size, blo + j - size
            before, after = (size > 0) & (i > alo) & (j > blo), (size > 0) & (i + size < ahi) & (j + size < bhi)
            parts += [np.stack([p, alo, i, blo, j])[:, before], np.stack([p, i + size, ahi, j + size, bhi])[:, after]]
        todo = np.concatenate(parts, axis=1)
    return total


def ratios(left: list[str], right: list[str]) -> np.ndarray:
    """`SequenceMatcher(None, left, right).ratio()` of each pair; the order of arguments matters."""
    m, n = np.array(list(map(len, left)), int), np.array(list(map(len, right)), int)
    out = np.where(m + n == 0, 1.0, 0.0)
    long = (np.maximum(m, n) >= LONG) & (np.minimum(m, n) > 0)
    for k in np.flatnonzero(long):
        out[k] = SequenceMatcher(None, left[k], right[k]).ratio()
    short = np.flatnonzero((np.minimum(m, n) > 0) & ~long)
    for at in np.split(short, range(32 * BATCH, len(short), 32 * BATCH)):
        if len(at):
            out[at] = 2.0 * _matching([left[k] for k in at], [right[k] for k in at]) / (m + n)[at]
    return out

"""The best albums of each local release inside blocks of one artist, without a row for every pair that meets.

A task holds the distinct releases and albums of some blocks. What bounds a score (lengths, common words and common
letters) is a matrix operation for all pairs; the sequence ratio runs only for pairs that may still be among the best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

from tagloom.functions import text
from tagloom.functions.sequences import ratios

#: Pairs bounded at once, candidates scored at once, best bounds scored in the first rounds.
CELLS, POOL, ROUNDS = 400_000, 400_000, (16, 64)
#: Blocks of more albums are bounded release by release.
FEW = 256
#: Slack of bounds against rounding.
EPS = 1e-9


def _counts(names: list[str]) -> np.ndarray:
    """How often letters of each of 32 kinds occur in each name, (kinds, names)."""
    out = np.zeros((len(names), 32), np.uint16 if max(map(len, names)) > 255 else np.uint8)
    sizes = np.array(list(map(len, names)))
    kinds = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32) & 31
    np.add.at(out, (np.repeat(np.arange(len(names)), sizes), kinds), 1)
    return np.ascontiguousarray(out.T)


def _masks(names: list[str]) -> dict[str, np.ndarray]:
    """Per letter the places it has in each name, as bits; names of more than 64 letters have none."""
    out: dict[str, np.ndarray] = {}
    for k, name in enumerate(names):
        if len(name) <= 64:
            for i, c in enumerate(name):
                if c not in out:
                    out[c] = np.zeros(len(names), np.uint64)
                out[c][k] |= np.uint64(1 << i)
    return out


def _subsequence(left: str, masks: dict[str, np.ndarray], j: np.ndarray) -> np.ndarray:
    """Letters of the longest common subsequence of `left` with the names `j`; matching blocks hold no more."""
    v = np.full(len(j), 0xFFFFFFFFFFFFFFFF, np.uint64)
    at = {c: masks[c][j] for c in set(left) if c in masks}
    for c in left:
        if c in at:
            u = v & at[c]
            v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


class _Block:
    """Releases against albums of one artist block: lists of albums and artists, arrays of years and counts of both."""

    def __init__(self, l: tuple, r: tuple, gate: float):
        self.gate, self.ln, self.rn = gate, l[0], r[0]
        self.lc, self.rc = _counts(self.ln), _counts(self.rn)
        self.lsize, self.rsize = np.array(list(map(len, self.ln))), np.array(list(map(len, self.rn)))
        self.lwords, rwords = [set(x.split()) for x in self.ln], [set(x.split()) for x in self.rn]
        self.lw, self.rw = np.array(list(map(len, self.lwords))), np.array(list(map(len, rwords)))
        places: dict[str, list[int]] = {}
        for k, words in enumerate(rwords):
            for w in words:
                places.setdefault(w, []).append(k)
        self.places = {w: np.array(k) for w, k in places.items()} if len(self.rn) > FEW else places
        la, ra = {x: n for n, x in enumerate(dict.fromkeys(l[1]))}, {x: n for n, x in enumerate(dict.fromkeys(r[1]))}
        self.artist = np.array([[(1.0 if x == y else text.similarity(x, y)) if text.same_artist(x, y) else -1.0 for y in ra] for x in la])
        self.lcode, self.rcode = np.array([la[x] for x in l[1]]), np.array([ra[x] for x in r[1]])
        self.ly, self.lk, self.ry, self.rk = *l[2:], *r[2:]
        self.short = self.rsize <= 64
        self.masks: dict[str, np.ndarray] | None = None

    def candidates(self, s: slice) -> tuple[np.ndarray, ...]:
        """(row, column, common words share, artist, exact, near, bound) of the pairs of some releases that may reach the gate or have equal counts."""
        words = self.lwords[s]
        shared = np.zeros((len(words), len(self.rn)), np.int32)
        for k, own in enumerate(words):
            for w in own:
                if w in self.places:
                    shared[k, self.places[w]] += 1
        either = self.lw[s, None] + self.rw - shared
        overlap = np.where(either > 0, shared / np.maximum(either, 1), 0.0)
        sizes = self.lsize[s, None] + self.rsize
        exact = self.lk[s, None] == self.rk
        artist = self.artist[self.lcode[s]][:, self.rcode]
        most = 0.65 * (2 * np.minimum(self.lsize[s, None], self.rsize) / np.maximum(sizes, 1)) + 0.35 * overlap
        i, j = np.nonzero((artist >= 0) & (exact | (most >= self.gate - EPS)))
        common = np.zeros(len(i), np.int64)
        l, r = self.lc[:, s], self.rc
        ends = np.searchsorted(i, np.arange(len(words) + 1))
        if len(self.rn) > FEW:
            for k in range(len(words)):
                at = slice(ends[k], ends[k + 1])
                common[at] = np.minimum(l[:, k, None], r[:, j[at]]).sum(0, dtype=np.uint32 if r.dtype.itemsize > 1 else np.uint16)
        else:
            for k in range(0, len(i), 65536):
                x, y = i[k : k + 65536], j[k : k + 65536]
                common[k : k + 65536] = sum(np.minimum(l[c, x], r[c, y]).astype(np.int32) for c in range(32))
        for k in np.flatnonzero(np.diff(ends) > ROUNDS[0]):  # the letters' order bounds closer where not all are scored anyway
            self.masks = self.masks or _masks(self.rn)
            at = np.arange(ends[k], ends[k + 1])
            at = at[self.short[j[at]]]
            common[at] = np.minimum(common[at], _subsequence(self.ln[(s.start or 0) + k], self.masks, j[at]))
        overlap, exact, artist = overlap[i, j], exact[i, j], artist[i, j]
        near = ~(np.abs(self.ly[s][i] - self.ry[j]) > 1)
        bound = 0.65 * (2.0 * common / np.maximum(sizes[i, j], 1)) + 0.35 * overlap
        keep = exact | (bound >= self.gate - EPS)
        i, j, overlap, artist, exact, near, bound = (v[keep] for v in (i, j, overlap, artist, exact, near, bound))
        return i + (s.start or 0), j, overlap, artist, exact, near, _total(np.minimum(bound, 1.0), artist, exact, near)


def _total(album: np.ndarray, artist: np.ndarray, exact: np.ndarray, near: np.ndarray) -> np.ndarray:
    return 0.52 * album + 0.33 * artist + 0.10 * exact.astype(float) + 0.05 * near.astype(float)


def _places(row: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, place of each in its row from 0) by row, then the keys."""
    order = np.lexsort((*keys[::-1], row))
    r = row[order]
    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.array([], int)
    return order, np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)]))


def _album_scores(left: list[str], right: list[str], overlap: np.ndarray) -> np.ndarray:
    """`text.similarity` of folded names whose share of common words is known."""
    out = np.zeros(len(left))
    unlike: dict[tuple[str, str], list[int]] = {}
    for k, (x, y) in enumerate(zip(left, right, strict=True)):
        if x and x == y:
            out[k] = 1.0
        elif x and y:
            unlike.setdefault((x, y), []).append(k)
    if unlike:
        for at, ratio in zip(unlike.values(), ratios([x for x, _ in unlike], [y for _, y in unlike]), strict=True):
            out[at] = 0.65 * ratio + 0.35 * overlap[at]
    return out


def _best(row: np.ndarray, pairs: tuple[np.ndarray, ...], left: np.ndarray, right: np.ndarray, gate: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, score) of the candidates that may be among the k best of their row; the rows of one release are complete."""
    overlap, artist, exact, near, bound = pairs
    order, place = _places(row, -bound)
    rank = np.empty(len(row), int)
    rank[order] = place
    score, done, least = np.full(len(row), -1.0), np.zeros(len(row), bool), np.full(row.max() + 1 if len(row) else 0, -1.0)
    for limit in (*ROUNDS, len(row) + 1):
        at = np.flatnonzero(~done & (rank < limit) & (bound >= least[row] - EPS))
        if len(at):
            album = _album_scores(left[at].tolist(), right[at].tolist(), overlap[at])
            score[at] = np.where(exact[at] | (album >= gate), _total(album, artist[at], exact[at], near[at]), -1.0)
            done[at] = True
        good = np.flatnonzero(score >= 0)
        order, place = _places(row[good], -score[good])
        kth = good[order[place == k - 1]]
        least[row[kth]] = score[kth]
    at = np.flatnonzero((score >= 0) & (score >= least[row]))
    return at, score[at]


def searcher(gate: float, k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Grouped map over the rows (block, tile, side, id, ids, album, artist, year, count) of whole blocks and tiles -> the
    k best albums (lead, collection_id, place, search_score) of every release (side 0); an album (side 1) stands for its `ids`."""

    def flush(pool: list[tuple]) -> pd.DataFrame:
        row = np.concatenate([p[0] for p in pool])
        leads, ids, left, right = (np.concatenate([p[n] for p in pool]) for n in range(1, 5))
        at, score = _best(row, tuple(np.concatenate([p[5][n] for p in pool]) for n in range(5)), left, right, gate, k)
        sizes = np.array([len(ids[n]) for n in at], int)
        row, lead, score = np.repeat(row[at], sizes), np.repeat(leads[at], sizes), np.repeat(score, sizes)
        album = np.array([x for n in at for x in ids[n]], np.int64)
        order, place = _places(row, -score, album)
        order, place = order[place < k], place[place < k] + 1
        return pd.DataFrame({"lead": lead[order], "collection_id": album[order], "place": place.astype(np.int32), "search_score": score[order]})

    def parts(pdf: pd.DataFrame) -> Iterator[tuple[int, tuple]]:
        rows = 0
        pdf = pdf.sort_values(["block", "tile", "side"], kind="stable")
        block, tile, side, lead = (pdf[c].to_numpy() for c in ("block", "tile", "side", "id"))
        ids, album, artist = (pdf[c].tolist() for c in ("ids", "album", "artist"))
        year, count = (pdf[c].to_numpy(dtype="float64", na_value=np.nan) for c in ("year", "count"))
        ends = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (tile[1:] != tile[:-1]), True])
        for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            m = a + int((side[a:z] == 0).sum())
            if m in (a, z):
                continue
            b = _Block((album[a:m], artist[a:m], year[a:m], count[a:m]), (album[m:z], artist[m:z], year[m:z], count[m:z]), gate)
            l, r = range(a, m), range(m, z)
            own, names, kept = (np.fromiter(v, object, len(v)) for v in (b.ln, b.rn, ids[m:z]))
            step = max(1, CELLS // len(r))
            for s in range(0, len(l), step):
                i, j, *pairs = b.candidates(slice(s, min(s + step, len(l))))
                yield len(i), (i + rows, lead[a + i], kept[j], own[i], names[j], pairs)
            rows += len(l)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, pool, held = [pd.DataFrame({"lead": np.array([], np.int64), "collection_id": np.array([], np.int64), "place": np.array([], np.int32), "search_score": np.array([])})], [], 0
        for n, part in parts(pdf):
            pool, held = [*pool, part] if n else pool, held + n
            if held >= POOL:
                out, pool, held = [*out, flush(pool)], [], 0
        return pd.concat([*out, flush(pool)] if pool else out)

    return run

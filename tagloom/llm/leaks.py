"""Problem 9: evaluation passages inside training documents.

Method: pigeonhole edit matching. A passage window of 20 words with at most two word edits is cut by
those edits into at most three runs, so one run of six words is intact: every run of six words of every
item is an exact piece. Documents are scanned once for piece hits (64-bit hashes, looked up by binary
search); hits are verified with Myers' bit-parallel edit distance over words on the whole item.

The pieces of the items are broadcast: the item set is held-out test material of a few thousand texts at
most, which does not grow with the corpus. Its size is checked; beyond `ITEM_LIMIT` words the documents are scanned
in blocks of items instead (each block within the bound).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import packed
from tagloom.llm.spans import GROUP, groups

#: Shortest leak in words, one edit allowed in so many words, and the intact run this guarantees.
WORDS, EDIT_EVERY, PIECE = 20, 10, 6
#: Most item pieces that are broadcast (16 bytes each).
ITEM_LIMIT = 2_000_000
#: An opening or closing sentence that at least so many items share is a stock question, not passage.
STOCK = 5


def word_list(text: str) -> list[str]:
    """Runs of letters, digits and marks in lower case."""
    return re.findall(r"[^\W_]+", text.lower())


def word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code for each word of a batch of texts, and for each text the index of its first word (one more than texts)."""
    lowered = [t.lower() for t in texts]
    points, offsets = packed.code_points(lowered)
    if not len(points):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    starts, ends = packed.words(points, offsets)
    return packed.run_hashes(packed.prefix_sums(points), starts, ends), np.searchsorted(starts, offsets)


def passages(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, passage): the items without the stock sentences many of them open with and without `Answer: X` at the end."""
    body = F.regexp_replace(F.col(text), r"\s*Answer:\s*\p{L}\s*$", "")
    opening = F.regexp_extract(body, r"^\s*(.*?[.?!:])\s", 1)
    cleaned = items.where(F.col(text).isNotNull()).select(F.col(key).alias("item"), body.alias("body"), opening.alias("opening"))
    stock = cleaned.where("opening <> ''").groupBy("opening").agg(F.count("*").alias("n")).where(F.col("n") >= STOCK).select("opening", F.lit(True).alias("stock"))
    joined = cleaned.join(stock, "opening", "left")
    return joined.select("item", F.when(F.col("stock"), F.expr("substr(ltrim(body), length(ltrim(opening)) + 1)")).otherwise(F.col("body")).alias("passage"))


def myers(pattern: list[int], text: list[int]) -> tuple[int, list[int]]:
    """Myers' bit-parallel approximate matching: for each end in `text` the least edits of `pattern` against a stretch ending there."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | (1 << i)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = mask, 0, m, []
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        out.append(score)
    return min(out, default=m), out


def leaks(item: list[int], doc: list[int], hits: list[tuple[int, int]]) -> bool:
    """Whether `doc` holds 20 or more consecutive words of `item` with at most one edit in ten words.

    `hits` are all (item position, document position) of intact pieces. A window of L words with b edits keeps
    at least L - PIECE + 1 - b * PIECE of its pieces (each edit destroys at most PIECE of them), so only windows
    with that many hits on neighbouring diagonals are verified. Longer stretches are tried in steps of ten
    words, which is where the allowance grows.
    """
    n = len(item)
    if n < WORDS:
        return False
    hits = sorted(hits, key=lambda h: h[1] - h[0])
    most = n // EDIT_EVERY
    a = 0
    while a < len(hits):  # a band of diagonals without a gap of more than the largest allowance
        b = a + 1
        while b < len(hits) and (hits[b][1] - hits[b][0]) - (hits[b - 1][1] - hits[b - 1][0]) <= most:
            b += 1
        if _band(item, doc, hits[a:b]):
            return True
        a = b
    return False


def _band(item: list[int], doc: list[int], hits: list[tuple[int, int]]) -> bool:
    n = len(item)
    present = np.zeros(n + 1, np.int64)
    place: dict[int, list[int]] = {}
    for at, where in hits:
        present[at + 1] = 1
        place.setdefault(at, []).append(where)
    total = np.cumsum(present)
    at_all = sorted(place)
    for length in range(WORDS, n + 1, EDIT_EVERY):
        budget = length // EDIT_EVERY
        need = max(1, length - PIECE + 1 - budget * PIECE)
        starts = np.arange(0, n - length + 1)
        enough = starts[total[starts + length - PIECE + 1] - total[starts] >= need]
        for start in enough.tolist():
            k = bisect_left(at_all, start)
            tried: set[int] = set()
            for where in place[at_all[k]]:
                low = max(0, where - (at_all[k] - start) - budget)
                if low in tried:
                    continue
                tried.add(low)
                if myers(item[start : start + length], doc[low : low + length + 2 * budget])[0] <= budget:
                    return True
    return False


def _scan(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        keys, first, owner, place = table["keys"], table["first"], table["owner"], table["place"]
        bits = table["bits"]
        for pdf in batches:
            for part in groups(pdf["text"], GROUP):
                codes, begins = word_codes(pdf["text"].iloc[part].tolist())
                rows = []
                if len(codes) >= PIECE:
                    pieces = packed.window_hashes(packed.prefix_sums(codes), PIECE)
                    maybe = np.flatnonzero(bits[(pieces >> np.uint64(40)).astype(np.int64)])
                    found = np.searchsorted(keys, pieces[maybe])
                    ok = (found < len(keys)) & (keys[np.minimum(found, len(keys) - 1)] == pieces[maybe])
                    at, slot = maybe[ok], found[ok]
                    doc = np.searchsorted(begins, at, side="right") - 1
                    inside = at + PIECE <= begins[doc + 1]
                    pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
                    for a, s, d in zip(at[inside].tolist(), slot[inside].tolist(), doc[inside].tolist(), strict=True):
                        for k in range(first[s], first[s + 1]):
                            pairs.setdefault((d, int(owner[k])), []).append((int(place[k]), a - int(begins[d])))
                    ids = pdf["id"].to_numpy()[part]
                    words: dict[int, list[int]] = {}
                    for (d, item), hits in pairs.items():
                        text = words.setdefault(d, codes[begins[d] : begins[d + 1]].tolist())
                        if leaks(table["items"][item], text, hits):
                            rows.append((ids[d], table["ids"][item]))
                yield pd.DataFrame({"id": np.array([r[0] for r in rows], np.int64), "item": np.array([r[1] for r in rows], np.int64)})

    return run


def item_table(ids: list[int], texts: list[str]) -> dict:
    """The searchable form of the items: sorted piece hashes with their owners and places, and a bitmap of their top bits."""
    codes, begins = word_codes(texts)
    hashes = packed.window_hashes(packed.prefix_sums(codes), PIECE)
    hashes = np.append(hashes, packed.run_hashes(packed.prefix_sums(codes), np.array([len(codes) - PIECE]), np.array([len(codes)]))) if len(codes) >= PIECE else hashes
    at = np.arange(len(hashes))
    owner = np.searchsorted(begins, at, side="right") - 1
    inside = at + PIECE <= begins[owner + 1]
    hashes, owner, place = hashes[inside], owner[inside], (at - begins[owner])[inside]
    order = np.argsort(hashes, kind="stable")
    keys, first = np.unique(hashes[order], return_index=True)
    bits = np.zeros(1 << 24, bool)
    bits[(keys >> np.uint64(40)).astype(np.int64)] = True
    return {"keys": keys, "first": np.append(first, len(order)).astype(np.int64), "owner": owner[order], "place": place[order], "bits": bits, "ids": ids, "items": [codes[begins[i] : begins[i + 1]].tolist() for i in range(len(ids))]}


def leaked(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(id, item): every document that holds at least 20 consecutive words of the passage of an item, nearly letter by letter.

    Null and empty texts leak nothing, nor do passages of fewer than 20 words. Every document is scanned as a
    whole. Repeated documents each get their rows. With no items there are no rows.
    """
    spark = docs.sparkSession
    taken = passages(items, item_key, item_text)
    size = taken.agg(F.sum(F.size(F.split("passage", r"\s+"))).alias("words")).first()["words"] or 0
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    out = rows.select("id", F.lit(0).cast("long").alias("item")).where("false")
    blocks = 1 + int(size) // ITEM_LIMIT
    for b in range(blocks):
        part = taken.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else taken
        local = part.orderBy("item").toPandas()  # one block of held-out items, about ITEM_LIMIT words at most
        if len(local):
            shared = spark.sparkContext.broadcast(item_table(local["item"].tolist(), local["passage"].tolist()))
            found = rows.mapInPandas(_scan(shared), "id long, item long")
            out = found if b == 0 else out.unionByName(found)
    return out

"""Problem 10: long exact spans shared between records.

Method: super-k-mer partitioning. Every window of `LENGTH` characters has a minimiser, the piece of
`PIECE` characters in it with the smallest hash; consecutive windows that share it travel as one packed
string to the bucket of that minimiser, where the windows are sorted and counted exactly.

Before text moves, three things shrink it: copies of whole texts are collapsed (a copy is shared as a
whole), minimisers that occur in one text only are dropped on the strength of their hashes, and equal
packed strings are counted by the map side. Buckets of a minimiser that very many records hold are not
gathered in one task: their windows are counted by a distributed aggregate over window fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import packed
from tagloom.operators.streamed import grouped_rows
from tagloom.session import cut

LENGTH = 300
#: Length of the minimisers; a window has LENGTH - PIECE + 1 of them.
PIECE = 150
#: Buckets with more packed strings than this are counted by fingerprints instead of inside one task.
BUCKET = 5_000
#: Characters per group of texts worked on at once in a Python worker.
GROUP = 1_000_000


def minimisers(points: np.ndarray, offsets: np.ndarray, length: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers of a batch of texts: (text, first window, last window, hash of the minimiser).

    Positions count from the start of each text. The leftmost of equal hashes is the minimiser, so
    equal windows have equal minimisers at equal places wherever they occur.
    """
    w = length - piece + 1
    n = len(points)
    if n < length:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, np.empty(0, np.uint64)
    hashes = packed.window_hashes(packed.prefix_sums(points), piece)
    hashes = np.append(hashes, hashes[-1:]) if len(hashes) == n - piece else hashes  # last window of the batch
    m = len(hashes)
    # sliding minimum with its position: blocks of w, suffix minima of one block and prefix minima of the next
    blocks = -(-m // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = hashes
    grid = padded.reshape(blocks, w)
    front = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    low = np.minimum(back[:count], front[w - 1 : w - 1 + count])
    # windows inside one text
    text = np.searchsorted(offsets, np.arange(count), side="right") - 1
    valid = np.arange(count) + length <= offsets[text + 1]
    # a run ends where the minimum changes, or where the next window's minimum is another occurrence of the same hash
    starts = np.flatnonzero(valid & np.concatenate(([True], (low[1:] != low[:-1]) | ~valid[:-1] | (text[1:] != text[:-1]))))
    ends = np.flatnonzero(valid & np.concatenate(((low[1:] != low[:-1]) | ~valid[1:] | (text[1:] != text[:-1]), [True])))
    return text[starts], starts - offsets[text[starts]], ends - offsets[text[starts]], low[starts]


def _super_kmers(length: int, piece: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in groups(pdf["text"], GROUP):
                texts = pdf["text"].iloc[part].tolist()
                points, offsets = packed.code_points(texts)
                text, first, last, low = minimisers(points, offsets, length, piece)
                ids, marks = pdf["id"].to_numpy()[part], pdf["h"].to_numpy()[part]
                yield pd.DataFrame({"key": low.view(np.int64), "id": ids[text], "h": marks[text], "first": first.astype(np.int32), "last": last.astype(np.int32)})

    return run


def groups(texts: pd.Series, size: int) -> list[slice]:
    """Consecutive slices of about `size` characters (a longer text makes a slice of its own)."""
    total = texts.str.len().to_numpy().cumsum()
    out, start = [], 0
    while start < len(texts):
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + size, side="right")))
        out.append(slice(start, end))
        start = end
    return out


def _slices(length: int):
    """(id, text, runs) -> one row per surviving super-k-mer with its packed string."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r["key"], i, r["first"], t[r["first"] : r["last"] + length]) for i, t, runs in zip(pdf["id"], pdf["text"], pdf["runs"], strict=True) for r in runs]
            for k in range(0, len(rows), 20_000):
                yield pd.DataFrame(rows[k : k + 20_000], columns=["key", "id", "first", "packed"])

    return run


def _count_bucket(length: int):
    """One bucket of rows (key, packed, low_id, high_id), equal strings combined -> windows found in two texts or more."""

    def run(rows: list[tuple]) -> list[tuple]:
        if len(rows) == 1 and rows[0][2] == rows[0][3]:
            return []
        windows = [(r[1][k : k + length], i, k) for i, r in enumerate(rows) for k in range(len(r[1]) - length + 1)]
        windows.sort()
        shared: dict[int, list[int]] = {}
        a = 0
        for b in range(1, len(windows) + 1):
            if b == len(windows) or windows[b][0] != windows[a][0]:
                if len({x for _, i, _ in windows[a:b] for x in rows[i][2:4]}) > 1:
                    for _, i, k in windows[a:b]:
                        shared.setdefault(i, []).append(k)
                a = b
        out = []
        for i, ks in shared.items():
            ks.sort()
            start = previous = ks[0]
            for k in [*ks[1:], 1 << 60]:
                if k > previous + 1:
                    out.append((rows[i][0], rows[i][1], start, previous))
                    start = k
                previous = k
        return out

    return run


def _fingerprints(length: int):
    """Packed strings of hot buckets -> one 128-bit fingerprint per window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in groups(pdf["packed"], GROUP):
                points, offsets = packed.code_points(pdf["packed"].iloc[part].tolist())
                n = len(points) - length + 1
                start = np.arange(max(0, n))
                text = np.searchsorted(offsets, start, side="right") - 1
                good = start + length <= offsets[text + 1]
                start, text = start[good], text[good]
                one = packed.run_hashes(packed.prefix_sums(points), start, start + length)
                two = packed.run_hashes(packed.prefix_sums(packed.mix(points.astype(np.uint64) + np.uint64(77))), start, start + length)
                ids = pdf["id"].to_numpy()[part][text]
                first = pdf["first"].to_numpy()[part][text]
                yield pd.DataFrame({"a": one.view(np.int64), "b": two.view(np.int64), "id": ids, "window": (first + start - offsets[text]).astype(np.int32)})

    return run


def merge(spans: DataFrame) -> DataFrame:
    """(id, span_start, span_end): overlapping and touching spans of each text merged; a text's spans fit one row group."""
    s = spans.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("span_start", "span_end"))).alias("s"))
    folded = F.aggregate(
        "s",
        F.expr("cast(array() as array<struct<span_start:int,span_end:int>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["span_end"] >= x["span_start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["span_start"].alias("span_start"), F.greatest(F.element_at(acc, -1)["span_end"], x["span_end"]).alias("span_end")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x["span_start"].alias("span_start"), x["span_end"].alias("span_end"))))),
    )
    return s.select("id", F.explode(folded).alias("x")).select("id", "x.span_start", "x.span_end")


def shared_spans(docs: DataFrame, key: str, text: str, length: int = LENGTH, piece: int = PIECE, bucket: int = BUCKET) -> DataFrame:
    """(id, span_start, span_end): the merged ranges of each text that occur verbatim in another row, `length` characters at least.

    Offsets count code points. Null and shorter texts share nothing; copies of a whole text share all of it; a
    span repeated only inside one text is not shared. Keys must be distinct; other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.length("text") >= length)
    marks = cut(rows.select("id", F.xxhash64("text").alias("h1"), F.md5("text").alias("h2"), F.length("text").alias("n")))
    copies = cut(marks.groupBy("h1", "h2").agg(F.min("id").alias("kept"), F.count("*").alias("copies")).where("copies > 1"))
    whole = marks.join(copies, ["h1", "h2"]).select("id", "kept", "n")
    whole = cut(whole)
    # a minimiser that only copies of one text hold has one text hash; copies drop out of what is left, not of the texts
    kmers = cut(rows.withColumn("h", F.xxhash64("text")).mapInPandas(_super_kmers(length, piece), "key long, id long, h long, first int, last int"))
    counts = kmers.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count("*").alias("n")).where("a <> b").select("key", "n")
    alive = kmers.join(counts, "key").join(whole.where("id <> kept").select("id"), "id", "left_anti")
    runs = alive.groupBy("id").agg(F.collect_list(F.struct("key", "first", "last")).alias("runs"), F.max("n").alias("n"))
    sliced = rows.join(runs, "id").select("id", "text", "runs").mapInPandas(_slices(length), "key long, id long, first int, packed string")
    hot = counts.where(F.col("n") > bucket).select("key")
    sliced = cut(sliced.join(F.broadcast(hot).withColumn("hot", F.lit(True)), "key", "left"))
    # ordinary buckets: equal strings are counted before they move, then each bucket sorts its windows
    cool = sliced.where("hot IS NULL")
    strings = cool.groupBy("key", "packed").agg(F.min("id").alias("low_id"), F.max("id").alias("high_id"))
    found = grouped_rows(strings.select(F.col("key").alias("bucket"), "key", "packed", "low_id", "high_id"), "bucket", [], _count_bucket(length), "key long, packed string, from_window int, to_window int")
    ordinary = cool.join(found, ["key", "packed"]).select("id", (F.col("first") + F.col("from_window")).alias("span_start"), (F.col("first") + F.col("to_window") + length).alias("span_end"))
    # hot buckets: windows are counted by fingerprint, with partial aggregation before the shuffle
    prints = sliced.where("hot").mapInPandas(_fingerprints(length), "a long, b long, id long, window int")
    twice = prints.groupBy("a", "b").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("a", "b")
    heated = prints.join(twice, ["a", "b"], "left_semi").select("id", F.col("window").alias("span_start"), (F.col("window") + length).alias("span_end"))
    everything = whole.select("id", F.lit(0).alias("span_start"), F.col("n").cast("int").alias("span_end"))
    partly = ordinary.unionByName(heated).join(whole.select("id"), "id", "left_anti")
    return merge(partly.unionByName(everything))

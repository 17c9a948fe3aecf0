"""Problem 8: filling fixed-capacity containers with documents.

Method: sum-of-squares online packing. The open containers are counted by fill level; each document
goes to the level (or to a new container) that makes the sum of the squared counts smallest, which keeps
all levels available and so leaves little space in the end. The state is one array of levels.

Documents are dealt by a hash of their key into blocks of about `BLOCK` items, each packed by itself;
what the blocks leave open is packed once more, whole containers as items, in blocks of their own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.session import cut

CAPACITY = 2048
BLOCK = 20_000
#: Containers filled less than this after the first round are packed again.
LOOSE = 0.98
#: A public vocabulary file of ranks, and the public pattern that cuts text before merging.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, key: str, text: str, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(id, tokens): tokens of each whole text; null and empty texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(path, pattern).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "tokens": np.array([len(encode(t)) if t else 0 for t in pdf["text"]], np.int64)})

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInPandas(run, "id long, tokens long")


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container (0, 1, ...) of each item in order; items of size 0 go to container 0, sizes never exceed `capacity`."""
    counts = np.zeros(capacity + 1, np.int64)  # open containers by level; full ones leave the array
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.zeros(len(sizes), np.int64)
    made = 0
    for i, s in enumerate(sizes.tolist()):
        if s == 0:
            continue
        # change of the sum of squares, halved, for each level that has a container: counts[h + s] - counts[h] + 1
        reach = counts[1 : capacity - s + 1]
        best, where = counts[s] + 0.5 if s < capacity else 0.0, 0
        levels = np.flatnonzero(reach)
        if len(levels):
            after = counts[levels + 1 + s] + 1.0
            if levels[-1] + 1 + s == capacity:
                after[-1] = 0.5  # a container that becomes full leaves the sum
            change = after - reach[levels]
            k = len(change) - 1 - int(np.argmin(change[::-1]))  # of equal levels the fullest
            if change[k] <= best:
                where = int(levels[k]) + 1
        if where:
            counts[where] -= 1
            box = open_at[where].pop()
        else:
            box = made
            made += 1
        out[i] = box
        if where + s < capacity:
            counts[where + s] += 1
            open_at[where + s].append(box)
    return out


def _pack_block(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "id", "piece"], kind="stable")
        boxes = pack_sizes(pdf["size"].to_numpy(), capacity)
        return pd.DataFrame({"id": pdf["id"], "piece": pdf["piece"], "size": pdf["size"], "container": (pdf["block"].to_numpy(np.int64) << 32) + boxes})

    return run


def _blocks(items: DataFrame, count: int, block: int) -> DataFrame:
    """Deals items into as many blocks as give about `block` items each."""
    h = F.xxhash64("id", "piece")
    return items.withColumn("h", h).withColumn("block", F.pmod(h, F.lit(max(1, -(-count // block)))))


def pack(sizes: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """(id, piece, token_start, token_end, container) from (id, tokens).

    A document of more than `capacity` tokens is split: its full pieces fill a container each, the rest is
    packed like a document. Any other document stays whole. Containers never exceed `capacity`. Documents
    without tokens take no space and go to a container of their block. Keys must be distinct.
    """
    size = sizes.select("id", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    parts = F.expr(f"sequence(0, greatest(0, cast(ceil(tokens / {capacity}) as int) - 1), 1)")
    pieces = size.select("id", "tokens", F.explode(parts).alias("piece"))
    pieces = cut(pieces.select("id", "piece", F.least(F.col("tokens") - F.col("piece") * capacity, F.lit(capacity)).cast("long").alias("size")))
    full = pieces.where(F.col("size") == capacity).select("id", "piece", "size", F.xxhash64("id", "piece").bitwiseOR(F.lit(-1 << 63)).alias("container"))
    loose = pieces.where(F.col("size") < capacity)
    n = loose.count()
    schema = "id long, piece int, size long, container long"
    first = cut(_blocks(loose, n, block).groupBy("block").applyInPandas(_pack_block(capacity), schema))
    fill = first.groupBy("container").agg(F.sum("size").alias("size")).where(F.col("size") < LOOSE * capacity)
    fill = cut(fill.select(F.col("container").alias("id"), F.lit(0).alias("piece"), "size"))
    again = _blocks(fill, fill.count(), block).groupBy("block").applyInPandas(_pack_block(capacity), schema)
    again = again.select(F.col("id").alias("container"), (F.col("container") + F.lit(1 << 61)).alias("merged"))
    packed = first.join(again, "container", "left").select("id", "piece", "size", F.coalesce("merged", "container").alias("container"))
    result = packed.unionByName(full)
    start = F.col("piece").cast("long") * capacity
    return result.select("id", "piece", start.alias("token_start"), (start + F.col("size")).alias("token_end"), "container")

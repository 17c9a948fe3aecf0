"""Connected components of an edge list by alternating large-star and small-star steps.

The number of rounds grows with the logarithm of the longest path. Neighbour lists are never collected: a
node's smallest neighbour comes from an aggregate that combines on the map side. The edges then look it up: those of
hubs against a broadcast of at most a few thousand of them, all others in a shuffle, so that a hub with a third of
all edges stays balanced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.skew import lookup_join
from tagloom.session import cut

#: Edges from which the look-up of a node's smallest neighbour is split by hubs; below, no node has enough to matter.
SPLIT = 1_000_000


def _looked_up(edges: DataFrame, lookup: DataFrame, key: str, most: int) -> DataFrame:
    """`edges`, `most` or fewer, with the columns of `lookup` (key, least, k), where k counts the edges of the key."""
    if most < SPLIT:
        return edges.join(lookup.drop("k"), key)
    return lookup_join(edges, cut(lookup), key, "k", edges.count())


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): every node that occurs in `edges` with the smallest node of its component.

    Self-loops keep isolated nodes; repeated and reversed edges and nulls are harmless; an empty edge list
    gives no rows. Raises if `rounds` don't suffice (a path of 2 ** rounds nodes would be needed).
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    nodes = pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("node"))
    current = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    signature, n = None, current.count()  # no step adds edges
    for _ in range(rounds):
        # large star: every larger neighbour of a node is linked to the smallest of its neighbourhood
        both = current.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(current.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("x"), F.count_if(F.col("m") > F.col("n")).alias("k")).where("k > 0").select("n", F.least("n", "x").alias("least"), "k")
        large = _looked_up(both.where("m > n"), least, "n", n).select(F.col("m").alias("hi"), F.col("least").alias("lo")).where("hi <> lo").distinct()
        # small star: the smaller neighbours of a node and the node itself are linked to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("least"), F.count("*").alias("k"))
        small = _looked_up(large, low, "hi", n).select(F.col("lo").alias("hi"), F.col("least").alias("lo")).union(low.select("hi", F.col("least").alias("lo"))).where("hi <> lo").distinct()
        current = cut(small)
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(seen) == signature:
            break
        signature, n = tuple(seen), max(n, seen[0])
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(current.select(F.col("hi").alias("node"), "lo"), "node", "left").select("node", F.coalesce("lo", "node").alias("component"))

"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds more than this share of the left rows; so there are at most 1 / HEAVY_SHARE of them.
HEAVY_SHARE = 1 / 2000


def lookup_join(left: DataFrame, lookup: DataFrame, key: str, weight: str, total: int, share: float = HEAVY_SHARE) -> DataFrame:
    """Inner join of `left` with `lookup`, which holds each `key` once and in `weight` how often `left` has it.

    Keys with more than `share` of the `total` left rows go by broadcast; their number is at most
    1 / share because their weights add up to no more than `total`. The rest shuffles, and no
    shuffled key holds more than `share` of the rows. Null keys match nothing. `weight` is dropped.
    """
    floor = max(1.0, total * share)
    heavy = F.broadcast(lookup.where(F.col(weight) > floor).drop(weight))
    light = lookup.where(F.col(weight) <= floor).drop(weight)
    few = left.join(F.broadcast(lookup.where(F.col(weight) > floor).select(key)), key, "left_anti")
    return left.join(heavy, key).unionByName(few.join(light, key))


"""Relations between rows of two sides or of one group: shared places, repeats, contradictions, overlaps, owned folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import paths


def by_position(left: DataFrame, right: DataFrame, group: str, place: list[str]) -> DataFrame:
    """Rows of both sides of one group at one place; null places meet nothing, a place that is taken twice meets twice."""
    return left.join(right, [group, *place])


def repeated(rows: DataFrame, place: list[str], value: str) -> DataFrame:
    """(*place, copies, first): places that hold more than one row, and the smallest value there."""
    return rows.groupBy(*place).agg(F.count("*").alias("copies"), F.min(value).alias("first")).where("copies > 1")


def conflicting(rows: DataFrame, group: str, place: list[str], value: str) -> DataFrame:
    """(group, conflicts): at how many places of the group two different values stand. Null values contradict nothing."""
    seen = rows.groupBy(group, *place).agg((F.min(value) != F.max(value)).alias("differ"))
    return seen.groupBy(group).agg(F.count_if(F.coalesce("differ", F.lit(False))).alias("conflicts"))


def overlap(left: DataFrame, right: DataFrame, group: str, item: str) -> DataFrame:
    """(group, shared, only_left): how many distinct items of the left the right has too, and how many it lacks.

    Counted by one aggregate over both sides, so no set of items is gathered; null items count as none.
    """
    both = left.select(group, item, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(group, item, F.lit(0).alias("l"), F.lit(1).alias("r")))
    items = both.groupBy(group, item).agg((F.max("l") * F.col(item).isNotNull().cast("int")).alias("l"), F.max("r").alias("r"))
    return items.groupBy(group).agg(F.sum(F.col("l") * F.col("r")).alias("shared"), F.sum(F.col("l") * (1 - F.col("r"))).alias("only_left"))


def owned_folders(files: DataFrame, path: str, owner: str) -> DataFrame:
    """(folder, owner, files): folders below which, at any depth, all files belong to one owner; null owners own nothing."""
    f = paths.folders(F.col(path))
    above = F.transform(F.sequence(F.lit(1), F.size("f")), lambda k: F.concat(F.lit("/"), F.array_join(F.slice("f", F.lit(1), k), "/")))
    long = files.select(F.col(owner).alias("owner"), f.alias("f")).where("size(f) > 0").select("owner", F.explode(above).alias("folder"))
    counted = long.groupBy("folder").agg(F.min("owner").alias("owner"), F.max("owner").alias("other"), F.count("owner").alias("known"), F.count("*").alias("files"))
    return counted.where("owner = other AND known = files").select("folder", "owner", "files")

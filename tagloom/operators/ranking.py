"""Ranking, margins, cascades and one-to-one assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """Rows with their rank by falling score (ties by `tie`), the best score of the group and the score of the next rank."""
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(tie))
    return rows.withColumn("rank", F.row_number().over(w)).withColumn("best", F.first(score).over(w)).withColumn("next", F.lead(score).over(w))


def top(rows: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group before equal `tie`s are merged, so that repeated rows use up places."""
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(tie))
    best = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return best.groupBy(group, tie).agg(F.min("place").alias("place"), F.max(score).alias(score))


def cascade(sources: list[DataFrame], group: str) -> DataFrame:
    """Rows of the first source that has any for the group; `stage` counts sources from 0."""
    rows = None
    for i, s in enumerate(sources):
        part = s.withColumn("stage", F.lit(i))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    first = rows.groupBy(group).agg(F.min("stage").alias("stage"))
    return rows.join(first, [group, "stage"])


def unique_winner(rows: DataFrame, group: str, flag: Column, item: str) -> DataFrame:
    """(group, item) of groups with exactly one flagged row."""
    return rows.where(flag).groupBy(group).agg(F.count("*").alias("n"), F.max(item).alias(item)).where("n = 1").drop("n")


def clear_winner(rows: DataFrame, group: str, quality: str, item: str, least: float = 0.85, gap: float = 0.15) -> DataFrame:
    """(group, item) of groups whose best quality is at least `least` and `gap` above the second."""
    r = ranked(rows, group, quality, item).where("rank = 1")
    return r.where((F.col(quality) >= least) & (F.col(quality) - F.coalesce("next", F.lit(0.0)) >= gap)).select(group, item)


def contained(left: DataFrame, right: DataFrame, group: str, item: str) -> DataFrame:
    """(group, contained): whether the items of a group on the left are a sub-multiset of those on the right."""
    l, r = left.groupBy(group, item).agg(F.count("*").alias("l")), right.groupBy(group, item).agg(F.count("*").alias("r"))
    return l.join(r, [group, item], "left").groupBy(group).agg(F.bool_and(F.col("l") <= F.coalesce("r", F.lit(0))).alias("contained"))


def greedy_pairs(pairs: DataFrame, group: list[str], left: str, right: str, score: str) -> DataFrame:
    """One-to-one pairs of each group taken by falling score; ties by left, then right. Groups are single albums."""
    row = F.struct((-F.col(score)).alias("s"), F.col(left).alias("l"), F.col(right).alias("r"))
    sorted_pairs = pairs.groupBy(*group).agg(F.array_sort(F.collect_list(row)).alias("p"))
    kind = pairs.select(F.array(row).alias("p")).schema["p"].dataType.simpleString()
    start = F.array().cast(kind)
    free = lambda acc, x: ~F.exists(acc, lambda y: (y["l"] == x["l"]) | (y["r"] == x["r"]))
    chosen = F.aggregate("p", start, lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return sorted_pairs.select(*group, F.explode(chosen).alias("x")).select(*group, F.col("x.l").alias(left), F.col("x.r").alias(right), (-F.col("x.s")).alias(score))

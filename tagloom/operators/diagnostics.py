"""Completeness and topology of track lists: two aggregations, per disc and then per release."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _per_disc(tracks: DataFrame, key: str) -> DataFrame:
    t = tracks.withColumn("disc", F.coalesce("disc_number", F.lit(1)))
    return t.groupBy(key, "disc").agg(
        F.count("*").alias("n"), F.count("track_number").alias("numbered"), F.count_distinct("track_number").alias("places"), F.min("track_number").alias("low"), F.max("track_number").alias("high"),
        F.count_distinct("track_total").alias("totals"), F.min("track_total").alias("total_low"), F.max("track_total").alias("total"), F.count_distinct("disc_total").alias("disc_totals"),
        F.min("disc_total").alias("disc_total_low"), F.max("disc_total").alias("disc_total"), F.array_sort(F.collect_set("track_number")).alias("numbers"),
    )


def incomplete(tracks: DataFrame, key: str) -> DataFrame:
    """(key, incomplete): whether positions are missing, repeated or gapped, or contradict the declared totals."""
    d = _per_disc(tracks, key)
    g = d.groupBy(key).agg(
        F.sum("n").alias("n"), F.count("*").alias("discs"), F.min("disc").alias("disc_low"), F.max("disc").alias("disc_high"),
        F.bool_or((F.col("numbered") < F.col("n")) | (F.col("low") < 1) | (F.col("places") < F.col("numbered")) | (F.col("high") > F.col("places")) | (F.col("totals") > 1)).alias("broken"),
        F.bool_or((F.col("total_low") < 1) | (F.col("disc_total_low") < 1)).alias("senseless"), F.min("total_low").alias("t_low"), F.max("total").alias("t_high"),
        F.min("disc_total_low").alias("dt_low"), F.max("disc_total").alias("dt_high"), F.bool_or((F.col("total") != F.col("n"))).alias("short"),
    )
    overall = (F.col("t_low") == F.col("t_high")) & (F.col("t_high") == F.col("n"))
    bad = (
        F.coalesce("broken", F.lit(True)) | F.coalesce("senseless", F.lit(False)) | (F.col("disc_low") < 1) | (F.col("discs") < F.col("disc_high"))
        | F.coalesce(F.col("dt_low") != F.col("dt_high"), F.lit(False)) | F.coalesce(F.col("dt_high") != F.col("disc_high"), F.lit(False)) | (F.coalesce("short", F.lit(False)) & ~F.coalesce(overall, F.lit(False)))
    )
    return g.select(key, bad.alias("incomplete"))


def topology(tracks: DataFrame, key: str) -> DataFrame:
    """One row per release: scope of the declared totals, layout of numbers, missing discs and positions.

    scope: `conflicting` (a disc has several totals), `album` (one total for several discs), `disc`, `unknown`.
    layout: `global` (album scope and numbers unique over discs), `per_disc`, `unknown`. Missing positions
    are listed as `disc.number`; they are null if unknown, and only counted for album scope.
    """
    d = _per_disc(tracks, key)
    row = F.struct("disc", "numbers", "total")
    g = d.groupBy(key).agg(
        F.count("*").alias("discs"), F.sum("n").alias("tracks"), F.max("totals").alias("most_totals"), F.min("total_low").alias("t_low"), F.max("total").alias("t_high"), F.count("total").alias("declared"),
        F.min("disc_total_low").alias("dt_low"), F.max("disc_total").alias("dt_high"), F.sum("places").alias("places"), F.size(F.array_distinct(F.flatten(F.collect_list("numbers")))).alias("distinct_numbers"),
        F.array_sort(F.collect_list(row)).alias("per_disc"), F.array_sort(F.collect_set("disc")).alias("seen"),
    )
    scope = F.when(F.col("most_totals") > 1, "conflicting").when((F.col("discs") > 1) & (F.col("declared") == F.col("discs")) & (F.col("t_low") == F.col("t_high")) & (F.col("t_high") >= F.col("tracks")), "album").when(F.col("declared") > 0, "disc").otherwise("unknown")
    g = g.withColumn("scope", scope)
    layout = F.when((F.col("scope") == "album") & (F.col("places") == F.col("distinct_numbers")), "global").when(F.col("places") > 0, "per_disc").otherwise("unknown")
    gaps = F.flatten(F.transform("per_disc", lambda x: F.transform(F.array_except(F.when(x["total"] > 0, F.sequence(F.lit(1), x["total"], F.lit(1))).otherwise(F.array().cast("array<int>")), x["numbers"]), lambda n: F.concat_ws(".", x["disc"], n))))
    listed = F.when(F.col("scope").isin("disc", "conflicting"), gaps)
    missing = F.when(F.col("scope") == "album", F.greatest(F.lit(0), F.col("t_high") - F.col("tracks"))).when(F.col("scope").isin("disc", "conflicting"), F.size(gaps))
    no_disc = F.when((F.col("dt_low") == F.col("dt_high")) & (F.col("dt_high") > 0), F.array_except(F.sequence(F.lit(1), F.col("dt_high"), F.lit(1)), F.col("seen").cast("array<int>")))
    return g.select(key, "scope", layout.alias("layout"), F.col("discs").cast("long").alias("discs"), "tracks", missing.cast("long").alias("missing_count"), F.array_join(listed, ",").alias("missing"), F.array_join(no_disc, ",").alias("missing_discs"))

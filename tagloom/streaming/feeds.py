"""Streams of scanned tracks: first arrivals, late data and running counts with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_deliveries(stream: DataFrame, key: str, at: str, late: str = "30 days", tie: str | None = None) -> DataFrame:
    """The first delivery of each key within the watermark; works on a stream or, without state, on a table, where
    deliveries of one time are told apart by the smallest `tie`."""
    if stream.isStreaming:
        return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    first = stream.groupBy(key).agg(F.min_by(F.struct(*stream.columns), F.struct(at, tie) if tie else F.col(at)).alias("r"))
    return first.select(*(c if c == key else f"r.{c}" for c in stream.columns))  # the key itself, so that rows stay known to be partitioned by it


def arrivals(stream: DataFrame, at: str, source: str, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Rows per source and window of event time; windows close when the watermark has passed them."""
    timed = stream.withWatermark(at, late) if stream.isStreaming else stream
    return timed.groupBy(F.window(at, window).alias("w"), source).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), source, "n")


def changed(snapshot: DataFrame, current: DataFrame, key: str, identity: str) -> DataFrame:
    """Rows of a snapshot whose identity is no longer that of the current listing, or that are gone."""
    same = current.select(key, F.col(identity).alias("now"))
    joined = snapshot.join(same, key, "left")
    return joined.where(~F.col(identity).eqNullSafe(F.col("now"))).select(key, F.when(F.col("now").isNull(), "gone").otherwise("changed").alias("state"))

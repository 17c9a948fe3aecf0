"""Reports and caches: written through Spark's commit protocol, read with their age checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(report: DataFrame, path: str, overwrite: bool = False, audio_endings: list[str] = ()) -> None:
    """One JSON object per row, keys in sorted order; refuses an existing target unless told otherwise, and audio names."""
    if path.rpartition(".")[2].lower() in set(audio_endings):
        raise ValueError(f"{path} names an audio file")
    report.select(*sorted(report.columns)).write.mode("overwrite" if overwrite else "errorifexists").json(path)


def append_checkpoint(batch: DataFrame, path: str) -> None:
    """Adds finished rows to a growing report; each call is committed as a whole."""
    batch.write.mode("append").parquet(path)


def write_cache(rows: DataFrame, path: str, key: str, version: int) -> None:
    """Adds responses to a cache, each with its key, schema version and time."""
    rows.withColumn("cache_key", F.col(key)).withColumn("schema_version", F.lit(version)).withColumn("stored_at", F.current_timestamp()).write.mode("append").parquet(path)


def fresh(rows: DataFrame, stored_at: str, now: Column, ttl: str = "30 days") -> DataFrame:
    """Rows not older than the time to live; rows without a time are stale."""
    return rows.where(F.col(stored_at) >= now - F.expr(f"INTERVAL {ttl}"))


def read_cache(spark: SparkSession, path: str, version: int, now: Column, ttl: str = "30 days") -> DataFrame:
    """The newest fresh response of each key, of the given schema version."""
    rows = fresh(spark.read.parquet(path).where(F.col("schema_version") == version), "stored_at", now, ttl)
    others = [c for c in rows.columns if c not in ("cache_key", "stored_at")]
    return rows.groupBy("cache_key").agg(F.max_by(F.struct(*others), "stored_at").alias("r"), F.max("stored_at").alias("stored_at")).select("cache_key", "stored_at", "r.*")


def image_urls(url: Column, sizes: list[int] = (3000, 1200, 600)) -> Column:
    """Candidate URLs of one image in order of preference: the largest first, the given one last, repeats left out."""
    resized = [F.regexp_replace(url, r"/\d+x\d+(bb)?(-\d+)?\.(jpg|png|webp)$", f"/{n}x{n}bb.jpg") for n in sizes]
    return F.array_compact(F.array_distinct(F.array(*resized, url)))


def summary(rows: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """One row of counters: how many rows meet each condition."""
    return rows.agg(*(F.count_if(c).alias(name) for name, c in counters.items()))


def histogram(rows: DataFrame, reasons: str) -> DataFrame:
    """(reason, n) over an array column of reasons."""
    return rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))

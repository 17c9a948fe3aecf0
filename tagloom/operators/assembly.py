"""Albums assembled from catalog rows, strictly or with best effort, and release documents parsed from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRACK = "struct<disc_number:int,track_number:int,title:string,artist:string,duration_ms:bigint>"


def contiguous(songs: DataFrame, key: str) -> DataFrame:
    """(key, songs, contiguous): whether positions are known, distinct and without gaps on every disc from 1 on."""
    d = songs.groupBy(key, F.coalesce("disc_number", F.lit(1)).alias("disc")).agg(F.count("*").alias("n"), F.count_distinct("track_number").alias("k"), F.min("track_number").alias("low"), F.max("track_number").alias("high"))
    good = (F.col("k") == F.col("n")) & (F.col("low") == 1) & (F.col("high") == F.col("n"))
    return d.groupBy(key).agg(F.sum("n").alias("songs"), (F.bool_and(F.coalesce(good, F.lit(False))) & (F.min("disc") == 1) & (F.max("disc") == F.count("*"))).alias("contiguous"))


def assemble(collections: DataFrame, songs: DataFrame, key: str, declared: str) -> DataFrame:
    """Albums with their songs in order and a status: `complete`, `count differs`, `positions broken` or `no songs`.

    Strict users keep `complete`; lenient ones keep all, with the songs only where positions are sound.
    """
    checked = contiguous(songs, key)
    lists = songs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("disc_number", F.lit(1)).cast("int").alias("disc_number"), F.col("track_number").cast("int").alias("track_number"), "title", "artist", F.col("duration_ms").cast("long").alias("duration_ms")))).alias("tracks"))
    joined = collections.join(checked, key, "left").join(lists, key, "left")
    status = F.when(F.col("songs").isNull(), "no songs").when(~F.col("contiguous"), "positions broken").when(F.col(declared) != F.col("songs"), "count differs").otherwise("complete")
    return joined.withColumn("status", status).withColumn("tracks", F.when(F.col("contiguous"), F.col("tracks")).otherwise(F.array().cast(f"array<{TRACK}>"))).drop("contiguous")


RELEASE = """id string, title string, date string, barcode string, `artist-credit` array<struct<name:string,joinphrase:string>>,
media array<struct<`track-count`:int,tracks:array<struct<recording:struct<id:string>>>>>, relations array<struct<url:struct<resource:string>>>"""


def parse_release(payloads: DataFrame, column: str, hosts: list[str]) -> DataFrame:
    """Release documents as columns; `status` is `ok`, `malformed` (no JSON object) or `invalid id`, never an error."""
    from tagloom.functions import ids

    p = payloads.withColumn("r", F.from_json(F.col(column), RELEASE))
    artist = F.trim(F.array_join(F.transform(F.col("r.artist-credit"), lambda c: F.concat(F.coalesce(c["name"], F.lit("")), F.coalesce(c["joinphrase"], F.lit("")))), ""))
    count = F.aggregate(F.transform(F.col("r.media"), lambda m: m["track-count"]), F.lit(0), lambda s, x: s + x)
    recordings = F.flatten(F.transform(F.col("r.media"), lambda m: F.coalesce(F.transform(m["tracks"], lambda t: ids.uuid(t["recording"]["id"])), F.array().cast("array<string>"))))
    links = F.array_sort(F.array_distinct(F.array_compact(F.transform(F.col("r.relations"), lambda x: ids.collection_id(x["url"]["resource"], hosts)))))
    release = ids.uuid(F.col("r.id"))
    status = F.when(F.col("r").isNull() | F.col("r.id").isNull(), "malformed").when(release.isNull(), "invalid id").otherwise("ok")
    return p.select(*payloads.columns, status.alias("status"), release.alias("release_id"), F.col("r.title").alias("title"), artist.alias("artist"), ids.year(F.col("r.date")).alias("year"), count.alias("track_count"), ids.barcode(F.col("r.barcode")).alias("barcode"), F.array_compact(recordings).alias("recording_ids"), links.alias("collection_ids"))

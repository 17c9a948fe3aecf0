"""Linking tracks into releases through shared identifiers and tags, and collapsing duplicate encodings.

Components are found over the keys (release id, barcode, tags), not over the tracks: every track only
states that its keys belong together, and equal statements are combined before they move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import ids, paths, text
from tagloom.operators.components import components
from tagloom.operators.skew import lookup_join
from tagloom.operators.streamed import grouped_rows
from tagloom.session import cut


def usable(tracks: DataFrame) -> DataFrame:
    """Tracks with a title, an album and some artist; the others are errors, see `unusable`."""
    return tracks.where("coalesce(title, '') <> '' AND coalesce(album, '') <> '' AND coalesce(nullif(album_artist, ''), nullif(artist, '')) IS NOT NULL")


def unusable(tracks: DataFrame) -> DataFrame:
    """(path, missing) of the tracks `usable` leaves out, with the names of what they lack."""
    lacks = F.filter(F.array(F.when(F.coalesce("title", F.lit("")) == "", "title"), F.when(F.coalesce("album", F.lit("")) == "", "album"), F.when(F.coalesce(F.expr("nullif(album_artist, '')"), F.expr("nullif(artist, '')")).isNull(), "artist")), lambda x: x.isNotNull())
    return tracks.select("path", F.array_join(lacks, ",").alias("missing")).where("missing <> ''")


def with_keys(tracks: DataFrame) -> DataFrame:
    """Usable tracks with their folded tags, valid identifiers and the hash of their tag key.

    Tag keys hold the release folder, so equal tags in sibling folders stay apart.
    """
    owner = F.coalesce(F.expr("nullif(album_artist, '')"), F.col("artist"))
    t = usable(tracks).withColumn("owner", owner)
    t = t.withColumn("album_n", text.fold_udf("album")).withColumn("owner_n", text.fold_udf("owner"))
    t = t.withColumn("folders_n", text.folders_udf("path"))
    t = t.withColumn("anchor", paths.release_folder(F.col("path"), F.col("album_n"), F.col("folders_n")))
    t = t.withColumn("release_id", ids.uuid(F.col("mb_release_id"))).withColumn("recording_id", ids.uuid(F.col("mb_recording_id"))).withColumn("gtin", ids.barcode(F.col("barcode")))
    return t.withColumn("tag_key", F.xxhash64(F.lit("t"), "owner_n", "album_n", "anchor")).drop("folders_n")


def linked(tracks: DataFrame) -> DataFrame:
    """`with_keys` plus `component`: equal for tracks that share a key, directly or through others."""
    keyed = cut(with_keys(tracks))
    m = F.when(F.col("release_id").isNotNull(), F.xxhash64(F.lit("m"), "release_id"))
    b = F.when(F.col("gtin").isNotNull(), F.xxhash64(F.lit("b"), F.lpad("gtin", 14, "0")))
    edges = keyed.select("tag_key", F.explode(F.array(F.col("tag_key"), m, b)).alias("key")).where("key IS NOT NULL").distinct()
    found = cut(components(edges, "tag_key", "key"))
    sizes = keyed.groupBy("tag_key").agg(F.count("*").alias("n"))
    lookup = cut(found.join(sizes, found["node"] == sizes["tag_key"]).select("tag_key", "component", "n"))
    total = lookup.agg(F.sum("n")).first()[0] or 0
    return lookup_join(keyed, lookup, "tag_key", "n", total)


def releases(members: DataFrame) -> DataFrame:
    """One row per component: names of its first file, the year if it is unique, files, identifiers and conflicts."""
    several = lambda name: F.count_distinct(name) > 1
    agg = members.groupBy("component").agg(
        F.min_by("album", "path").alias("album"), F.min_by("owner", "path").alias("album_artist"), F.min_by("album_n", "path").alias("album_n"), F.min_by("owner_n", "path").alias("owner_n"),
        F.when(F.count_distinct("year") == 1, F.max("year")).alias("year"), F.array_sort(F.collect_list("path")).alias("files"), F.count("*").alias("file_count"),
        F.when(F.count_distinct("release_id") == 1, F.max("release_id")).alias("release_id"), F.when(F.count_distinct(F.lpad("gtin", 14, "0")) == 1, F.max_by("gtin", "path")).alias("barcode"),
        several("release_id").alias("ids_differ"), several(F.lpad("gtin", 14, "0")).alias("codes_differ"),
        (F.bool_and(F.col("release_id").isNotNull() & F.col("recording_id").isNotNull()) & (F.count_distinct("release_id") == 1)).alias("provenance_complete"),
    )
    place = members.where("recording_id IS NOT NULL AND track_number IS NOT NULL").groupBy("component", F.coalesce("disc_number", F.lit(1)).alias("d"), "track_number", "title", "recording_id").count()
    place = place.withColumn("identity", text.duplicate_identity_udf("title")).groupBy("component", "d", "track_number", "identity").agg(F.count_distinct("recording_id").alias("n"))
    clash = place.groupBy("component").agg((F.max("n") > 1).alias("recordings_differ"))
    agg = agg.join(clash, "component", "left")
    conflicts = F.array_compact(F.array(F.when(F.col("ids_differ"), "release ids differ"), F.when(F.col("codes_differ"), "barcodes differ"), F.when(F.col("recordings_differ"), "recording ids differ at one position")))
    return agg.withColumn("conflicts", conflicts).drop("ids_differ", "codes_differ", "recordings_differ")


def _fold_position(rows: list[tuple]) -> list[tuple]:
    """Tracks (path, component, number, title, title_n, artist, recording_id) at one place of one release in path
    order -> (component, path) of the first of each presentation, replaced by one with a recording id."""
    kept: list[tuple] = []
    for row in rows:
        path, component, number, title, title_n, artist, recording = row
        numbered = number is not None and number == number
        at = next((i for i, k in enumerate(kept) if numbered and text.duplicates_compatible(k[3], k[5] or "", title, artist or "") and (not k[6] or not recording or k[6] == recording)), None)
        if at is None:
            if numbered or all(k[4] != title_n for k in kept):
                kept.append(row)
        elif not kept[at][6] and recording:
            kept[at] = row
    return [(k[1], k[0]) for k in kept]


def logical_tracks(members: DataFrame, *carried: str) -> DataFrame:
    """(component, path) and the columns `carried` of one track per place and presentation: duplicate encodings of a track collapse.

    The order of paths decides which copy stays, except that a copy with a recording id replaces one without.
    Tracks alone at their place stay as they are. Of the others, copies equal in everything that matters are reduced to
    their first path before any group is gathered. Folded titles matter only where no number tells the place.
    """
    m = members.withColumn("disc", F.coalesce("disc_number", F.lit(1))).withColumn("number", F.col("track_number"))
    m = m.withColumn("title_n", text.fold_udf(F.when(F.col("number") > 0, F.lit(None)).otherwise(F.col("title"))))
    slot = F.when(F.col("number") > 0, F.xxhash64("disc", "number")).otherwise(F.xxhash64("disc", "title_n", F.bround(F.coalesce("duration_ms", F.lit(0)) / 2000)))
    names = ["component", "number", "title", "title_n", "artist", "recording_id"]
    placed = m.withColumn("place", F.xxhash64("component", slot)).select("place", "path", *dict.fromkeys([*names, *carried]))
    placed = cut(placed.withColumn("n", F.count("*").over(Window.partitionBy("place"))))
    several = placed.where("n > 1")
    first = several.groupBy("place", *names).agg(F.min("path").alias("path")).select("place", "path", *names)
    kept = grouped_rows(first, "place", ["path"], _fold_position, "component long, path string")
    if carried:
        kept = kept.join(several.select("component", "path", *carried).dropDuplicates(["component", "path"]), ["component", "path"])
    return placed.where("n = 1").select("component", "path", *carried).unionByName(cut(kept))

"""Queries pN_... of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import collapse, encoding, leaks, lookalike, names, packing, releases, spans, truncation
from tagloom.session import cut, table

TRACK_WORDS = ["title", "artist", "album", "album_artist"]
TRACK_NUMBERS = ["year", "disc_number", "track_number", "duration_ms"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of credits that name the same act."""
    return names.act_pairs(cut(names.acts(table(spark, d, "artist_credits"), "credit_id", "name")))


def p1_acts(spark: SparkSession, d: str) -> DataFrame:
    """Each credit with the smallest credit of its act."""
    return names.acts(table(spark, d, "artist_credits"), "credit_id", "name").select(F.col("id").alias("credit_id"), "act")


def _collapsed(spark: SparkSession, d: str) -> DataFrame:
    tracks = collapse.collapse(table(spark, d, "tracks"), "track_id", TRACK_WORDS, [], TRACK_NUMBERS)
    groups = collapse.collapse(table(spark, d, "album_groups"), "group_id", ["album", "album_artist"], ["barcode"], ["year", "track_count"])
    return tracks.select(F.lit("tracks").alias("tbl"), "*").unionByName(groups.select(F.lit("album_groups").alias("tbl"), "*"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every row that collapses into an earlier one."""
    return _collapsed(spark, d).where("id > kept_id").select("tbl", "kept_id", F.col("id").alias("dup_id"))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct record with its number of copies."""
    return _collapsed(spark, d).where("id = kept_id").select("tbl", "kept_id", "copies")


TEXT_FIELDS = ["title", "artist", "album"]


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    more = [(table(spark, d, "catalog_tracks"), ["title", "artist"]), (table(spark, d, "tracks"), ["album_artist"])]
    return encoding.garbled_fields(table(spark, d, "tracks"), "track_id", TEXT_FIELDS, more)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every value of tracks that went through a wrong decoding."""
    return _garbled(spark, d).select(F.col("key").alias("track_id"), "field")


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled values with their original text, null where it is lost."""
    found = encoding.restore(table(spark, d, "tracks"), "track_id", TEXT_FIELDS, _garbled(spark, d))
    return found.select(F.col("key").alias("track_id"), "field", "value", "restored")


def _look_alikes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The odd values of both tables that are not garbled, and their repaired forms."""
    tracks = lookalike.odd_fields(table(spark, d, "tracks"), "track_id", ["title", "album"]).withColumn("tbl", F.lit("tracks"))
    catalog = lookalike.odd_fields(table(spark, d, "catalog_tracks"), "catalog_track_id", ["title"]).withColumn("tbl", F.lit("catalog_tracks"))
    rows = tracks.unionByName(catalog)
    repaired = cut(lookalike.repaired(rows.groupBy("value").agg(F.count("*").alias("n"))))
    hit = rows.where(F.col("value").rlike(lookalike.SUSPECT)).join(repaired, "value")
    garbled = _garbled(spark, d).select("key", "field", F.lit("tracks").alias("tbl"))
    return hit.join(garbled, ["tbl", "key", "field"], "left_anti"), repaired


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every value with characters that only look like the usual ones."""
    return _look_alikes(spark, d)[0].select("tbl", F.col("key").alias("row_id"), "field")


def p6_consistent(spark: SparkSession, d: str) -> DataFrame:
    """The same values with one consistent form of each."""
    hit = _look_alikes(spark, d)[0]
    return hit.select("tbl", F.col("key").alias("row_id"), "field", "value", lookalike.apply_swaps(F.col("base"), F.col("swap")).alias("consistent"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every value of tracks that stops before its end."""
    return truncation.truncated_fields(table(spark, d, "tracks"), "track_id", TEXT_FIELDS, "tagger").select(F.col("key").alias("track_id"), "field")


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each tagger cuts each field: values that count as cut, and the share estimated from all scores."""
    values, _ = truncation.scored(table(spark, d, "tracks"), "track_id", TEXT_FIELDS, "tagger")
    is_cut = F.when(truncation.is_cut(), F.col("n")).otherwise(0)
    return values.groupBy(F.col("source").alias("tagger"), "field").agg(F.sum("n").alias("n_values"), F.sum(is_cut).alias("n_cut"), F.round(F.sum(is_cut) / F.sum("n"), 6).alias("rate"), F.round(F.sum(F.col("p") * F.col("n")) / F.sum("n"), 6).alias("estimated_rate"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The merged ranges of each document that occur verbatim in another one."""
    return spans.shared_spans(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document is shared elsewhere."""
    found = p10_found(spark, d).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count("*").alias("spans"))
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("chars"))
    return docs.join(found, "doc_id").select("doc_id", "spans", "shared_chars", F.round(F.col("shared_chars") / F.col("chars"), 6).alias("share"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Every document that holds a passage of an evaluation item, with the item."""
    found = leaks.leaked(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """The container of each document, or of each piece of a document longer than a container."""
    sizes = cut(packing.token_counts(table(spark, d, "documents"), "doc_id", "text"))
    return packing.pack(sizes).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How many containers there are and how full."""
    boxes = p8_packed(spark, d).groupBy("container").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"))
    return boxes.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.round(F.avg("tokens") / packing.CAPACITY, 6).alias("fill"), F.max("tokens").alias("fullest"))


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """Each local release with its catalog album and the confidence of the match."""
    groups = table(spark, d, "album_groups").select(F.col("group_id").alias("id"), F.col("album").alias("title"), F.col("album_artist").alias("artist"), "year", F.col("track_count").alias("count"))
    albums = table(spark, d, "catalog_albums").select(F.col("collection_id").alias("id"), F.col("album").alias("title"), "artist", F.col("release_year").alias("year"), F.col("track_count").alias("count"))
    more = [(albums, ["title", "artist"]), (table(spark, d, "catalog_tracks"), ["title", "artist"])]
    fields = ["title", "artist"]
    repaired = encoding.restore(groups, "id", fields, encoding.garbled_fields(groups, "id", fields, more)).where("restored IS NOT NULL")
    by_id = repaired.groupBy(F.col("key").alias("id")).agg(*(F.max(F.when(F.col("field") == f, F.col("restored"))).alias(f"r_{f}") for f in fields))
    fixed = groups.join(by_id, "id", "left").select("id", *(F.coalesce(f"r_{f}", f).alias(f) for f in fields), "year", "count")
    return releases.match_releases(fixed, albums)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every local release with the catalog album that is the same release."""
    return p7_matches(spark, d).select("group_id", "collection_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}
    return dict(sorted(found.items(), key=lambda x: (int(x[0][1:].split("_")[0]), not x[0].endswith("_found"))))

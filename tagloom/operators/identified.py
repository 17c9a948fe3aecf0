"""Candidates that identifiers lead to: their score, releases that are the same twice, the winner among several, and
proofs that two track lists are one release.

Everything is columns over joined rows; track lists are compared by position with one join and folded back by
aggregates, never as lists in Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import ids, measures, text
from tagloom.operators import diagnostics
from tagloom.session import cut

# Weights of the score, gates of coverage and of the winner's lead, resolutions that are direct evidence.
WEIGHTS = {
    "verified_barcode": 0.30, "verified_release": 0.30, "has_release_id": 0.10, "complete_ids": 0.03, "recordings": 0.02,
    "track_count": 0.10, "closeness": 0.08, "artist": 0.03, "album": 0.03, "year": 0.01,
}
COVERAGE, ALBUM_GATE, QUALITY, LEAD = 0.70, 0.35, 0.85, 0.15
DIRECT = ["musicbrainz_apple_relation", "musicbrainz_barcode"]
#: A release is proven by its track list if this share of durations agree and no other is further off than this share, or so many ms.
AGREEING, DRIFT, DRIFT_MS = 0.85, 0.03, 10_000.0


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def scores(candidates: DataFrame, groups: DataFrame, albums: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """One row per candidate with its evidence, `total`, `reasons` against it, `warnings` and `eligible`.

    `candidates`: group_id, collection_id, verified_barcode, verified_release_id, resolution, recordings_verified.
    `groups`: group_id, album, album_artist, year, barcode, mb_release_id, complete_ids, conflicts; `albums`: collection_id,
    album, artist, release_year, track_count; `local` and `remote`: group_id or collection_id, duration_ms. The order
    and the titles of tracks don't matter. Unknown durations score one half.
    """
    lists = lambda df, key, p: df.groupBy(key).agg(F.collect_list("duration_ms").alias(f"{p}_ms"), F.count("*").alias(f"{p}_tracks"), F.count("duration_ms").alias(f"{p}_known"))
    g = groups.select("group_id", F.col("album").alias("g_album"), F.col("album_artist").alias("g_artist"), F.col("year").alias("g_year"), ids.barcode_key(F.col("barcode")).alias("g_code"), ids.uuid(F.col("mb_release_id")).alias("g_id"), "complete_ids", "conflicts")
    g = g.withColumn("g_owner", text.fold_udf("g_artist")).withColumn("g_identity", text.album_identity_udf("g_album"))
    a = albums.select("collection_id", F.col("album").alias("c_album"), F.col("artist").alias("c_artist"), F.col("release_year").alias("c_year"), F.col("track_count").alias("c_count"))
    a = a.join(candidates.select("collection_id").distinct(), "collection_id", "left_semi").withColumn("c_owner", text.fold_udf("c_artist")).withColumn("c_identity", text.album_identity_udf("c_album"))
    s = candidates.join(g, "group_id").join(a, "collection_id").join(lists(local, "group_id", "l"), "group_id", "left").join(lists(remote, "collection_id", "r"), "collection_id", "left")
    s = s.fillna(0, ["l_tracks", "r_tracks", "l_known", "r_known"])
    s = s.withColumn("code", ids.barcode_key(F.col("verified_barcode"))).withColumn("linked_id", ids.uuid(F.col("verified_release_id")))
    s = s.withColumn("expected", F.coalesce(F.nullif(F.col("c_count"), F.lit(0)).cast("long"), F.col("r_tracks")))
    e = measures.duration_multiset(F.coalesce("l_ms", F.array().cast("array<bigint>")), F.coalesce("r_ms", F.array().cast("array<bigint>")), F.col("l_tracks"), F.col("r_tracks"))
    s = s.withColumn("e", e).select("*", "e.coverage", "e.closeness", F.col("e.distance").alias("distance")).drop("e")
    same_code, same_id = _true(F.col("g_code") == F.col("code")), _true(F.col("g_id") == F.col("linked_id"))
    s = s.withColumn("verified_barcode", same_code).withColumn("verified_release", same_id).withColumn("has_release_id", F.col("g_id").isNotNull())
    s = s.withColumn("complete_ids", _true(F.col("complete_ids")) & F.col("has_release_id")).withColumn("recordings", _true(F.col("recordings_verified")))
    s = s.withColumn("direct", F.col("verified_barcode") | (F.col("verified_release") & _true(F.col("resolution").isin(DIRECT))))
    s = s.withColumn("searched", F.col("verified_release") & _true(F.col("resolution") == "musicbrainz_search"))
    s = s.withColumn("track_count", F.when(F.col("expected") > 0, measures.count_score(F.col("l_tracks"), F.col("expected"))).otherwise(0.0))
    s = s.withColumn("album", text.similarity_udf(F.coalesce("g_album", F.lit("")), F.coalesce("c_album", F.lit("")))).withColumn("artist", text.similarity_udf(F.coalesce("g_artist", F.lit("")), F.coalesce("c_artist", F.lit(""))))
    s = s.withColumn("year", measures.year_score(F.col("g_year"), F.col("c_year"), 10))
    same_album = _true(F.col("g_identity") == F.col("c_identity"))
    same_artist = text.artist_match(F.col("g_owner"), F.col("c_owner"))
    s = s.withColumn("same_album", same_album).withColumn("same_artist", same_artist)
    wrong_code, wrong_id = _true(F.col("g_code") != F.col("code")), _true(F.col("g_id") != F.col("linked_id"))
    direct, short, off = F.col("direct"), F.col("expected") != F.col("r_tracks"), F.col("l_tracks") != F.col("expected")
    weak = ~direct & F.col("searched") | ~direct & F.col("verified_release")
    judged = weak & ~wrong_code & ~wrong_id & ~off
    plain = judged & ~F.col("searched")
    against = {
        "no identifier leads to the candidate": ~direct & ~weak, "barcodes differ": wrong_code, "release ids differ": wrong_id,
        "track list incomplete": short & ~direct, "track counts differ": off & ~direct, "artists differ": plain & ~F.col("same_artist"),
        "albums differ": plain & ~F.col("same_album") & (F.col("album") < ALBUM_GATE),
        "durations differ": judged & (F.least("l_known", "r_known") > 0) & (F.col("coverage") < COVERAGE),
    }
    noted = {
        "incomplete track list kept": short & direct, "other track count kept": off & direct, "other durations kept": direct & (F.col("coverage") < COVERAGE),
        "other album title kept": (direct | judged) & ~F.col("same_album"), "other artist kept": (direct | judged & F.col("searched")) & ~F.col("same_artist"),
    }
    listed = lambda named: F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in named.items())))
    reasons = F.concat(F.coalesce("conflicts", F.array().cast("array<string>")), listed(against))
    total = reduce(lambda x, y: x + y, (F.col(n).cast("double") * w for n, w in WEIGHTS.items()))
    s = s.withColumn("reasons", reasons).withColumn("warnings", listed(noted)).withColumn("total", total)
    return s.select("group_id", "collection_id", *WEIGHTS, "coverage", "distance", "direct", "reasons", "warnings", (F.size("reasons") == 0).alias("eligible"), "total")


def evidence_winner(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(group, item) of the groups of two or more rows, all with direct evidence, in which one is told apart clearly.

    `rows`: group, item, direct, exact_count, coverage, closeness. The one row with the exact count, and the row whose
    lesser duration score is at least `QUALITY` and `LEAD` above the next, must not contradict each other.
    """
    quality = F.least("coverage", "closeness")
    ranked = F.array_sort(F.collect_list(F.struct((-quality).alias("q"), F.col(item).alias("i"))))
    g = rows.groupBy(group).agg(F.count("*").alias("n"), F.bool_and("direct").alias("all_direct"), F.count_if("exact_count").alias("exact"), F.max(F.when(F.col("exact_count"), F.col(item))).alias("by_count"), F.slice(ranked, 1, 2).alias("top"))
    g = g.where("n > 1 AND all_direct")
    best, runner = F.try_element_at("top", F.lit(1)), F.try_element_at("top", F.lit(2))
    by_count = F.when(F.col("exact") == 1, F.col("by_count"))
    by_length = F.when((-best["q"] >= QUALITY) & (runner["q"] - best["q"] >= LEAD), best["i"])
    g = g.select(group, by_count.alias("c"), by_length.alias("d"))
    return g.where("coalesce(c, d) IS NOT NULL AND coalesce(c = d, true)").select(group, F.coalesce("c", "d").alias(item))


def positions(songs: DataFrame, key: str) -> DataFrame:
    """(key, disc, number, ...): songs of the lists in which every song has a number and no place is taken twice."""
    placed = songs.withColumn("disc", F.coalesce("disc_number", F.lit(1))).withColumn("number", F.col("track_number"))
    sound = placed.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("disc", "number").alias("k"), F.bool_and((F.col("disc") > 0) & (F.coalesce("number", F.lit(0)) > 0)).alias("good")).where("good AND n = k")
    return placed.join(sound.select(key, F.col("n").alias("songs")), key)


def equivalent_releases(albums: DataFrame, songs: DataFrame) -> DataFrame:
    """(a, b), a < b: catalog albums that are one release twice.

    Names, year, count, labels and every title at its place are equal, artists equivalent and durations compatible.
    All that must be equal is hashed into one signature, so only albums that can be a pair ever meet; songs are read
    only for albums that are not alone with what the albums table says of them.
    `albums`: collection_id, album, artist, release_year, track_count; `songs`: collection_id, title, artist,
    disc_number, track_number, duration_ms. Albums without songs, with unknown places or durations are no pairs.
    """
    named = albums.select("collection_id", text.fold_udf("album").alias("album_n"), text.fold_udf("artist").alias("owner"), text.qualifiers_udf("album").alias("labels"), "release_year", "track_count").where("owner <> ''")
    named = cut(named.withColumn("names", F.xxhash64("album_n", text.artist_block(F.col("owner")), "release_year", "track_count", "labels")))
    named = cut(named.join(named.groupBy("names").count().where("count > 1"), "names", "left_semi"))
    p = positions(songs.join(named.select("collection_id").distinct(), "collection_id", "left_semi"), "collection_id").withColumn("title_n", text.fold_udf("title")).withColumn("artist_n", text.fold_udf("artist")).withColumn("labels", text.qualifiers_udf("title"))
    p = cut(p.select("collection_id", "disc", "number", "songs", "title_n", "artist_n", "labels", "duration_ms"))
    lists = p.groupBy("collection_id").agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("disc", "number", "title_n", "labels")))).alias("listing"), F.bool_and(F.col("duration_ms").isNotNull() & F.col("title_n").isNotNull()).alias("known")).where("known")
    signed = cut(named.join(lists, "collection_id").withColumn("signature", F.xxhash64("names", "album_n", text.artist_block(F.col("owner")), "release_year", "track_count", "labels", "listing")).select("collection_id", "owner", "signature"))
    met = signed.alias("x").join(signed.alias("y"), (F.col("x.signature") == F.col("y.signature")) & (F.col("x.collection_id") < F.col("y.collection_id")))
    met = met.where(text.artist_match(F.col("x.owner"), F.col("y.owner"))).select(F.col("x.collection_id").alias("a"), F.col("y.collection_id").alias("b"))
    l, r = p.select(F.col("collection_id").alias("a"), "disc", "number", "songs", F.col("artist_n").alias("l_artist"), F.col("duration_ms").alias("l_ms")), p.select(F.col("collection_id").alias("b"), "disc", "number", F.col("artist_n").alias("r_artist"), F.col("duration_ms").alias("r_ms"))
    fits = text.artist_match(F.col("l_artist"), F.col("r_artist")) & (measures.duration_similarity(F.col("l_ms"), F.col("r_ms")) > 0)
    return met.join(l, "a").join(r, ["b", "disc", "number"]).groupBy("a", "b").agg(F.count_if(fits).alias("n"), F.max("songs").alias("songs")).where("n = songs").select("a", "b")


def breaks_tie(best: Column, runner: Column) -> Column:
    """Whether the durations of the best of two equivalent releases are clearly nearer: 100 ms and a tenth in total; null decides nothing."""
    return _true((best + 100 <= runner) & (best <= runner * 0.90))


def decide(scored: DataFrame, exact: DataFrame, equivalent: DataFrame) -> DataFrame:
    """(group_id, status, collection_id): `matched`, `ambiguous` or `no match` from `scores`.

    `exact`: (collection_id) of albums whose track list is proven complete; `equivalent`: (a, b) of `equivalent_releases`.
    Candidates with the verified barcode set the others aside. Of several, the winner of the direct evidence counts;
    without one the best counts if all others are the same release.
    """
    fit = scored.where("eligible")
    barred = fit.groupBy("group_id").agg(F.bool_or("verified_barcode").alias("has_code"))
    fit = fit.join(barred, "group_id").where("verified_barcode OR NOT has_code")
    proven = exact.select("collection_id").distinct().withColumn("proven", F.lit(True))
    fit = cut(fit.join(proven, "collection_id", "left").withColumn("exact_count", _true(F.col("proven")) & (F.col("track_count") == 1.0)))
    won = evidence_winner(fit, "group_id", "collection_id").withColumnRenamed("collection_id", "winner")
    first = fit.groupBy("group_id").agg(F.min(F.struct((-F.col("total")).alias("t"), "collection_id")).alias("m"), F.count("*").alias("n")).select("group_id", F.col("m.collection_id").alias("best"), "n")
    twins = equivalent.select(F.col("a").alias("best"), F.col("b").alias("other")).unionByName(equivalent.select(F.col("b").alias("best"), F.col("a").alias("other")))
    alike = fit.select("group_id", F.col("collection_id").alias("other")).join(first.select("group_id", "best"), "group_id").join(twins, ["best", "other"], "left_semi").groupBy("group_id").agg(F.count("*").alias("twins"))
    d = scored.select("group_id").distinct().join(first, "group_id", "left").join(won, "group_id", "left").join(alike, "group_id", "left")
    clear = F.col("winner").isNotNull() | (F.col("n") == 1) | (F.coalesce("twins", F.lit(0)) == F.col("n") - 1)
    status = F.when(F.col("n").isNull(), "no match").when(clear, "matched").otherwise("ambiguous")
    return d.select("group_id", status.alias("status"), F.when(status == "matched", F.coalesce("winner", "best")).alias("collection_id"))


def aligned(candidates: DataFrame, groups: DataFrame, albums: DataFrame, local: DataFrame, remote: DataFrame, least: int = 5) -> DataFrame:
    """(group_id, collection_id): candidates whose whole track list proves that mastering labels are all that differs.

    At least `least` tracks at the same places, equal but for labels that name a mastering; artists and album agree, no
    track contradicts another by its labels; at least one label differs; durations agree for the share `AGREEING` and
    drift no further than `DRIFT` elsewhere. `local` also has track_total and disc_total; complete lists only.
    """
    whole = diagnostics.incomplete(local, "group_id").where("NOT incomplete").select("group_id")
    side = lambda df, key, p: positions(df, key).select(key, "disc", "number", F.col("songs").alias(f"{p}songs"), F.col("title").alias(f"{p}title"), text.fold_udf("artist").alias(f"{p}artist"), F.col("duration_ms").alias(f"{p}ms"))
    l, r = cut(side(local.join(whole, "group_id"), "group_id", "l_")), cut(side(remote, "collection_id", "r_"))
    g = groups.select("group_id", F.col("album").alias("g_album"), F.col("album_artist").alias("g_artist"))
    a = albums.select("collection_id", F.col("album").alias("c_album"), F.col("artist").alias("c_artist"), "track_count")
    named = candidates.select("group_id", "collection_id").distinct().join(g, "group_id").join(a, "collection_id")
    named = named.where(text.artist_match(text.fold_udf("g_artist"), text.fold_udf("c_artist"))).where(text.release_names_udf("g_album", "c_album"))
    named = cut(named.withColumn("label", text.fold_udf("g_album") != text.fold_udf("c_album")))
    t = named.join(l, "group_id").join(r, ["collection_id", "disc", "number"])
    same = text.track_labels_udf("l_title", "r_title")  # null: contradiction, else whether a label differs
    gap, near = F.abs(F.col("l_ms") - F.col("r_ms")), measures.duration_similarity(F.col("l_ms"), F.col("r_ms")) > 0
    fits = same.isNotNull() & text.artist_match(F.col("l_artist"), F.col("r_artist")) & _true(near | (gap <= F.greatest(F.lit(DRIFT_MS), F.greatest("l_ms", "r_ms") * DRIFT)))
    close = _true(F.col("l_ms").isNotNull() & F.col("r_ms").isNotNull() & near)
    s = t.groupBy("group_id", "collection_id").agg(
        F.count_if(fits).alias("n"), F.max("l_songs").alias("l"), F.max("r_songs").alias("r"), F.max("track_count").alias("declared"), F.count_if(close).alias("close"), F.bool_or(F.col("label") | _true(same)).alias("label")
    )
    return s.where((F.col("n") == F.col("l")) & (F.col("l") == F.col("r")) & (F.col("declared") == F.col("r")) & (F.col("l") >= least) & F.col("label") & (F.col("close") >= F.ceil(F.col("l") * AGREEING))).select("group_id", "collection_id")

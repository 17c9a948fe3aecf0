"""Scores of local releases against catalog albums: candidates, track pairs, features and decision.

Candidates are the best albums of one artist block; text is folded once per row beforehand, cheap bounds run before
the sequence ratio, and only pairs of tracks that share a position, an identity or a rare enough word are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import ids, measures, text
from tagloom.operators import ranking, searching
from tagloom.session import cut, shuffle_width

#: A search keeps so many rows of a group; gates of album similarity and of pair titles.
SEARCH_ROWS, ALBUM_GATE, TITLE_GATE = 12, 0.62, 0.93
LEAST_SCORE, LEAST_MARGIN = 0.92, 0.10
#: Distinct releases and albums of a block that one step of a search holds; tasks of a search.
TILE, ALBUMS, MOST_TASKS = 2_000, 50_000, 2_000
# Weights of the total, in the order in which they are added.
WEIGHTS = {"album": 0.20, "artist": 0.15, "track_artist": 0.05, "track_title": 0.25, "duration": 0.20, "topology": 0.10, "year": 0.05}


def _named(rows: DataFrame, key: str, *names: str) -> DataFrame:
    """Rows with their folded album and artist and the artist block; rows without an artist match nothing."""
    album, artist, year, count = names
    r = rows.select(F.col(key).cast("long").alias("id"), F.col(album).alias("album"), F.col(artist).alias("artist"), F.col(year).alias("year"), F.col(count).alias("count")).where(F.col(artist).isNotNull())
    r = r.withColumn("artist", text.fold_udf("artist")).withColumn("album", F.coalesce(text.fold_udf("album"), F.lit(""))).where("artist <> ''")
    return r.withColumn("block", text.artist_block(F.col("artist")))


def album_search(groups: DataFrame, albums: DataFrame) -> DataFrame:
    """Ranked candidates (group_id, collection_id, place, search_score).

    `groups`: group_id, album, album_artist, year, track_count; `albums`: collection_id, album, artist,
    release_year, track_count. A pair needs equivalent artists, and similar albums or equal counts.

    Releases that are equal in all of this have one list, and of equal albums only the first can be in it. Tasks hold
    tiles of the releases of an artist block and of its albums; only the best of each tile of albums leave a task.
    """
    alike = ["artist", "album", "year", "count"]
    g = cut(_named(groups, "group_id", "album", "album_artist", "year", "track_count").withColumn("lead", F.min("id").over(Window.partitionBy(*alike))))
    a = _named(albums, "collection_id", "album", "artist", "release_year", "track_count")
    a = a.withColumn("n", F.row_number().over(Window.partitionBy(*alike).orderBy("id"))).where(F.col("n") <= SEARCH_ROWS)
    a = a.groupBy("block", *alike).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    tiled = lambda df, size, order: df.withColumn("tile", F.floor((F.row_number().over(Window.partitionBy("block").orderBy(*order)) - 1) / size))
    l = cut(tiled(g.where("id = lead").dropDuplicates(["id"]).withColumn("ids", F.array("id")), TILE, ["id"]))
    r = cut(tiled(a.withColumn("id", F.col("ids")[0]), ALBUMS, ["id"]).join(l.select("block").distinct(), "block", "left_semi"))
    # every tile of releases meets every tile of albums of its block
    most = l.groupBy("block").agg(F.max("tile").alias("lt")).join(r.groupBy("block").agg(F.max("tile").alias("rt")), "block")
    tile = F.concat_ws(".", "lt", "rt")
    x = l.join(most.select("block", "rt"), "block").withColumn("lt", F.col("tile")).withColumn("rt", F.explode(F.sequence(F.lit(0), F.col("rt")))).withColumn("tile", tile).withColumn("side", F.lit(0))
    y = r.join(most.select("block", "lt"), "block").withColumn("rt", F.col("tile")).withColumn("lt", F.explode(F.sequence(F.lit(0), F.col("lt")))).withColumn("tile", tile).withColumn("side", F.lit(1))
    parts = l.count() // TILE + 1
    width = max(shuffle_width(groups.sparkSession), min(parts, MOST_TASKS))
    rows = x.drop("lead").unionByName(y).select(F.pmod(F.xxhash64("block", "tile"), F.lit(max(parts, width))).alias("part"), "block", "tile", "side", "id", "ids", *alike)
    found = rows.repartition(width, "part").groupBy("part").applyInPandas(searching.searcher(ALBUM_GATE, SEARCH_ROWS), "lead long, collection_id long, place int, search_score double")
    best = ranking.top(found, "lead", "search_score", "collection_id", SEARCH_ROWS)
    return g.select("lead", F.col("id").alias("group_id")).distinct().join(best, "lead").select("group_id", "collection_id", "place", "search_score")


def _word_prefix(folded):
    """Words of a folded title that any title of 0.8 word overlap must share one of."""
    words = F.array_sort(F.array_distinct(F.split(folded, " ")))
    return F.slice(words, F.lit(1), F.size(words) - F.ceil(F.size(words) * 0.8).cast("int") + 1)


def track_pairs(candidates: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """One-to-one track pairs of each candidate with their title, duration and position scores.

    `candidates`: group_id, collection_id; `local`: group_id, track_id, title, artist, disc_number, track_number,
    duration_ms; `remote`: collection_id, catalog_track_id and the same. Titles must be alike with the same
    version labels, durations compatible where both are known.
    """
    fields = ["title", "artist", "disc_number", "track_number", "duration_ms"]
    coded = lambda c: F.xxhash64(c)

    def side(df, key, item, p):
        """Tracks of candidates with the codes of what pairs have in common; equal places need equal identities, so only tracks without a number meet by place."""
        t = df.where("title IS NOT NULL").join(candidates.select(key).distinct(), key, "left_semi").select(key, item, *(F.col(f).alias(p + f) for f in fields))
        t = t.withColumn("n", text.fold_udf(p + "title")).withColumn("identity", text.track_identity_udf(p + "title")).withColumn("labels", text.qualifiers_udf(p + "title"))
        place = F.when(F.col(p + "track_number").isNull(), F.concat_ws(".", F.lit("#"), F.coalesce(p + "disc_number", F.lit(1))))
        blocks = F.array_distinct(F.concat(F.array_compact(F.array(place, F.concat(F.lit("="), "identity"))), _word_prefix(F.col("n")), _word_prefix(F.col("identity"))))
        return cut(t.select(key, item, *(p + f for f in fields), coded("n").alias(p + "n"), coded("identity").alias(p + "identity"), coded("labels").alias(p + "labels"), F.transform(blocks, coded).alias(p + "blocks")))

    l, r = side(local, "group_id", "track_id", "l_"), side(remote, "collection_id", "catalog_track_id", "r_")
    lb = candidates.join(l.select("group_id", "track_id", F.explode("l_blocks").alias("block")), "group_id")
    rb = r.select("collection_id", "catalog_track_id", F.explode("r_blocks").alias("block"))
    near = lb.join(rb, ["collection_id", "block"]).select("group_id", "collection_id", "track_id", "catalog_track_id").distinct()
    p = near.join(l.drop("l_blocks"), ["group_id", "track_id"]).join(r.drop("r_blocks"), ["collection_id", "catalog_track_id"])
    same_place = (F.coalesce("l_disc_number", F.lit(1)) == F.coalesce("r_disc_number", F.lit(1))) & (F.col("l_track_number") == F.col("r_track_number"))
    p = p.where(F.col("l_labels") == F.col("r_labels")).where(~F.coalesce(same_place, F.lit(False)) | (F.col("l_identity") == F.col("r_identity")))
    p = p.withColumn("duration_score", measures.duration_similarity(F.col("l_duration_ms"), F.col("r_duration_ms"))).where("duration_score > 0")
    title = F.when(F.col("l_n") == F.col("r_n"), F.lit(1.0)).otherwise(text.title_similarity_udf("l_title", "r_title"))
    p = p.withColumn("title_score", title).where(F.col("title_score") >= TITLE_GATE)
    p = p.withColumn("position_score", measures.position_similarity(F.col("l_disc_number"), F.col("l_track_number"), F.col("r_disc_number"), F.col("r_track_number")))
    p = cut(p.withColumn("pair_score", 0.74 * F.col("title_score") + 0.16 * F.col("duration_score") + 0.10 * F.col("position_score")).withColumn("artists_match", text.artist_match(text.fold_udf("l_artist"), text.fold_udf("r_artist"))))
    chosen = ranking.greedy_pairs(p, ["group_id", "collection_id"], "track_id", "catalog_track_id", "pair_score").drop("pair_score")
    return p.join(chosen, ["group_id", "collection_id", "track_id", "catalog_track_id"]).select("group_id", "collection_id", "track_id", "catalog_track_id", "title_score", "duration_score", "position_score", "artists_match", "pair_score")


def scores(groups: DataFrame, albums: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """Feature scores and the weighted total of each candidate of `album_search`."""
    found = cut(album_search(groups, albums).select("group_id", "collection_id"))
    matched = track_pairs(found, local, remote).groupBy("group_id", "collection_id").agg(
        F.count("*").alias("matches"), F.avg("title_score").alias("track_title"), F.avg("duration_score").alias("duration"), F.avg("position_score").alias("position"), F.avg(F.col("artists_match").cast("double")).alias("track_artist")
    )
    songs = remote.groupBy("collection_id").agg(F.count("*").alias("songs"))
    g = groups.select("group_id", F.col("album").alias("g_album"), F.col("album_artist").alias("g_artist"), F.col("year").alias("g_year"), F.col("track_count").alias("g_count"))
    a = albums.select("collection_id", F.col("album").alias("c_album"), F.col("artist").alias("c_artist"), F.col("release_year").alias("c_year"), F.col("track_count").alias("c_count")).join(songs, "collection_id", "left")
    s = found.join(matched, ["group_id", "collection_id"], "left").join(g, "group_id").join(a, "collection_id").fillna(0, ["matches", "track_title", "duration", "position", "track_artist", "songs"])
    declared = F.coalesce(F.expr("nullif(c_count, 0)"), "songs")
    s = s.withColumn("album", text.similarity_udf("g_album", "c_album")).withColumn("artist", text.similarity_udf("g_artist", "c_artist"))
    s = s.withColumn("track_count", measures.count_score(F.col("g_count"), declared)).withColumn("year", measures.year_score(F.col("g_year"), F.col("c_year")))
    s = s.withColumn("coverage", F.col("matches") / F.greatest("g_count", "songs", declared, F.lit(1))).withColumn("topology", 0.5 * F.col("track_count") + 0.5 * F.col("position"))
    total = None
    for name, weight in WEIGHTS.items():
        total = F.col(name) * weight if total is None else total + F.col(name) * weight
    return s.select("group_id", "collection_id", "matches", "coverage", *dict.fromkeys([*WEIGHTS, "track_count", "position"]), total.alias("total"))


def decide(scored: DataFrame, least: float = LEAST_SCORE, margin: float = LEAST_MARGIN, groups: DataFrame | None = None) -> DataFrame:
    """(group_id, status, collection_id, best, next): `matched`, `ambiguous` (a runner within the margin) or `low confidence`;
    with `groups` (group_id) also `no match` for those that have no candidate."""
    r = ranking.ranked(scored, "group_id", "total", "collection_id").where("rank = 1")
    status = F.when(F.col("best") < least, "low confidence").when(F.col("best") - F.col("next") < margin, "ambiguous").otherwise("matched")
    found = r.select("group_id", status.alias("status"), "collection_id", "best", "next")
    if groups is None:
        return found
    return groups.select("group_id").distinct().join(found, "group_id", "left").withColumn("status", F.coalesce("status", F.lit("no match")))

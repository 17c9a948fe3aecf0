"""The query catalogue of the core: name -> plan, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import ids, measures, paths, text
from tagloom.operators import assembly, diagnostics, grouping, identified, matching, ranking, relations, split_values
from tagloom.plans import statements
from tagloom.session import cut, table
from tagloom.sources import store
from tagloom.streaming import feeds


def _t(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: table(spark, d, name)


tracks, groups, albums, songs = _t("tracks"), _t("album_groups"), _t("catalog_albums"), _t("catalog_tracks")


def _disc_positions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Tracks and lineitems as positioned track lists, for the joins by position."""
    line = table(spark, d, "lineitem").withColumn("disc", F.when(F.col("l_linestatus") == "F", 1).otherwise(2)).withColumn("ms", F.floor("l_extendedprice").cast("long"))
    local = line.groupBy("l_orderkey", "disc", "l_linenumber").agg(F.min("ms").alias("ms"))
    remote = line.groupBy("l_orderkey", "disc", "l_linenumber").agg(F.min(F.col("ms") + F.pmod(F.col("l_partkey") * 37, F.lit(5000))).alias("other_ms"))
    return local, remote


# filters and projections
def glob_filter(spark, d):
    return tracks(spark, d).where(paths.matches_any(F.col("path"), ["/lib0?/**/*.flac", "/lib1*/*/r0000*/1-*.mp3"]) & ~paths.matches_any(F.col("path"), ["/lib05/**"])).select("track_id", "path")


def protected_prefix_filter(spark, d):
    return tracks(spark, d).where(paths.is_protected(F.col("path"), ["an", "ka", "lib07"])).select("track_id", "path")


def required_fields(spark, d):
    return grouping.unusable(tracks(spark, d)).groupBy("missing").agg(F.count("*").alias("n"))


def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean_column(F.col("text"), 1 << 20)).alias("cleaned"))


def layout_folders(spark, d):
    folder = F.explode(paths.folders(F.col("path")))
    return tracks(spark, d).select(folder.alias("folder")).groupBy("folder").agg(F.count("*").alias("n")).select("folder", "n", paths.is_layout(F.col("folder")).alias("layout"))


# identifiers, numbers, dates, URLs
def gtin_check(spark, d):
    return tracks(spark, d).select("track_id", ids.barcode(F.col("barcode")).alias("gtin"), ids.barcode_key(F.col("barcode")).alias("gtin_key"))


def uuid_canonical(spark, d):
    return tracks(spark, d).select("track_id", ids.uuid(F.upper(F.concat(F.lit("{"), F.regexp_replace("mb_release_id", "-", ""), F.lit("}")))).alias("release_id"), ids.uuid(F.col("mb_recording_id")).alias("recording_id"))


def number_pair(spark, d):
    pair = ids.number_pair(F.concat_ws("/", F.col("track_number").cast("string"), F.col("track_total").cast("string")))
    return tracks(spark, d).select("track_id", *(c.cast("string").alias(n) for n, c in (("number", pair["number"]), ("total", pair["total"]), ("discs", ids.standalone_total(F.col("disc_total").cast("string"))))))


def year_extract(spark, d):
    return albums(spark, d).select("collection_id", ids.year(F.concat_ws(" ", "album", F.col("release_year").cast("string"))).cast("string").alias("year_found"))


def matching_basis(spark, d):
    return groups(spark, d).select("group_id", ids.basis(F.col("mb_release_id"), F.col("barcode")).alias("basis"))


def url_allowlist(spark, d):
    return albums(spark, d).select("collection_id", ids.allowed_https(F.col("artwork_url"), ["art.invalid"], ["mzstatic.com"]).alias("allowed"), F.try_element_at(store.image_urls(F.col("artwork_url")), F.lit(1)).alias("first_url"), F.size(store.image_urls(F.col("artwork_url"))).alias("urls"))


def url_ids(spark, d):
    hosts = F.element_at(F.array(*(F.lit(h) for h in ("music.example.org", "music.example.org", "evil.example.org", "music.example.org.evil.org"))), (F.pmod("collection_id", F.lit(4)) + 1).cast("int"))
    scheme = F.when(F.pmod("collection_id", F.lit(7)) == 0, "http").otherwise("https")
    made = albums(spark, d).select("collection_id", F.concat(scheme, F.lit("://"), hosts, F.lit("/us/album/some-name/"), F.when(F.pmod("collection_id", F.lit(5)) != 0, "id").otherwise("x"), F.col("collection_id")).alias("url"))
    return made.select("collection_id", ids.collection_id(F.col("url"), ["music.example.org"]).cast("string").alias("found"))


def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def sha256_key(spark, d):
    return groups(spark, d).select("group_id", ids.cache_key(term=F.col("album"), artist=F.col("album_artist"), limit=F.lit(50)).alias("cache_key"))


def picture_size(spark, d):
    return table(spark, d, "documents").select("doc_id", ids.picture_size(F.col("lang"), F.col("subject"), F.col("text")).alias("bytes"))


def retry_delay(spark, d):
    return table(spark, d, "events").select("event_id", F.round(ids.retry_delay(F.pmod("event_id", F.lit(9)), F.pmod("user_id", F.lit(4)) / 16.0), 6).alias("seconds"))


# text
def fold_text(spark, d):
    return albums(spark, d).select("collection_id", text.fold_udf("album").alias("album_n"), text.fold_udf("artist").alias("artist_n"))


def version_qualifiers(spark, d):
    return albums(spark, d).select("collection_id", F.array_join(text.qualifiers_udf("album"), ",").alias("labels"), F.array_join(text.semantic_qualifiers_udf("album"), ",").alias("semantic"))


def album_identities(spark, d):
    return albums(spark, d).select("collection_id", text.album_identity_udf("album").alias("identity"), text.strip_album_label_udf("album").alias("bare"))


def feature_credits(spark, d):
    return tracks(spark, d).where("title IS NOT NULL").select("track_id", text.drop_credits_udf("artist").alias("base_artist"), F.array_join(text.featured_udf("title", "artist"), "|").alias("featured"))


def token_jaccard(spark, d):
    a = albums(spark, d).select("collection_id", F.lower("album").alias("a"), F.lower("artist").alias("b"))
    return a.select("collection_id", F.round(text.token_jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


# grouping and diagnostics
def group_tracks(spark, d):
    g = grouping.releases(grouping.linked(tracks(spark, d)))
    return g.select(F.element_at("files", 1).alias("first_file"), F.element_at("files", -1).alias("last_file"), "file_count", "year", "barcode", "release_id", "provenance_complete", F.array_join("conflicts", ",").alias("conflicts"))


def logical_tracks(spark, d):
    members = cut(grouping.linked(tracks(spark, d)))
    return grouping.logical_tracks(members).groupBy("component").agg(F.count("*").alias("logical_tracks"), F.min("path").alias("first_file")).drop("component")


def duplicate_positions(spark, d):
    return relations.repeated(table(spark, d, "lineitem"), ["l_suppkey", "l_linenumber"], "l_partkey").withColumnRenamed("first", "first_part")


def conflict_detect(spark, d):
    return relations.conflicting(table(spark, d, "lineitem"), "l_partkey", ["l_linenumber"], "l_suppkey")


def _album_songs(spark, d):
    return songs(spark, d).select(F.col("collection_id").alias("id"), "disc_number", "track_number", F.lit(None).cast("int").alias("track_total"), F.lit(None).cast("int").alias("disc_total"))


def tracklist_incomplete(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("disc_number"), F.col("l_linenumber").alias("track_number"), F.lit(None).cast("int").alias("track_total"), F.lit(None).cast("int").alias("disc_total"))
    return diagnostics.incomplete(line, "id")


def catalog_incomplete(spark, d):
    return diagnostics.incomplete(_album_songs(spark, d), "id")


def topology(spark, d):
    members = tracks(spark, d).select(F.xxhash64(F.regexp_replace("path", "/[^/]*$", "")).alias("h"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "disc_number", "track_number", "track_total", "disc_total")
    return diagnostics.topology(members, "folder")


def release_assembly(spark, d):
    a = assembly.assemble(albums(spark, d), songs(spark, d), "collection_id", "track_count")
    return a.select("collection_id", "status", F.size("tracks").alias("listed"), F.try_element_at(F.col("tracks.title"), F.lit(1)).alias("first_title"))


# joins
def position_join(spark, d):
    local, remote = _disc_positions(spark, d)
    j = relations.by_position(local, remote, "l_orderkey", ["disc", "l_linenumber"])
    return j.groupBy("l_orderkey").agg(F.sum(F.abs(F.col("ms") - F.col("other_ms"))).alias("distance"), F.count("*").alias("positions"))


def duration_tolerance(spark, d):
    local, remote = _disc_positions(spark, d)
    j = local.join(remote, ["l_orderkey", "disc", "l_linenumber"])
    return j.select("l_orderkey", "disc", "l_linenumber", F.round(measures.duration_similarity(F.col("ms"), F.col("other_ms")), 6).alias("similarity"))


def duration_multiset(spark, d):
    local, remote = _disc_positions(spark, d)
    l = local.groupBy("l_orderkey").agg(F.collect_list("ms").alias("a"), F.count("*").alias("n"))
    r = remote.groupBy("l_orderkey").agg(F.collect_list("other_ms").alias("b"), F.count("*").alias("m"))
    e = measures.duration_multiset(F.col("a"), F.col("b"), F.col("n"), F.col("m"))
    return l.join(r, "l_orderkey").select("l_orderkey", F.round(e["coverage"], 8).alias("coverage"), F.round(e["closeness"], 8).alias("closeness"), F.round(e["distance"], 6).alias("distance"))


def multiset_containment(spark, d):
    line = table(spark, d, "lineitem")
    left = line.where("l_returnflag = 'R'").select("l_suppkey", "l_partkey")
    return ranking.contained(left, line.where("l_linestatus = 'F'").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")


def cascade_priority(spark, d):
    o = table(spark, d, "orders")
    parts = [o.where(F.col("o_orderpriority") == p).select("o_custkey", "o_orderkey") for p in ("1-URGENT", "2-HIGH", "3-MEDIUM")]
    return ranking.cascade(parts, "o_custkey").groupBy("o_custkey", "stage").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


def relation_overlap(spark, d):
    line = table(spark, d, "lineitem")
    both = relations.overlap(line.where("l_returnflag = 'A'"), line.where("l_returnflag = 'R'"), "l_suppkey", "l_partkey")
    return both.select("l_suppkey", "shared", (F.col("shared") > 0).alias("overlap"), F.col("only_left").alias("only_a"))


def folder_owners(spark, d):
    """Folders that hold files of one album only, at any depth."""
    return relations.owned_folders(tracks(spark, d), "path", "album").select("folder", F.col("owner").alias("album"), "files")


def common_folder(spark, d):
    t = tracks(spark, d).groupBy("mb_release_id").agg(F.array_sort(F.collect_set("path")).alias("p")).where("mb_release_id IS NOT NULL")
    return t.select("mb_release_id", paths.common_folder(F.col("p")).alias("folder"))


# ranking and decisions
def topk_before_distinct(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("kind"), "value")
    return ranking.top(e.groupBy("user_id", "kind", "value").agg(F.count("*").alias("c")), "user_id", "value", "kind", 3)


def rank_margin(spark, d):
    r = ranking.ranked(table(spark, d, "orders"), "o_custkey", "o_totalprice", "o_orderkey").where("rank = 1")
    return r.select("o_custkey", "o_orderkey", F.col("best").alias("best_price"), F.round(F.col("best") - F.col("next"), 4).alias("margin"))


def unique_winner(spark, d):
    return ranking.unique_winner(table(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") == "F", "o_orderkey")


def clear_winner(spark, d):
    o = table(spark, d, "orders").withColumn("quality", F.round(F.col("o_totalprice") / 500000, 6))
    return ranking.clear_winner(o, "o_custkey", "quality", "o_orderkey", 0.6, 0.1)


def _logical(spark, d, releases, *carried):
    """The logical tracks of some local releases: first deliveries, with duplicate encodings collapsed."""
    needed = ["path", "ingested_at", "track_id", "title", "artist", "disc_number", "track_number", "duration_ms", "mb_recording_id"]
    files = releases.select(F.col("group_id").alias("component"), F.explode("files").alias("path"))
    listed = tracks(spark, d).select(*needed).join(files, "path", "left_semi")
    first = feeds.first_deliveries(listed, "path", "ingested_at", tie="track_id").drop("ingested_at")
    members = files.join(first, "path").where("title IS NOT NULL").withColumn("recording_id", ids.uuid(F.col("mb_recording_id"))).drop("mb_recording_id")
    return grouping.logical_tracks(members, *carried).select(F.col("component").alias("group_id"), *carried)


def _music(spark, d, releases=None, *carried):
    """Releases (all, if none are given) with the number of their logical tracks, albums, logical tracks with the columns `carried` (all, if none are named), and songs."""
    own = groups(spark, d) if releases is None else releases
    local = _logical(spark, d, own, *(carried or ("track_id", "title", "artist", "disc_number", "track_number", "duration_ms")))
    counts = local.groupBy("group_id").agg(F.count("*").cast("int").alias("logical"))
    g = own.join(counts, "group_id", "left").withColumn("track_count", F.coalesce("logical", "track_count")).drop("files", "logical")
    g = g.select("group_id", "album", "album_artist", "year", "track_count") if releases is None else g
    a = albums(spark, d).select("collection_id", "album", "artist", "release_year", "track_count")
    remote = songs(spark, d).select("collection_id", "catalog_track_id", "title", "artist", "disc_number", "track_number", "duration_ms")
    return cut(g), a, local, remote


def album_search(spark, d):
    g = groups(spark, d).select("group_id", "album", "album_artist", "year", "track_count")
    a = albums(spark, d).select("collection_id", "album", "artist", "release_year", "track_count")
    return matching.album_search(g, a).select("group_id", "collection_id", "place", F.round("search_score", 6).alias("search_score"))


def score_releases(spark, d):
    s = matching.scores(*_music(spark, d))
    return s.select("group_id", "collection_id", "matches", *(F.round(c, 6).alias(c) for c in s.columns if c not in ("group_id", "collection_id", "matches")))


def decide_releases(spark, d):
    music = _music(spark, d)
    r = matching.decide(cut(matching.scores(*music)), groups=music[0])
    return r.select("group_id", "status", "collection_id", F.round("best", 6).alias("best"), F.round("next", 6).alias("next"))


# identifiers
def direct_winner(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") != "A").alias("direct"), (F.col("l_quantity") > 45).alias("exact_count"), (F.col("l_quantity") / 50.0).cast("double").alias("coverage"), (1 - F.col("l_discount")).cast("double").alias("closeness"))
    return identified.evidence_winner(line, "l_orderkey", "l_linenumber")


def equivalent_releases(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("collection_id"), F.col("l_returnflag").alias("title"), F.col("l_linestatus").alias("artist"), F.lit(1).alias("disc_number"), F.col("l_linenumber").alias("track_number"), (F.col("l_quantity") * 1000).cast("long").alias("duration_ms"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("collection_id"), F.col("o_orderpriority").alias("album"), F.col("o_orderstatus").alias("artist"), F.year("o_orderdate").alias("release_year"), F.lit(1).alias("track_count"))
    return identified.equivalent_releases(o, line)


def same_albums_twice(spark, d):
    return identified.equivalent_releases(albums(spark, d), songs(spark, d))


def identifier_scores(spark, d):
    """Scores of the albums that a search finds for releases with an identifier, as if it had led there."""
    tagged = groups(spark, d).where(ids.basis(F.col("mb_release_id"), F.col("barcode")) != "legacy")
    tagged = tagged.select("group_id", "album", "album_artist", "year", "track_count", "files", "barcode", "mb_release_id", F.col("mb_provenance_complete").alias("complete_ids"), F.col("identifier_conflicts").alias("conflicts"))
    named, a, local, remote = _music(spark, d, tagged, "duration_ms")
    found = matching.album_search(named, a).join(named.select("group_id", "barcode", "mb_release_id"), "group_id")
    found = found.select("group_id", "collection_id", F.col("barcode").alias("verified_barcode"), F.col("mb_release_id").alias("verified_release_id"), F.lit("musicbrainz_barcode").alias("resolution"), F.lit(False).alias("recordings_verified"))
    return identified.scores(cut(found), named, a, local, remote)


def identifier_decisions(spark, d):
    scored = cut(identifier_scores(spark, d))
    exact = assembly.assemble(albums(spark, d), songs(spark, d), "collection_id", "track_count").where("status = 'complete'")
    return identified.decide(scored, exact, identified.equivalent_releases(albums(spark, d), songs(spark, d)))


def run_summary(spark, d):
    t = tracks(spark, d)
    return store.summary(t, {"tracks": F.lit(True), "untitled": F.coalesce("title", F.lit("")) == "", "with_barcode": F.col("barcode").isNotNull(), "valid_barcode": ids.barcode(F.col("barcode")).isNotNull(), "with_release_id": F.col("mb_release_id").isNotNull()})


def warning_histogram(spark, d):
    return store.histogram(tracks(spark, d), "identifier_warnings")


# time
def cache_ttl(spark, d):
    t = tracks(spark, d)
    return store.fresh(t, "ingested_at", F.lit("2024-01-01").cast("timestamp"), "400 days").select("track_id")


def first_deliveries(spark, d):
    return feeds.first_deliveries(tracks(spark, d).select("path", "track_id", "ingested_at"), "path", "ingested_at", tie="track_id").select("path", "track_id", "ingested_at")


def daily_arrivals(spark, d):
    return feeds.arrivals(tracks(spark, d), "scanned_at", "tagger")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per act of every artist field that names two or more acts."""
    rows = tracks(spark, d).select(F.lit("tracks").alias("tbl"), F.col("track_id").alias("row_id"), "artist")
    rows = rows.unionByName(songs(spark, d).select(F.lit("catalog_tracks").alias("tbl"), F.col("catalog_track_id").alias("row_id"), "artist"))
    known = table(spark, d, "artist_credits").select("name").union(tracks(spark, d).select("album_artist")).union(albums(spark, d).select("artist")).distinct()
    return split_values.split_fields(rows, "artist", known)


NAMES = """glob_filter protected_prefix_filter required_fields clean_text layout_folders gtin_check uuid_canonical number_pair year_extract matching_basis url_allowlist
url_ids json_props sha256_key picture_size retry_delay fold_text version_qualifiers album_identities feature_credits token_jaccard group_tracks logical_tracks duplicate_positions conflict_detect
tracklist_incomplete catalog_incomplete topology release_assembly position_join duration_tolerance duration_multiset multiset_containment cascade_priority relation_overlap
folder_owners common_folder topk_before_distinct rank_margin unique_winner clear_winner album_search score_releases decide_releases direct_winner equivalent_releases same_albums_twice identifier_scores identifier_decisions run_summary warning_histogram cache_ttl
first_deliveries daily_arrivals p5_found""".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in NAMES}


def oracle_sql() -> dict[str, str]:
    return statements.STATEMENTS

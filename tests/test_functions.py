import pytest
from pyspark.sql import functions as F

from tagloom.functions import ids, measures, paths, text


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_fold_and_similarity():
    assert text.fold("  Beyoncé & JAY‑Z!  ") == "beyonce and jay z"
    assert text.fold("") == "" and text.fold("a_b") == "a_b"
    assert text.similarity("First Light", "First Light II") == pytest.approx(0.805333, abs=1e-5)
    assert text.similarity("", "x") == 0 and text.similarity("The  A", "the a") == 1
    assert text.similarity("tide", "diet") != text.similarity("diet", "tide")  # the ratio is not symmetric


def test_artists():
    assert text.same_artist("The National", "National") and not text.same_artist("The The", "the") and not text.same_artist("", "")
    assert text.same_artist("the the x", "the x") and not text.same_artist("the the x", "x")
    assert text.extends_credit("A & B", "A") and text.extends_credit("A feat. B", "A") and not text.extends_credit("AB", "A")
    assert text.same_artist_and_features("Song (feat. B)", "A", "Song", "A & B")
    assert not text.same_artist_and_features("Song (feat. B)", "A", "Song (feat. C)", "A")


def test_labels():
    assert text.qualifiers("X (2011 Remaster) [Live]") == {"remaster", "remaster:2011", "live"}
    assert text.qualifiers("X 25th Anniversary Edition") == {"anniversary", "anniversary:25"}
    assert text.semantic_qualifiers("X (Deluxe Edition) (Remastered 2011) Live") == {"live"}
    assert text.remaster_years_conflict("X (2011 Remaster)", "X (2015 Remaster)") and not text.remaster_years_conflict("X", "X (2015 Remaster)")
    assert text.drop_credits("Song (feat. B - Live)") == "Song [Live]" and text.drop_credits("Song feat. B") == "Song"
    assert text.drop_credits("Song (feat. B") == "Song (feat. B" and text.drop_credits("Song (feat. B (of C)) (Live)") == "Song (Live)"
    assert text.featured("Song (feat. B & C)", "A ft. D") == {"b", "c", "d"}
    assert text.track_identity("Runnin' (Album Version)") == "running"
    assert text.album_identity("Name, Volume 2 (Deluxe Edition) - EP") == "name vol 2"
    assert text.albums_related("Name", "Name (The White Album)") and not text.albums_related("Name", "Other")
    assert text.duplicate_identity("Song (feat. B) [Explicit] (Remastered)") == "song"
    assert text.search_base("Song (Album Version)") == "Song"
    assert len(text.feature_credits("x" * 5000 + " feat. y")) == 0


def test_columns_match_the_core(spark):
    values = ["The  Crème & Co.", "", None, "the the", "The X"]
    got = one(spark, [(v,) for v in values], "v string", text.fold_udf("v"))
    assert [g[0] for g in got] == [None if v is None else text.fold(v) for v in values]
    pairs = [("the x", "x"), ("the the", "the"), ("", ""), (None, "x"), ("a", "a")]
    got = one(spark, pairs, "a string, b string", text.artist_match(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [True, False, False, False, True]
    got = one(spark, [("a\tb\x00 c",), (None,), ("x" * 5000,)], "v string", text.clean_column(F.col("v")))
    assert [g[0] for g in got] == ["a b c", "", ""]


def test_identifiers(spark):
    got = one(spark, [("0123-4567 8905",), ("012345678906",), ("00000000",), ("",), (None,), ("12a45678",)], "v string", ids.barcode(F.col("v")), ids.barcode_key(F.col("v")))
    assert got[0] == ("012345678905", "00012345678905") and all(g == (None, None) for g in got[1:])
    nil = "00000000-0000-0000-0000-000000000000"
    got = one(spark, [("{12345678-1234-5678-9234-567812345678}",), ("urn:uuid:12345678123456789234567812345678",), (nil,), ("x",), (None,)], "v string", ids.uuid(F.col("v")))
    assert [g[0] for g in got] == ["12345678-1234-5678-9234-567812345678"] * 2 + [None] * 3
    got = one(spark, [("3/12",), ("13/12",), ("7",), ("0/3",), ("a",), (None,), ("12345",)], "v string", ids.number_pair(F.col("v")))
    assert [tuple(g[0]) for g in got] == [(3, 12), (13, None), (7, None), (None, None), (None, None), (None, None), (None, None)]
    got = one(spark, [("12 1999 x",), ("19991",), ("2200",), (None,)], "v string", ids.year(F.col("v")))
    assert [g[0] for g in got] == [1999, None, None, None]
    got = one(spark, [("https://a.b.c/x",), ("http://a.b.c/x",), ("https://u@b.c/x",), ("https://b.c.evil/x",), (None,)], "v string", ids.allowed_https(F.col("v"), [], ["b.c"]))
    assert [g[0] for g in got] == [True, False, False, False, False]
    urls = ["https://m.x/us/album/some/id12", "https://m.x/album/12", "https://m.x/viewAlbum?a=1&id=7", "https://m.x/us/song/12", None]
    assert [g[0] for g in one(spark, [(u,) for u in urls], "v string", ids.collection_id(F.col("v"), ["m.x"]))] == [12, 12, 7, None, None]


def test_measures(spark):
    got = one(spark, [(180000, 180100), (180000, 185000), (600000, 603000), (None, 1)], "a long, b long", measures.duration_similarity(F.col("a"), F.col("b")))
    assert [round(g[0], 6) for g in got] == [0.99, 0.0, 0.800995, 0.5]
    got = one(spark, [([3, 1, None], [1, 3]), ([], [1]), ([1], [50000])], "a array<long>, b array<long>", measures.duration_multiset(F.col("a"), F.col("b"), F.size("a"), F.size("b")))
    assert [tuple(g[0]) for g in got] == [(2 / 3, 2 / 3, 0.0), (0.5, 0.0, 0.0), (0.0, 0.0, 49999.0)]


def test_paths(spark):
    import re

    assert re.match(paths.glob_pattern("a/**/*.mp3"), "a/x.mp3") and re.match(paths.glob_pattern("a/**/*.mp3"), "a/b/c/x.mp3")
    assert not re.match(paths.glob_pattern("a/*.mp3"), "a/b/x.mp3") and re.match(paths.glob_pattern("a\\b?.mp3"), "a/b1.mp3")
    got = one(spark, [("/00x/a.mp3",), ("/x/00a.mp3",), ("/a/DCC/b.mp3",), ("a.mp3",)], "p string", paths.is_protected(F.col("p")))
    assert [g[0] for g in got] == [True, False, True, False]
    got = one(spark, [(["/a/b/1.mp3", "/a/b/c/2.mp3"],), (["/a/1.mp3", "/b/2.mp3"],), (["/a/b/1.mp3"],)], "p array<string>", paths.common_folder(F.col("p")))
    assert [g[0] for g in got] == ["/a/b", "/", "/a/b"]


def test_plain_titles_run_no_label_pattern(monkeypatch):
    def never(*_):
        raise AssertionError("a title without any label was searched for each of them")

    monkeypatch.setattr(text.re, "search", never)
    assert text.qualifiers("Harbour Bell") == set() and text.title_similarity("Harbour  Bell", "harbour bell") == 1.0
    monkeypatch.undo()
    assert text.qualifiers("Bell (2011 Digital Remaster, 20th Anniversary)") == {"remaster", "anniversary", "anniversary:20", "remaster:2011"}

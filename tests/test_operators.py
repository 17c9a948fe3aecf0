import random
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagloom.functions import measures, text
from tagloom.functions.sequences import ratios
from tagloom.operators import assembly, diagnostics, grouping, identified, matching, ranking, relations, searching, split_values
from tagloom.operators.components import components
from tagloom.operators.skew import lookup_join
from tagloom.operators.streamed import grouped_rows

TRACK = "path string, title string, artist string, album string, album_artist string, year int, track_number int, track_total int, disc_number int, disc_total int, duration_ms long, barcode string, mb_release_id string, mb_recording_id string, extra string, n long"


def track(path, title="T", artist="A", album="B", number=1, disc=None, barcode=None, release=None, recording=None, album_artist=None, total=None, year=2000):
    return (path, title, artist, album, album_artist, year, number, total, disc, None, 1000, barcode, release, recording, "x", 1)


@pytest.mark.parametrize("split", [1_000_000, 0])
def test_components_against_union_find(spark, monkeypatch, split):
    monkeypatch.setattr("tagloom.operators.components.SPLIT", split)
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200), (5, 5)]
    parent = {n: n for e in edges for n in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lookup_join_with_a_heavy_key(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(90)] + [(99, None)], "i long, k string")
    counted = left.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.upper("k"))
    got = lookup_join(left, counted, "k", "n", 90, share=0.1)
    assert got.count() == 90 and got.where("v <> upper(k)").count() == 0 and "n" not in got.columns


def test_grouped_rows(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(100)], "k long, v long")
    got = grouped_rows(df, "k", ["v"], lambda rows: [(rows[0][0], len(rows))], "first long, n long").collect()
    assert sorted((r["first"], r["n"]) for r in got) == [(i, 15 if i < 2 else 14) for i in range(7)]
    assert grouped_rows(df.where("false"), "k", ["v"], lambda rows: [(1, 1)], "first long, n long").count() == 0


def test_grouping_links_transitively_and_keeps_siblings_apart(spark):
    uid, gtin = "12345678-1234-5678-9234-567812345678", "012345678905"
    rows = [
        track("/m/x/1.mp3", release=uid), track("/m/y/2.mp3", album="Other", release=uid, barcode=gtin, number=2), track("/m/z/3.mp3", album="Third", barcode="0" + gtin, number=3),
        track("/m/q/1.mp3"), track("/m/bad.mp3", title=None), track("/m/bad2.mp3", album=""),
    ]
    df = spark.createDataFrame(rows, TRACK)
    found = {tuple(r["files"]): r for r in grouping.releases(grouping.linked(df)).collect()}
    assert set(found) == {("/m/x/1.mp3", "/m/y/2.mp3", "/m/z/3.mp3"), ("/m/q/1.mp3",)}
    joined = found["/m/x/1.mp3", "/m/y/2.mp3", "/m/z/3.mp3"]
    assert joined["album"] == "B" and joined["release_id"] == uid and joined["conflicts"] == [] and joined["year"] == 2000
    assert {tuple(r) for r in grouping.unusable(df).collect()} == {("/m/bad.mp3", "title"), ("/m/bad2.mp3", "album")}
    assert grouping.releases(grouping.linked(df.where("false"))).count() == 0


def test_folder_names_are_folded_and_recordings_clash_by_identity(spark):
    one, two = "12345678-1234-5678-9234-567812345678", "22345678-1234-5678-9234-567812345678"
    rows = [track("/m/Été/side one/1.mp3", album="Été"), track("/m/Été/side two/2.mp3", album="Ete", number=2), track("/m/k/1.mp3", album="K", title="Song", recording=one), track("/m/k/2.mp3", album="K", title="Song [Explicit]", recording=two)]
    found = {tuple(r["files"]): r["conflicts"] for r in grouping.releases(grouping.linked(spark.createDataFrame(rows, TRACK))).collect()}
    assert found == {("/m/Été/side one/1.mp3", "/m/Été/side two/2.mp3"): [], ("/m/k/1.mp3", "/m/k/2.mp3"): ["recording ids differ at one position"]}


def test_logical_tracks(spark):
    rec = "12345678-1234-5678-9234-567812345678"
    rows = [
        track("/m/x/a.flac", title="Song"), track("/m/x/b.mp3", title="Song [Explicit]", recording=rec), track("/m/x/c.mp3", title="Song (feat. D)", number=2),
        track("/m/x/d.mp3", title="Other", number=2), track("/m/x/e.mp3", title="Song", number=None), track("/m/x/f.mp3", title="Song", number=None),
    ]
    got = grouping.logical_tracks(grouping.linked(spark.createDataFrame(rows, TRACK)))
    assert sorted(r["path"] for r in got.collect()) == ["/m/x/b.mp3", "/m/x/c.mp3", "/m/x/d.mp3", "/m/x/e.mp3"]


def test_logical_tracks_carry_columns_and_fold_only_shared_places(spark):
    rows = [track("/m/x/a.flac", title="Song"), track("/m/x/b.mp3", title="Song [Explicit]"), track("/m/x/c.mp3", title="Song", number=2), track("/m/x/d.mp3", title="SONG!", number=None), track("/m/x/e.mp3", title="Song", number=None)]
    members = spark.createDataFrame(rows, TRACK).withColumn("component", F.lit(7)).withColumn("recording_id", F.lit(None).cast("string")).withColumn("size", F.length("title"))
    got = grouping.logical_tracks(members, "size", "title")
    assert got.columns == ["component", "path", "size", "title"]
    assert sorted((r["path"], r["size"], r["title"]) for r in got.collect()) == [("/m/x/a.flac", 4, "Song"), ("/m/x/c.mp3", 4, "Song"), ("/m/x/d.mp3", 5, "SONG!")]


def test_durations_are_sorted_once_and_similarities_are_batched(spark):
    df = spark.createDataFrame([([300000, None, 100000], [100500, 330000], 3, 2), ([None], [5], 1, 1), ([], [], 0, 0)], "a array<long>, b array<long>, n long, m long")
    e = df.select(measures.duration_multiset(F.col("a"), F.col("b"), F.col("n"), F.col("m")).alias("e"))
    assert e._jdf.queryExecution().optimizedPlan().toString().count("sort_array") == 2
    assert [tuple(r["e"]) for r in e.collect()] == [(1 / 3, pytest.approx((1.0 - 0.15 * 0.05) / 3), 30500.0), (0.5, 0.0, 0.0), (0.5, 0.0, 0.0)]
    pairs = [("Night Ledger", "night ledger!"), ("Night Ledger", "Ledger of Night"), ("", "x"), ("!", "!"), ("Silver", "Gold")]
    assert text.similarities(pairs) == [text.similarity(*p) for p in pairs]
    got = spark.createDataFrame([*pairs, (None, "x")], "a string, b string").select(text.similarity_udf("a", "b")).collect()
    assert [r[0] for r in got] == [*text.similarities(pairs), None]


POSITION = "id long, disc_number int, track_number int, track_total int, disc_total int"


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([(1, None, 1, 2, None), (1, None, 2, 2, None)], False),
        ([(1, None, 1, 3, None), (1, None, 3, 3, None)], True),
        ([(1, None, 1, None, None), (1, None, 1, None, None)], True),
        ([(1, None, None, None, None)], True),
        ([(1, 2, 1, None, None)], True),
        ([(1, 1, 1, 4, 2), (1, 1, 2, 4, 2), (1, 2, 1, 4, 2), (1, 2, 2, 4, 2)], False),
        ([(1, 1, 1, 2, 2), (1, 1, 2, 2, 2)], True),
    ],
)
def test_incomplete(spark, rows, expected):
    assert [r["incomplete"] for r in diagnostics.incomplete(spark.createDataFrame(rows, POSITION), "id").collect()] == [expected]


def test_topology(spark):
    rows = [(1, None, n, 14, None) for n in range(1, 15) if n != 12] + [(2, 1, 1, 4, 2), (2, 1, 2, 4, 2), (2, 2, 1, 4, 2), (2, 2, 2, 4, 2)] + [(3, 1, 1, None, 3)]
    got = {r["id"]: r for r in diagnostics.topology(spark.createDataFrame(rows, POSITION), "id").collect()}
    assert (got[1]["scope"], got[1]["missing"], got[1]["missing_count"]) == ("disc", "1.12", 1)
    assert (got[2]["scope"], got[2]["layout"], got[2]["missing_count"]) == ("album", "per_disc", 0)
    assert (got[3]["scope"], got[3]["missing_discs"]) == ("unknown", "2,3")


def test_assembly(spark):
    a = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "collection_id long, track_count int")
    s = spark.createDataFrame([(1, "x", "a", 1, 1, 2), (1, "y", "a", 1, 1, 1), (2, "x", "a", 1, 1, 1), (3, "x", "a", 1, 1, 2)], "collection_id long, title string, artist string, duration_ms long, disc_number int, track_number int")
    got = {r["collection_id"]: (r["status"], [t["title"] for t in r["tracks"]]) for r in assembly.assemble(a, s, "collection_id", "track_count").collect()}
    assert got == {1: ("complete", ["y", "x"]), 2: ("count differs", ["x"]), 3: ("positions broken", []), 4: ("no songs", [])}


def test_release_documents(spark):
    good = '{"id":"12345678-1234-5678-9234-567812345678","title":"T","date":"2001-02","barcode":"012345678905","artist-credit":[{"name":"A","joinphrase":" & "},{"name":"B"}],"media":[{"track-count":2,"tracks":[{"recording":{"id":"12345678-1234-5678-9234-567812345678"}}]}],"relations":[{"url":{"resource":"https://m.x/us/album/n/7"}}]}'
    got = assembly.parse_release(spark.createDataFrame([(good,), ("{",), ('{"id":"x"}',), (None,)], "payload string"), "payload", ["m.x"]).collect()
    assert [r["status"] for r in got] == ["ok", "malformed", "invalid id", "malformed"]
    assert (got[0]["artist"], got[0]["year"], got[0]["track_count"], got[0]["collection_ids"]) == ("A & B", 2001, 2, [7])


def test_ranking(spark):
    rows = spark.createDataFrame([("g", 1, 0.9), ("g", 2, 0.9), ("g", 2, 0.8), ("g", 3, 0.5), ("h", 4, 0.95)], "g string, i long, s double")
    assert sorted(tuple(r) for r in ranking.top(rows, "g", "s", "i", 3).select("g", "i", "place").collect()) == [("g", 1, 1), ("g", 2, 2), ("h", 4, 1)]
    assert [tuple(r) for r in ranking.clear_winner(rows, "g", "s", "i").collect()] == [("h", 4)]
    pairs = spark.createDataFrame([("g", 1, 1, 0.9), ("g", 1, 2, 0.95), ("g", 2, 2, 0.95), ("g", 2, 1, 0.1)], "g string, l long, r long, s double")
    assert sorted((r["l"], r["r"]) for r in ranking.greedy_pairs(pairs, ["g"], "l", "r", "s").collect()) == [(1, 2), (2, 1)]
    left, right = spark.createDataFrame([("g", 1), ("g", 1)], "g string, i long"), spark.createDataFrame([("g", 1)], "g string, i long")
    assert [tuple(r) for r in ranking.contained(left, right, "g", "i").collect()] == [("g", False)]
    found = ranking.cascade([rows.where("g = 'h'").select("g", "i"), rows.select("g", "i")], "g")
    assert {(r["g"], r["stage"]) for r in found.collect()} == {("h", 0), ("g", 1)}


def test_decision_on_the_three_track_release(spark):
    groups = spark.createDataFrame([(1, "Night Ledger", "Orrin", 2011, 3)], "group_id long, album string, album_artist string, year int, track_count int")
    albums = spark.createDataFrame([(11, "Night Ledger", "Mabel", 2011, 3), (22, "Night Ledger", "Orrin", 2011, 3)], "collection_id long, album string, artist string, release_year int, track_count int")
    fields = "title string, artist string, disc_number int, track_number int, duration_ms long"
    songs = [("Lamplight", 154300), ("Undertow", 223900), ("Harbour Bell", 310050)]
    local = spark.createDataFrame([(1, i, t, "Orrin", 1, i, ms) for i, (t, ms) in enumerate(songs, 1)], f"group_id long, track_id long, {fields}")
    remote = spark.createDataFrame([(c, 10 * c + i, t, "Orrin", 1, i, ms + 100) for c in (11, 22) for i, (t, ms) in enumerate(songs, 1)], f"collection_id long, catalog_track_id long, {fields}")
    got = matching.decide(matching.scores(groups, albums, local, remote)).collect()
    assert [(r["status"], r["collection_id"]) for r in got] == [("matched", 22)]


def test_album_search_against_brute_force(spark):
    rng = random.Random(3)
    words = ["silver", "garden", "night", "the", "of", "ledger", "counterrevolutionaries", "counterrevolutionarys", "extraordinarily", "extraordinarilly"]
    album = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))
    artists = ["Orrin", "The Orrin", "Mabel", "mabel"]
    g = [(i, album(), rng.choice(artists), rng.choice([None, 2000, 2005]), rng.choice([None, 8, 9])) for i in range(40)] + [(90, None, "Orrin", None, 8), (91, "night", None, None, 8)]
    a = [(100 + i, album(), rng.choice(artists), rng.choice([None, 2001]), rng.choice([None, 8, 10])) for i in range(40)]
    got = matching.album_search(spark.createDataFrame(g, "group_id long, album string, album_artist string, year int, track_count int"), spark.createDataFrame(a, "collection_id long, album string, artist string, release_year int, track_count int"))
    expected = {}
    for i, al, ar, y, n in g:
        found = []
        for c, cal, car, cy, cn in a:
            if ar and text.same_artist(ar, car):
                s, exact = text.similarity(al or "", cal), n is not None and n == cn
                if s >= matching.ALBUM_GATE or exact:
                    found.append((-round(0.52 * s + 0.33 * text.similarity(ar, car) + 0.10 * exact + 0.05 * (y is None or cy is None or abs(y - cy) <= 1), 9), c))
        for place, (score, c) in enumerate(sorted(found)[: matching.SEARCH_ROWS], 1):
            expected[i, c] = (place, -score)
    rows = {(r["group_id"], r["collection_id"]): (r["place"], round(r["search_score"], 9)) for r in got.collect()}
    assert rows == expected and len(rows) > 100


def test_album_search_finds_names_without_common_words(spark):
    g = spark.createDataFrame([(1, "Silver Night", "Orrin", None, 8), (2, "Silver Night", "Orrin", None, 8)], "group_id long, album string, album_artist string, year int, track_count int")
    a = spark.createDataFrame([(10, "Silvernight", "The Orrin", None, 9), (11, "Garden", "Orrin", None, 9)], "collection_id long, album string, artist string, release_year int, track_count int")
    assert sorted((r["group_id"], r["collection_id"], r["place"]) for r in matching.album_search(g, a).collect()) == [(1, 10, 1), (2, 10, 1)]


def test_album_search_in_tiles_and_rounds(spark, monkeypatch):
    rng = random.Random(5)
    album = lambda: text.fold("".join(rng.choice("aab c") for _ in range(rng.randrange(0, 9))))
    g = [(i, album(), "orrin", rng.choice([None, 2000]), rng.choice([None, 8, 9])) for i in range(60)]
    a = [(100 + i, album(), "orrin", rng.choice([2000, 2005]), rng.choice([8, 9])) for i in range(80)]
    expected = set()
    for i, al, _, y, n in g:
        scored = [(-(0.52 * s + 0.33 * 1.0 + 0.10 * (n == cn) + 0.05 * (y is None or abs(y - cy) <= 1)), c) for c, cal, _, cy, cn in a if (s := text.similarity(al, cal)) >= matching.ALBUM_GATE or n == cn]
        expected |= {(i, c, place) for place, (_, c) in enumerate(sorted(scored)[: matching.SEARCH_ROWS], 1)}
    for name, value in (("ROUNDS", (1, 2)), ("POOL", 50), ("CELLS", 60)):
        monkeypatch.setattr(searching, name, value)
    rows = pd.DataFrame([("orrin", "0.0", side, i, [i], x, artist, y, n) for side, rows in ((0, g), (1, a)) for i, x, artist, y, n in rows], columns=["block", "tile", "side", "id", "ids", "album", "artist", "year", "count"])
    found = searching.searcher(matching.ALBUM_GATE, matching.SEARCH_ROWS)(rows)
    assert set(zip(found["lead"], found["collection_id"], found["place"], strict=True)) == expected
    monkeypatch.setattr(matching, "TILE", 7)
    monkeypatch.setattr(matching, "ALBUMS", 30)
    got = matching.album_search(spark.createDataFrame(g, "group_id long, album string, album_artist string, year int, track_count int"), spark.createDataFrame(a, "collection_id long, album string, artist string, release_year int, track_count int"))
    assert {(r["group_id"], r["collection_id"], r["place"]) for r in got.collect()} == expected


def test_sequence_ratios():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcé 漢") for _ in range(rng.choice([0, 1, 3, 9, 30, 210])))
    left, right = [word() for _ in range(300)], [word() for _ in range(300)]
    assert ratios(left, right).tolist() == [SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right, strict=True)]


def test_groups_without_candidates_are_decided(spark):
    scored = spark.createDataFrame([(1, 5, 0.95)], "group_id long, collection_id long, total double")
    got = {r["group_id"]: (r["status"], r["collection_id"]) for r in matching.decide(scored, groups=spark.createDataFrame([(1,), (2,)], "group_id long")).collect()}
    assert got == {1: ("matched", 5), 2: ("no match", None)}


@pytest.mark.parametrize(
    "field, known, expected",
    [
        ("A B; C D", [], ["A B", "C D"]),
        ('"A; B";C', [], ["A; B", "C"]),
        ('"A ""x"" B", C D', [], ['A ""x"" B', "C D"]),
        ("Mukoph & Hammer", ["Mukoph and Hammer"], None),
        ("Mukoph & Hammer", [], None),
        ("Ann Lee & Bob Roe", [], ["Ann Lee", "Bob Roe"]),
        ("Trio, The | Ann Lee", ["The Trio"], ["Trio, The", "Ann Lee"]),
        ("Ann Lee (feat. Bob Roe & Cy Poe)", [], ["Ann Lee", "Bob Roe", "Cy Poe"]),
        ("Ann Lee vs. Bob Roe ft. Cy Poe", [], ["Ann Lee", "Bob Roe", "Cy Poe"]),
        ("Ann Lee\\\\Bob Roe", [], ["Ann Lee", "Bob Roe"]),
        (r"Ann\;Lee; Bob Roe", [], [r"Ann\;Lee", "Bob Roe"]),
        ("Big, Bad, Ugly, Old & Mean Band; Ann Lee", ["Big, Bad, Ugly, Old & Mean Band"], ["Big, Bad, Ugly, Old & Mean Band", "Ann Lee"]),
        ("X Chamber Orchestra and Choir of Y", [], None),
        ('"unclosed; x', [], ['"unclosed', "x"]),
        (";;", [], None),
        ("", [], None),
    ],
)
def test_split_values(spark, field, known, expected):
    values = spark.createDataFrame([(field,), (None,), ("Solo",)], "value string")
    names = spark.createDataFrame([(k,) for k in known] + [(None,)], "name string")
    got = [r["val"] for r in split_values.split_values(values, names).orderBy("pos").collect()]
    assert got == (expected or [])


def test_split_fields_repeats_and_empty(spark):
    rows = spark.createDataFrame([("t", i, "A B; C D", 1) for i in range(5)] + [("t", 9, None, 1)], "tbl string, row_id long, artist string, value long")
    got = split_values.split_fields(rows, "artist", spark.createDataFrame([], "name string"))
    assert got.count() == 10 and got.columns == ["tbl", "row_id", "pos", "val"]
    assert split_values.split_fields(rows.where("false"), "artist", spark.createDataFrame([], "name string")).count() == 0


GTIN, UUID_A, UUID_B = "012345678905", "12345678-1234-5678-9234-567812345678", "22345678-1234-5678-9234-567812345678"
SONG = "title string, artist string, disc_number int, track_number int, duration_ms long, track_total int, disc_total int"


def songs_of(key, ms, titles=None, n=6):
    return [(key, (titles or "Lamp {}").format(i), "Orrin", 1, i, ms + 1000 * i, n, 1) for i in range(1, n + 1)]


def test_identifier_scores_and_decisions(spark):
    groups = spark.createDataFrame(
        [(1, "Night Ledger", "Orrin", 2011, GTIN, None, False, []), (2, "Night Ledger", "Orrin", 2011, None, UUID_A, True, []), (3, "Night Ledger", "Orrin", 2011, GTIN, None, False, ["barcodes differ"]), (4, "Night Ledger", "Orrin", 2011, GTIN, None, False, [])],
        "group_id long, album string, album_artist string, year int, barcode string, mb_release_id string, complete_ids boolean, conflicts array<string>",
    )
    albums = spark.createDataFrame([(10, "Night Ledger", "Orrin", 2011, 6), (11, "Something Else", "Mabel", 2011, 6), (12, "Night Ledger", "Orrin", 2011, 7)], "collection_id long, album string, artist string, release_year int, track_count int")
    local = spark.createDataFrame([r for g in (1, 2, 3, 4) for r in songs_of(g, 180000)], f"group_id long, {SONG}")
    remote = spark.createDataFrame(songs_of(10, 180200) + songs_of(11, 260000) + songs_of(12, 180200, n=6), f"collection_id long, {SONG}")
    rows = [
        (1, 10, "0" + GTIN, None, None), (1, 11, GTIN, None, None), (2, 10, None, UUID_A, "musicbrainz_search"), (2, 11, None, UUID_A, "musicbrainz_other"),
        (2, 12, None, UUID_B, "musicbrainz_barcode"), (3, 10, GTIN, None, None), (4, 10, None, None, None),
    ]
    candidates = spark.createDataFrame([(*r, False) for r in rows], "group_id long, collection_id long, verified_barcode string, verified_release_id string, resolution string, recordings_verified boolean")
    scored = identified.scores(candidates, groups, albums, local, remote)
    got = {(r["group_id"], r["collection_id"]): r for r in scored.collect()}
    assert got[1, 10]["eligible"] and got[1, 10]["direct"] and got[1, 10]["warnings"] == []
    # barcode, count, closeness, names and year
    assert got[1, 10]["total"] == pytest.approx(0.30 + 0.10 + 0.08 * got[1, 10]["closeness"] + 0.07) and got[1, 10]["closeness"] > 0.99
    assert got[1, 11]["eligible"] and got[1, 11]["warnings"] == ["other durations kept", "other album title kept", "other artist kept"]
    assert got[2, 10]["eligible"] and not got[2, 10]["direct"] and got[2, 11]["reasons"] == ["artists differ", "albums differ", "durations differ"]
    assert got[2, 12]["reasons"] == ["no identifier leads to the candidate", "release ids differ", "track list incomplete", "track counts differ"]
    assert got[3, 10]["reasons"] == ["barcodes differ"] and got[4, 10]["reasons"] == ["no identifier leads to the candidate"]
    exact = spark.createDataFrame([(10,), (11,)], "collection_id long")
    none = spark.createDataFrame([], "a long, b long")
    decided = {r["group_id"]: (r["status"], r["collection_id"]) for r in identified.decide(scored, exact, none).collect()}
    assert decided == {1: ("matched", 10), 2: ("matched", 10), 3: ("no match", None), 4: ("no match", None)}
    assert identified.scores(candidates.where("false"), groups, albums, local, remote).count() == 0


def test_equivalent_releases_and_alignment(spark):
    fields = "collection_id long, album string, artist string, release_year int, track_count int"
    albums = spark.createDataFrame([(10, "Night Ledger", "The Orrin", 2011, 6), (11, "night ledger!", "Orrin", 2011, 6), (12, "Night Ledger", "Orrin", 2012, 6), (13, "Night Ledger", "Orrin", 2011, 6), (14, "Night Ledger (2011 Remaster)", "Orrin", 2011, 6)], fields)
    remote = spark.createDataFrame(songs_of(10, 180000) + songs_of(11, 181000) + songs_of(12, 180000) + songs_of(13, 190000) + songs_of(14, 180500, "Lamp {} (Remastered 2011)"), f"collection_id long, {SONG}")
    assert [tuple(r) for r in identified.equivalent_releases(albums, remote).collect()] == [(10, 11)]
    groups = spark.createDataFrame([(1, "Night Ledger", "Orrin")], "group_id long, album string, album_artist string")
    local = spark.createDataFrame(songs_of(1, 180000), f"group_id long, {SONG}")
    candidates = spark.createDataFrame([(1, i) for i in (10, 13, 14)], "group_id long, collection_id long")
    # 10 differs by no label, 13 by its durations
    assert [tuple(r) for r in identified.aligned(candidates, groups, albums, local, remote).collect()] == [(1, 14)]
    ties = spark.createDataFrame([(0.0, 200.0), (0.0, 50.0), (950.0, 1000.0), (None, 5.0)], "a double, b double")
    assert [r[0] for r in ties.select(identified.breaks_tie(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


def test_songs_are_read_only_for_albums_that_share_their_names(spark, monkeypatch):
    fields = "collection_id long, album string, artist string, release_year int, track_count int"
    albums = spark.createDataFrame([(10, "Night Ledger", "The Orrin", 2011, 6), (11, "night ledger!", "Orrin", 2011, 6), (12, "Night Ledger", "Orrin", 2012, 6), (13, "Night Ledger", "", 2011, 6), (14, "Night Ledger", None, 2011, 6), (15, None, "Orrin", None, None), (16, None, "Orrin", None, None)], fields)
    remote = spark.createDataFrame([r for i in range(10, 17) for r in songs_of(i, 180000)], f"collection_id long, {SONG}")
    seen, positions = [], identified.positions
    monkeypatch.setattr(identified, "positions", lambda songs, key: seen.append({r[0] for r in songs.select(key).collect()}) or positions(songs, key))
    assert sorted(tuple(r) for r in identified.equivalent_releases(albums, remote).collect()) == [(10, 11), (15, 16)]
    assert seen == [{10, 11, 15, 16}]


def test_relations(spark):
    rows = spark.createDataFrame([("g", 1, "a"), ("g", 1, "b"), ("g", 2, "a"), ("g", 2, None), ("h", 1, "a"), (None, None, None)], "g string, p int, v string")
    assert sorted((r["g"] or "", r["conflicts"]) for r in relations.conflicting(rows, "g", ["p"], "v").collect()) == [("", 0), ("g", 1), ("h", 0)]
    assert [tuple(r) for r in relations.repeated(rows, ["g", "p"], "v").orderBy("p").collect()] == [("g", 1, 2, "a"), ("g", 2, 2, "a")]
    both = {r["g"]: (r["shared"], r["only_left"]) for r in relations.overlap(rows, rows.where("p = 1"), "g", "v").collect()}
    assert both["g"] == (2, 0) and both["h"] == (1, 0)
    files = spark.createDataFrame([("/m/a/1.mp3", "x"), ("/m/a/cd 1/2.mp3", "x"), ("/m/b/3.mp3", "y"), ("/m/b/4.mp3", "x"), ("/n/5.mp3", None), ("6.mp3", "z")], "path string, owner string")
    assert {tuple(r) for r in relations.owned_folders(files, "path", "owner").collect()} == {("/m/a", "x", 2), ("/m/a/cd 1", "x", 1)}

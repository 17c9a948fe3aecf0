"""Operators against brute force, exact round trips and edge cases (nulls, empty and long texts, ties, repeats, extra columns)."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagloom.llm import collapse, encoding, leaks, lookalike, names, packed, packing, releases, spans, truncation


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# problem 2
def test_collapse_against_brute_force(spark):
    rng = random.Random(1)
    words = ["Ab", "ab!", "c d", "D  C", "", None, "é", "É", "x-y", "y x", "..."]
    rows = [(i, rng.choice(words), rng.choice(words), rng.choice([1, None]), rng.choice(["1", None]), "extra") for i in range(120)]
    got = {r["id"]: (r["kept_id"], r["copies"]) for r in collapse.collapse(frame(spark, rows, "k long, a string, b string, n int, e string, id string"), "k", ["a", "b"], ["e"], ["n"]).collect()}
    canon = lambda v: None if v is None else tuple(sorted(re.findall(r"[^\W_]+", v.lower())))
    groups = {}
    for i, a, b, n, e, _ in rows:
        groups.setdefault((canon(a), canon(b), n, e), []).append(i)
    assert got == {i: (min(g), len(g)) for g in groups.values() for i in g}
    assert collapse.collapse(frame(spark, [], "k long, a string"), "k", ["a"]).count() == 0
    numbers = frame(spark, [(1, "a", 2.1), (2, "a", 2.9), (3, "a", None), (4, "a", 0.0), (5, "A", 2.1), (6, "a", None)], "k long, a string, x double")
    assert {r["id"]: r["kept_id"] for r in collapse.collapse(numbers, "k", ["a"], [], ["x"]).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 3}


# problem 3
GOOD = ["Früh Größe", "Тишина мост", "Océano mañana", "東京の灯", "Łąka źródło", "Plain text", "MAÇÃ NOITE", "Who? Me", "Été…"]


def test_garbled_text_is_found_and_restored(spark):
    garbled = {"Größe": ["cp1252", "mac-roman", "cp437", "cp1251"], "Тишина": ["cp1251", "cp866"], "mañana": ["cp1252", "cp437"]}
    rows = [(i, g, None) for i, g in enumerate(GOOD * 3)]
    rows += [(100, "", None), (101, None, None)]
    expected, k = {}, 200
    for word, readers in garbled.items():
        for reader in readers:
            rows.append((k, word.encode().decode(reader, "replace"), "x"))
            expected[k] = word
            k += 1
    rows.append((k, "Größe".encode().decode("cp1252").encode().decode("cp1252"), "x"))
    expected[k] = "Größe"
    rows.append((k + 1, "Тишина".encode("cp1251").decode("cp1252"), "x"))
    expected[k + 1] = "Тишина"
    lossy = {k + 2: "Gr??e", k + 3: "ma�ana", k + 4: "???? ??"}
    rows += [(i, v, "x") for i, v in lossy.items()]
    df = frame(spark, rows, "id long, title string, value string")
    found = encoding.garbled_fields(df, "id", ["title"])
    assert {r["key"] for r in found.collect()} == set(expected) | set(lossy)
    restored = {r["key"]: r["restored"] for r in encoding.restore(df, "id", ["title"], found).collect()}
    assert {i: restored[i] for i in expected if "�" not in dict((r[0], r[1]) for r in rows)[i]} == {i: w for i, w in expected.items() if "�" not in dict((r[0], r[1]) for r in rows)[i]}
    assert restored[k + 2] == "Größe" and restored[k + 3] == "mañana" and restored[k + 4] is None
    assert encoding.garbled_fields(df.where("false"), "id", ["title"]).count() == 0


# problem 4
def test_cut_values_are_found(spark):
    rng = random.Random(4)
    a, b, c = ["Silver", "Hidden", "Broken", "Velvet", "Quiet"], ["Garden", "Mountain", "Cathedral", "Umbrella", "Telegraph"], ["Orchestra", "Highway", "Pendulum", "Almanac", "Staircase"]
    title = lambda: f"The {rng.choice(a)} {rng.choice(b)} and the {rng.choice(c)} Song No. {rng.randrange(9)}"
    rows, cut = [], set()
    for i in range(3000):
        t, source = title(), "free" if i % 3 else "short"
        if source == "short" and len(t) > 34:
            t = t[:34].rstrip()
            cut.add(i)
        rows.append((i, t, source, 1.0))
    rows += [(9000, None, "free", 1.0), (9001, "", "short", 1.0)]
    df = frame(spark, rows, "id long, title string, tagger string, p double")
    got = {r["key"] for r in truncation.truncated_fields(df, "id", ["title"], "tagger").collect()}
    assert len(got & cut) / len(cut) > 0.95 and len(got - cut) < 0.02 * len(rows)
    assert truncation.truncated_fields(df.where("false"), "id", ["title"], "tagger").count() == 0


def test_limits_of_rare_and_multibyte_values():
    class Lengths:
        def __init__(self, rows):
            self.rows = rows

        def toPandas(self):
            return pd.DataFrame(self.rows, columns=["source", "field", "unit", "length", "n", "k"])

    natural = lambda source, unit, add=0: [(source, "artist", unit, k + add, 40 if k > 20 else 2000, 30) for k in range(5, 60)]
    short = [("short", "artist", "chars", k, 2000, 500) for k in range(5, 21)] + [("short", "artist", "chars", k, 3, 3) for k in range(21, 30)] + [("short", "artist", "chars", 30, 40, 30)]
    wide = [("short", "artist", "bytes", k, n, d) for _, _, _, k, n, d in short[:-1]] + [("short", "artist", "bytes", k, n, n) for k, n in ((30, 18), (31, 14), (33, 4), (36, 4))]
    got = truncation.limits(Lengths(natural("free", "chars") + natural("free", "bytes", 1) + short + wide))
    assert [(x["source"], x["unit"], x["limit"]) for x in got] == [("short", "chars", 30)]
    # a pile in both units is explained by characters if fewer values go beyond it
    many = [("short", "artist", u, k, 400 if k < 30 else n, 100) for u, top in (("chars", {30: 2000}), ("bytes", {30: 1100, 31: 860, 34: 40})) for k, n in [*((k, 0) for k in range(5, 30)), *top.items()]]
    got = truncation.limits(Lengths(natural("free", "chars") + natural("free", "bytes", 1) + many))
    assert [(x["source"], x["unit"], x["limit"]) for x in got] == [("short", "chars", 30)]


# problem 6
def test_look_alikes(spark):
    rows = [(1, "Ｗａｉｔ"), (2, "éte"), (3, "a​b"), (4, "a b"), (5, "a‑b"), (6, "Gаrden"), (7, "Garden"), (8, "Мост море"), (9, "Wait…"), (10, None), (11, ""), (12, "Gаrdеn"), (13, "xуz")]
    assert [i for i, v in rows if v and (lookalike.odd(v) or lookalike.mixed_words(lookalike.plain(v)))] == [1, 2, 3, 4, 5, 6, 12, 13]
    values = frame(spark, [(v, 1) for _, v in rows if v], "value string, n long")
    got = {r["value"]: r["c"] for r in lookalike.repaired(values).select("value", lookalike.apply_swaps(F.col("base"), F.col("swap")).alias("c")).collect()}
    assert got["Ｗａｉｔ"] == "Wait" and got["éte"] == "éte" and got["a​b"] == "ab" and got["a b"] == "a b" and got["a‑b"] == "a-b"
    assert got["Gаrden"] == "Garden" and got["Gаrdеn"] == "Garden" and got["xуz"] == "xуz"  # no such word in the corpus
    assert lookalike.repaired(values.where("false")).count() == 0


# problem 1
def test_names():
    w = names.name_words
    common = frozenset({"anton", "alexander"})
    agree = lambda a, b: names.agree(w(a), w(b), common)
    assert agree("Zarnetur, A.", "Anton Zarnetur") and agree("Becky Horvasnd", "Rebecca Horvasund")
    assert not agree("Anton Zarnetur", "Alexander Zarnetur") and not agree("B. Zarnetur", "Anton Zarnetur") and not agree("A. B. Zarnetur", "A. C. Zarnetur")
    assert names.close("abcd", "abdc") and not names.close("ab", "ac") and names.close("abcdefgh", "abxdefgy")
    assert names.average_linkage(3, {(0, 1): 0.9, (1, 2): 0.8, (0, 2): -1.0}, 0.3) == [0, 0, 2]


def test_acts(spark):
    rows = ["Anton Zarnetur", "Zarnetur, A.", "Zarnetur Anton", "Alexander Zarnetur", "The Gupozelt Brothers", "Gupozelt Bros, The", "Various Artists", "Various", "Solo", None, "", "Anton Zarnetur"]
    rng = random.Random(11)
    rows += ["".join(rng.choice("bdfgklmprst") + rng.choice("eiou") for _ in range(4)).title() + " " + "".join(rng.choice("bdfgklmprst") + rng.choice("eiou") for _ in range(3)).title() for _ in range(80)]
    df = frame(spark, [(i, n, 0) for i, n in enumerate(rows)], "k long, name string, act int")
    got = {r["id"]: r["act"] for r in names.acts(df, "k", "name").collect()}
    assert got[0] == got[1] == got[2] == got[11] == 0 and got[4] == got[5] and got[6] == got[7] and len({got[i] for i in (0, 3, 4, 6, 8, 9, 10)}) == 7
    assert names.acts(df.where("false"), "k", "name").count() == 0


def test_large_components_cluster_as_small_ones(spark, monkeypatch):
    rng = random.Random(12)
    given, family = ["anton", "bertha", "casimir", "dora", "a", "b", "c"], ["zarnetur", "zarnetor", "zarnetux"]
    words = sorted({tuple(sorted({rng.choice(family), *rng.sample(given, rng.randrange(1, 3))})) for _ in range(60)})
    described = frame(spark, [(3 * i, list(w), []) for i, w in enumerate(words)], "id long, words array<string>, c array<string>")
    pairs = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if j == i + 1 or rng.random() < 0.6]
    links = frame(spark, [(3 * i, 3 * j, rng.uniform(0.42, 1) - (0.0 if names.agree(words[i], words[j], frozenset()) else names.APART)) for i, j in pairs], "x long, y long, sim double")
    monkeypatch.setattr(names, "TILE", 7, raising=False)
    whole = {(r["id"], r["act"]) for r in names.clustered(links, described, names.LINKAGE).collect()}
    assert {(r["id"], r["act"]) for r in names.clustered(links, described, names.LINKAGE, size=2).collect()} == whole
    assert 1 < len({act for _, act in whole}) < len(whole)
    # a full clique stays one act whatever the bound
    clique = frame(spark, [(1, 2, 0.72), (1, 3, 0.72), (2, 3, 0.72)], "x long, y long, sim double")
    for size in (600, 2):
        assert {(r["id"], r["act"]) for r in names.clustered(clique, frame(spark, [(i, ["zarnetur"], []) for i in (1, 2, 3)], described.schema), names.LINKAGE, size=size).collect()} == {(1, 1), (2, 1), (3, 1)}


@pytest.mark.parametrize("tile,long", [(500, 400), (7, 4), (500, 0)])
def test_similar_pairs_lose_nothing(spark, monkeypatch, tile, long):
    monkeypatch.setattr(names, "TILE", tile)
    monkeypatch.setattr(names, "LONG", long)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(3, 9))) for _ in range(60)]
    vectors = frame(spark, [(i, names.ngrams((t,))) for i, t in enumerate(texts)], "id long, grams array<string>")
    got = {(r["x"], r["y"]) for r in names.similar_pairs(vectors, 0.5).collect()}
    df = {}
    for t in texts:
        for g in names.ngrams((t,)):
            df[g] = df.get(g, 0) + 1
    vec = [{g: np.log(61 / df[g]) + 0.1 for g in names.ngrams((t,))} for t in texts]
    norm = [np.sqrt(sum(x * x for x in v.values())) for v in vec]
    expected = {(i, j) for i in range(60) for j in range(i + 1, 60) if sum(vec[i][g] * vec[j].get(g, 0) for g in vec[i]) / norm[i] / norm[j] >= 0.5}
    assert got == expected


# problem 7
def test_releases(spark):
    schema = "id long, title string, artist string, year int, count int, extra string"
    groups = frame(spark, [(1, "Silver Garden", "The Wolves", 2000, 10, ""), (2, "silver  garden!", "Wolves, The", None, 10, ""), (3, "Silver Garden", "Alpha", 2000, 10, ""), (4, None, "Alpha", 2000, 1, ""), (5, "Silver Garden", "The Wolves", 2000, 15, "")], schema)
    albums = frame(spark, [(10, "Silver Garden", "The Wolves", 2000, 10, ""), (11, "Silver Garden (Deluxe Edition)", "The Wolves", 2000, 16, ""), (12, "Silver Garden (2015 Remaster)", "The Wolves", 2015, 10, ""), (13, "Silver Garden", "Other Band", 2000, 10, "")], schema)
    got = {(r["group_id"], r["collection_id"]) for r in releases.match_releases(groups, albums).collect()}
    assert got == {(1, 10), (2, 10), (5, 11)}
    assert releases.match_releases(groups.where("false"), albums).count() == 0


def test_blocks_beyond_the_window_are_compared(spark):
    schema = "id long, title string, artist string, year int, count int"
    local = [(i, "Greatest Hits", "Various Artists", 1930 + 3 * (i % 30) if i % 3 else None, 10 + 3 * (i // 30)) for i in range(120)]
    local += [(500 + i, f"{w} Night", "Other People", 1999, 12) for i, w in enumerate(["Qarden", *(f"Word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(40))])]
    albums = [(1000 + i, "Greatest Hits", "Various Artists", 1930 + 3 * (i % 30) + 1, 10 + 3 * (i // 30)) for i in range(120)]
    albums += [(1500, "Garden Night", "Other People", 1999, 12)]
    prepare = lambda rows, side: [(side, i, releases.title_words(t), list(names.name_words(a)), [], "", y, c) for i, t, a, y, c in rows]
    pool = frame(spark, prepare(local, 0) + prepare(albums, 1), releases.SCHEMA)
    x, y = ([dict(zip(("side", "id", "title", "artist", "others", "label", "year", "count"), r, strict=True)) for r in prepare(rows, side)] for rows, side in ((local, 0), (albums, 1)))
    for r in x + y:
        r["artist"] = tuple(r["artist"])
    brute = {(a["id"], b["id"]): releases.confidence(a, b) for a in x for b in y}
    expected = {p: s for p, s in brute.items() if s >= releases.THRESHOLD}
    longest = F.array_join(F.array_sort(F.filter("artist", lambda w: F.length(w) > 1)), " ")
    got = {(r["local"], r["album"]): r["confidence"] for r in releases.equal_pairs(pool).unionByName(releases.same_artist_pairs(pool, longest)).collect()}
    assert got == pytest.approx(expected) and (500, 1500) in got
    groups, catalog = frame(spark, [(i, t, a, 1960, c) for i, t, a, _, c in local[:1]] + local[1:90], schema), frame(spark, albums[:90], schema)
    assert releases.match_releases(groups, catalog).count() == 90


def test_copies_with_other_tags_keep_the_album_of_their_release(spark):
    schema = "id long, title string, artist string, year int, count int"
    words = "Silver Garden of Sorrows"
    groups = frame(spark, [(1, words, "The Wolves", 2000, 10), (2, words, "The Wolves", None, 10), (3, words, "The Wolves", 2000, 9), (4, "Silver Gardn of Sorrows", "The Wolves", 2000, 10), (5, words, "The Wolves", 2015, 10), (6, words, "The Wolves", 2003, 12), (7, words, "The Wolves", 2004, 12)], schema)
    albums = frame(spark, [(10, words, "The Wolves", 2000, 10), (12, words + " (2015 Remaster)", "The Wolves", 2015, 10), (13, words, "The Wolves", None, None), (14, words, "The Wolves", 2003, 12), (15, words, "The Wolves", 2004, 12)], schema)
    got = {r["group_id"]: r["collection_id"] for r in releases.match_releases(groups, albums).collect()}
    assert got == {1: 10, 2: 10, 3: 10, 4: 10, 5: 12, 6: 14, 7: 15}


def test_neighbours_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(2), i, [rng.choice("abc")], ["x"], [], "", rng.choice([None, 0, 2000, 2001, 2005]), rng.choice([None, 9, 10])) for i in range(150)]
    df = frame(spark, rows, releases.SCHEMA)
    got = {(r["local"], r["album"]) for r in releases.neighbour_pairs(df, [F.col("title")[0], F.lit("")], window=4, bucket=20).collect()}
    low = lambda v: -1 if v is None else v
    expected = set()
    for key in (lambda r: r[2][0], lambda r: ""):
        placed = sorted(rows, key=lambda r: (key(r), low(r[6]), low(r[7]), r[0], r[1]))
        for i, x in enumerate(placed):
            for y in placed[i + 1 : i + 4]:
                if x[0] != y[0] and all(not p or not q or abs(p - q) <= 1 for p, q in zip(x[6:], y[6:], strict=True)):
                    expected.add((x[1], y[1]) if x[0] == 0 else (y[1], x[1]))
    assert got == expected and len(got) > 30


def test_letters_rule_out_artists_and_lose_nothing():
    rng = random.Random(3)
    words = ["orrin", "orin", "mabel", "mabell", "o", "wolves", "wolfes", "gold", "smith", "goldsmith", "zarneturs", "zarnetur", "of", "la", "counterrevolutionary", "conterrevolutionar", "é", "goldsmit"]
    artists = sorted({" ".join(sorted(rng.choice(words) for _ in range(rng.randrange(1, 5)))) for _ in range(250)} | {"gold gold", "la", "la la", "zarnetur", "ab bc", "abcd"})
    letters = releases.Letters(artists)
    i, j = (k.ravel() for k in np.meshgrid(np.arange(len(artists)), np.arange(len(artists))))
    good = np.array([releases.artist_similarity(tuple(artists[x].split(" ")), tuple(artists[y].split(" "))) >= 0.75 for x, y in zip(i, j, strict=True)])
    may = letters.one_act(i, j)
    assert good.any() and not (good & ~may).any() and not may.all()


def test_neighbours_are_scored_where_they_meet(spark):
    rng = random.Random(9)
    words = ["silver", "silvr", "garden", "gardens", "night", "counterrevolutionary", "counterrevolutionar", "2", "ii"]
    names_ = ["orrin mabel", "mabel orin", "o mabel", "the wolves", "wolfes"]
    rows = [(i % 2, i, [rng.choice(words) for _ in range(rng.randrange(1, 4))], rng.choice(names_).split(" "), [["orrin", "mabel"]] if i % 10 == 0 else [], rng.choice(["", "deluxe"]) if i % 2 else "", rng.choice([None, 0, 2000, 2001]), rng.choice([None, 9])) for i in range(120)]
    record = lambda r: {"title": r[2], "artist": tuple(r[3]), "others": [tuple(o) for o in r[4]], "label": r[5], "year": r[6], "count": r[7]}
    keys = {"title": lambda r: " ".join(r[2]), "artist": lambda r: " ".join(r[3])}
    low = lambda v: -1 if v is None else v
    for n, window in ((120, 6), (9, 40)):  # in the second case every range has fewer rows than a window
        expected = {}
        for key in keys.values():
            placed = sorted(rows[:n], key=lambda r: (key(r), low(r[6]), low(r[7]), r[0], r[1]))
            near = [(x, y) if x[0] == 0 else (y, x) for i, x in enumerate(placed) for y in placed[i + 1 : i + window] if x[0] != y[0]]
            expected |= {(x[1], y[1]): releases.confidence(record(x), record(y)) for x, y in near}
        expected = {p: s for p, s in expected.items() if s >= 0.72}
        found = releases.neighbour_pairs(frame(spark, rows[:n], releases.SCHEMA), [F.array_join(k, " ") for k in keys], window, bucket=7, least=0.72)
        assert {(r["local"], r["album"]): r["confidence"] for r in found.collect()} == expected and expected


def test_letters_rule_out_titles_and_lose_nothing(spark):
    rng = random.Random(8)
    words = ["silver", "silvr", "sliver", "garden", "gardens", "night", "nihgt", "counterrevolutionary", "conterrevolutionar", "of", "2", "ii", "x", "blackbird", "black", "bird"]
    titles = [[rng.choice(words) for _ in range(rng.randrange(1, 6))] for _ in range(300)] + [["counterrevolutionary", "night"], ["counterrevolutionary", "ni"], ["counterrevolutionary", "night", "2"], ["silver" * 50]]
    letters = releases.Letters([" ".join(t) for t in titles])
    i, j = (k.ravel() for k in np.meshgrid(np.arange(len(titles)), np.arange(len(titles))))
    alike = letters.alike(i, j)
    good = np.array([releases.title_similarity(titles[x], titles[y]) >= 0.7 for x, y in zip(i, j, strict=True)])
    assert good.any() and not (good & ~alike).any() and alike.sum() < len(alike) / 2
    rows = [(n % 2, n, t, ["x"], [], "", None, None) for n, t in enumerate(titles)]
    df = frame(spark, rows, releases.SCHEMA)
    every = {tuple(r) for r in releases.neighbour_pairs(df, [F.lit("")], window=40).collect()}
    fewer = {tuple(r) for r in releases.neighbour_pairs(df, [F.lit("")], window=40, titles=True).collect()}
    assert fewer == {p for p in every if letters.alike(np.array([p[0]]), np.array([p[1]]))[0]} and len(fewer) < len(every)


def test_assignment_takes_ids_of_any_size(spark):
    most = (1 << 63) - 1
    for far in (most, -most, 5):
        rows = [(far, 1, 0.9), (far, 2, 0.8), (3, 1, 0.85), (-4, -4, 0.8)]
        got = releases.assign(frame(spark, rows, "local long, album long, confidence double")).collect()
        assert sorted((r["local"], r["album"]) for r in got) == sorted([(far, 2), (3, 1), (-4, -4)])


def test_scored_pairs_lose_nothing(spark):
    rng = random.Random(6)
    words = ["silver", "silvr", "garden", "gardens", "night", "blackbird", "black", "bird", "counterrevolutionary", "counterrevolutionar", "2", "ii"]
    names_ = ["orrin mabel", "mabel orin", "o mabel", "zarneturs", "zarnetur", "the wolves", "wolfes", "gold smith", "goldsmith"]
    rows = [(i % 2, i, [rng.choice(words) for _ in range(rng.randrange(1, 4))], rng.choice(names_).split(" "), [["orrin", "mabel"]] if i % 10 == 0 else [], "", None, 9) for i in range(160)]
    df = frame(spark, rows, releases.SCHEMA)
    ids = [frame(spark, [(r[1],) for r in rows if r[0] == side], f"{name} long") for side, name in ((0, "local"), (1, "album"))]
    got = {(r["local"], r["album"]): r["confidence"] for r in releases.scored_pairs(ids[0].crossJoin(ids[1]), df, 0.72).collect()}
    record = lambda r: {"title": r[2], "artist": tuple(r[3]), "others": [tuple(o) for o in r[4]], "label": r[5], "year": r[6], "count": r[7]}
    every = {(x[1], y[1]): releases.confidence(record(x), record(y)) for x in rows if x[0] == 0 for y in rows if y[0] == 1}
    assert got == pytest.approx({k: v for k, v in every.items() if v >= 0.72}) and len(got) > 50


def test_a_loser_keeps_no_album_of_another_release(spark):
    schema = "id long, title string, artist string, year int, count int"
    words = "Silver Garden of Many Sorrows"
    groups = frame(spark, [(1, words, "The Wolves", 2000, 10), (2, "Acoustic " + words, "The Wolves", 2000, 10), (3, words[:-4], "The Wolves", 2000, 10)], schema)
    albums = frame(spark, [(10, words, "The Wolves", 2000, 10)], schema)
    assert {(r["group_id"], r["collection_id"]) for r in releases.match_releases(groups, albums).collect()} == {(1, 10), (3, 10)}


def test_components_of_any_size_are_assigned_exactly(spark):
    # a chain in which each best pair taken first costs two others, longer than the 2,000 records that were assigned exactly before
    n = 1100
    rows = [(i, i, 0.8) for i in range(n)] + [(i, i + 1, 0.9 if i % 2 == 0 else 0.1) for i in range(n - 1)]
    got = releases.assign(spark.createDataFrame(rows, "local long, album long, confidence double")).collect()
    assert sum(r["confidence"] for r in got) == pytest.approx(0.8 * n) and len({r["album"] for r in got}) == len({r["local"] for r in got}) == n
    rng = np.random.default_rng(4)
    for _ in range(60):
        score = np.round(rng.random((rng.integers(2, 7), rng.integers(2, 7))) * (rng.random() < 0.9), 1)
        pairs = [(i, j, float(score[i, j])) for i, j in zip(*np.nonzero(score), strict=True)]
        best = sum(score[i, j] for i, j in releases.best_assignment(score))
        found = releases.best_pairs(pairs)
        assert sum(s for _, _, s in found) == pytest.approx(best) and len({a for a, _, _ in found}) == len({b for _, b, _ in found}) == len(found)


def test_best_assignment_is_optimal():
    import itertools

    rng = np.random.default_rng(0)
    for _ in range(20):
        score = rng.random((4, 5)) * (rng.random((4, 5)) > 0.3)
        best = max(sum(score[i, p[i]] for i in range(4)) for p in itertools.permutations(range(5), 4))
        assert sum(score[i, j] for i, j in releases.best_assignment(score)) == pytest.approx(best)


# problem 8
def test_packing(spark):
    rng = random.Random(8)
    sizes = [(i, rng.choice([0, 1, 5, 30, 64, 65, 200, None])) for i in range(400)]
    out = packing.pack(frame(spark, sizes, "id long, tokens long"), capacity=64, block=100)
    rows = out.collect()
    fill = {}
    for r in rows:
        fill[r["container"]] = fill.get(r["container"], 0) + r["token_end"] - r["token_start"]
    assert max(fill.values()) <= 64
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["id"], []).append((r["token_start"], r["token_end"]))
    for i, n in sizes:
        parts = sorted(by_doc[i])
        assert parts[-1][1] == (n or 0) and len(parts) == max(1, -(-(n or 0) // 64)) and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    assert packing.pack(frame(spark, [], "id long, tokens long")).count() == 0
    whole = packing.pack_sizes(np.array([3, 7] * 10), 10)
    assert len(set(whole.tolist())) == 10


def test_token_counts(spark):
    got = {r["id"]: r["tokens"] for r in packing.token_counts(frame(spark, [(1, "hello world"), (2, ""), (3, None)], "i long, text string"), "i", "text").collect()}
    assert got == {1: 2, 2: 0, 3: 0}


# problem 9
def test_leaks(spark):
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(40)] for _ in range(30)]
    noise = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs, expected = [], set()
    for k, item in enumerate(items):
        piece = item[5:30]
        edited = [w for i, w in enumerate(piece) if i != 8]
        edited[15] = "changed"
        docs += [(4 * k, " ".join(noise(30) + piece + noise(20)).upper()), (4 * k + 1, ", ".join(noise(10) + edited)), (4 * k + 2, " ".join(noise(20) + item[:15] + noise(20)))]
        expected |= {(4 * k, k), (4 * k + 1, k)}
        docs.append((4 * k + 3, " ".join("changed" if i % 5 == 4 else w for i, w in enumerate(item))))
    docs += [(1000, None), (1001, ""), (1002, "Read the passage. " * 5)]
    texts = [(k, f"Which is right? {' '.join(i)} Answer: B", 1) for k, i in enumerate(items)] + [(99, None, 1), (98, "short", 1)]
    got = leaks.leaked(frame(spark, docs, "d long, text string"), "d", "text", frame(spark, texts, "i long, text string, id int"), "i", "text")
    assert {(r["id"], r["item"]) for r in got.collect()} == expected
    assert leaks.leaked(frame(spark, docs, "d long, text string"), "d", "text", frame(spark, [], "i long, text string"), "i", "text").count() == 0


def test_myers_against_dynamic_programming():
    rng = random.Random(5)
    for _ in range(200):
        p, t = [rng.randrange(4) for _ in range(rng.randrange(1, 9))], [rng.randrange(4) for _ in range(rng.randrange(0, 15))]
        row = list(range(len(p) + 1))
        best = []
        for c in t:
            new = [0]
            for i, x in enumerate(p, 1):
                new.append(min(new[i - 1] + 1, row[i] + 1, row[i - 1] + (x != c)))
            row = new
            best.append(row[-1])
        assert leaks.myers(p, t)[1] == best


# problem 10
def brute_spans(texts, length):
    where = {}
    for i, t in texts:
        for k in range(len(t or "") - length + 1):
            where.setdefault(t[k : k + length], set()).add(i)
    out = set()
    for i, t in texts:
        at = None
        for k in range(len(t or "") - length + 1):
            if len(where[t[k : k + length]]) > 1:
                if at and k <= at[1]:
                    at[1] = k + length
                else:
                    if at:
                        out.add((i, *at))
                    at = [k, k + length]
        if at:
            out.add((i, *at))
    return out


@pytest.mark.parametrize("bucket", [1000, 1])
def test_spans_against_brute_force(spark, bucket):
    rng = random.Random(10)
    letters = lambda n: "".join(rng.choice("abé東") for _ in range(n))
    common = [letters(50) for _ in range(4)]
    texts = [(i, letters(rng.randrange(0, 80)) + (rng.choice(common)[rng.randrange(10) :] if i % 2 else "") + letters(rng.randrange(0, 40))) for i in range(60)]
    texts += [(100, texts[3][1] + "x"), (101, texts[5][1]), (102, texts[5][1]), (103, ""), (104, None), (105, common[0] + "-" + common[0]), (106, "short")]
    df = frame(spark, [(i, t, "k") for i, t in texts], "d long, text string, id string")
    got = {(r["id"], r["span_start"], r["span_end"]) for r in spans.shared_spans(df, "d", "text", length=20, piece=8, bucket=bucket).collect()}
    assert got == brute_spans(texts, 20)
    assert spans.shared_spans(df.where("false"), "d", "text").count() == 0


def test_packed_words_and_hashes():
    points, offsets = packed.code_points(["ab cd", "", "é1-x"])
    starts, ends = packed.words(points, offsets)
    assert [("ab cdé1-x")[a:b] for a, b in zip(starts, ends, strict=True)] == ["ab", "cd", "é1", "x"]
    sums = packed.prefix_sums(packed.code_points(["xabyab"])[0])
    h = packed.window_hashes(sums, 2)
    assert h[1] == packed.run_hashes(sums, np.array([4]), np.array([6]))[0] and len(set(h[:4].tolist())) == 4

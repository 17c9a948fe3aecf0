"""Problem 7: matching releases of two sources that share no key.

Method: sorted neighbourhood over several composite sort keys. Both sources are sorted together by each
key; records within a sliding window of each other, and all records of a block of equal keys that the window
doesn't hold, are compared by weighted similarities of album, artist, year and track count; pairs above a threshold are assigned one to one so that the total confidence is
greatest. Copies of a local release (equal or nearly equal tags) stand for one another and get the album
of their class.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.lookalike import plain
from tagloom.llm.names import ROMAN, agree, close, name_words
from tagloom.operators.components import components
from tagloom.operators.split_values import soft, tokenize
from tagloom.operators.streamed import grouped_rows
from tagloom.session import cut, shuffle_width

#: Records within so many places of each other in a sort order are compared.
WINDOW = 15
#: Records per step of the window scan.
BUCKET = 10_000
#: Rows of each side per task where a block is compared as a whole, and shares of a block of equal titles and artists.
TILE, SALT = 500, 8
#: Least confidence of a match.
THRESHOLD = 0.72
#: A title that another one goes on from counts as cut off only if it has so many characters; shorter ones are other titles.
CUT = 20
#: Similarities of title and artist from which two local releases are copies: before the assignment, and for damaged ones after it.
ALIKE, DAMAGED = (0.95, 0.95), (0.85, 0.75)
# Weights of the field similarities.
ALBUM, ARTIST, YEAR, COUNT = 0.45, 0.33, 0.10, 0.12

# Labels that name an edition; the first alternatives stand in brackets, the last two after a dash.
LABEL = re.compile(
    r"\s*[(\[](?:super\s+|special\s+|limited\s+)?(?:deluxe|expanded|bonus track|international|explicit|clean|anniversary|collector'?s|special|limited|\d*\s*remaster(?:ed)?(?:\s+\d{4})?|\d{1,3}(?:st|nd|rd|th) anniversary)(?:\s+(?:edition|version))?[)\]]\s*$|\s+-\s+(?:ep|single)\s*$",
    re.I,
)


def base_title(title: str) -> tuple[str, str]:
    """The title without its edition labels, and the labels in lower case."""
    labels = []
    while m := LABEL.search(title):
        labels.append(re.sub(r"[^\w ]", "", m.group()).strip().lower())
        title = title[: m.start()]
    return title, " ".join(labels)


def title_words(title: str) -> list[str]:
    """Words of a title in order: plain forms, no accents, lower case."""
    if title.isascii() and title.isprintable():  # is its own plain form
        text = title.lower()
    else:
        text = unicodedata.normalize("NFKD", plain(title)).lower()
        text = "".join(ROMAN.get(c, c) for c in text if not unicodedata.combining(c) or c > "ऀ")
    return ["vol" if w == "volume" else w for w in re.findall(r"[^\W_]+", text.replace("'", "").replace("’", ""))]


variant = lru_cache(maxsize=1 << 16)(close)  # neighbours in a sort order have the same words again and again


@lru_cache(maxsize=1 << 16)
def is_number(word: str) -> bool:
    return word.isdigit() or re.fullmatch("[ivx]+", word) is not None


def title_similarity(a: list[str], b: list[str]) -> float:
    """1 for the same words in any order; less for typing variants, lost letters and a broken-off end; 0 for other numbers."""
    if not a or not b:
        return 0.0
    left, right, same, near = list(a), list(b), 0, 0
    for w in a:
        if w in right:
            left.remove(w)
            right.remove(w)
            same += len(w)
    if not left and not right:
        return 1.0
    short, long = " ".join(a), " ".join(b)
    if len(short) > len(long):
        short, long = long, short
    if len(short) >= CUT and long.startswith(short):
        return 0.9
    if any(map(is_number, left)) or any(map(is_number, right)):  # no word is on both sides any more
        return 0.0
    for w in list(left):
        for v in right:
            if abs(len(w) - len(v)) < 3 and variant(w, v):
                left.remove(w)
                right.remove(v)
                near += len(w)
                break
    if not left and not right:
        return 0.95
    if "".join(a) == "".join(b):
        return 0.95
    # words of a value cut short: everything but the last word agrees and that one is a beginning
    if len(left) == 1 and len(right) >= 1 and left[0] == a[-1] and right[0].startswith(left[0]) and len(short) >= CUT:
        return 0.85
    rest = sum(map(len, left + right))
    return max(0.0, min(0.8, (same + 0.9 * near) / (same + near + rest / 2) - 0.1)) if same + near else 0.0


def artist_similarity(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if agree(a, b, frozenset()):
        return 0.95
    short, long = sorted((" ".join(a), " ".join(b)), key=len)
    if len(short) >= 8 and long.startswith(short):
        return 0.8
    shared = [w for w in a if any(w == v or (len(w) > 3 and variant(w, v)) for v in b)]
    union = len(set(a) | set(b))
    return 0.5 * len(shared) / union


def confidence(x: dict, y: dict) -> float:
    """How sure a local release `x` and an album `y` are the same; 0 where years or counts rule it out."""
    year = abs(x["year"] - y["year"]) if x["year"] and y["year"] else None
    count = abs(x["count"] - y["count"]) if x["count"] and y["count"] else None
    if (year is not None and year > 1) or (count is not None and count > 1):
        return 0.0
    s = ALBUM * title_similarity(x["title"], y["title"])
    if s < ALBUM * 0.7:
        return 0.0
    artist = max([artist_similarity(x["artist"], y["artist"]), *(0.97 * artist_similarity(z, y["artist"]) for z in x["others"])])
    if artist < 0.75:
        return 0.0
    s += ARTIST * artist
    s += YEAR * (0.5 if year is None else 1.0 if year == 0 else 0.6)
    s += COUNT * (0.5 if count is None else 1.0 if count == 0 else 0.6)
    # of two editions, the one without a label the local tags lack
    return s - 0.01 * bool(y["label"])


SCHEMA = "side int, id long, title array<string>, artist array<string>, others array<array<string>>, label string, year int, count int"


def leading_acts(artist: str) -> list[str]:
    """Beginnings of a credit that may name its main act: the first value, and the first two joined by a soft delimiter."""
    pieces = tokenize(artist)
    if len(pieces) < 2:
        return []
    first = [artist[pieces[0].start : pieces[0].end]]
    if soft(pieces[1].before) and len(pieces) > 2:
        first.append(artist[pieces[0].start : pieces[1].end])
    return first


@lru_cache(maxsize=1 << 16)
def _acts(artist: str) -> tuple[str, str, str, str]:
    """Words of a credit, those of each of its leading acts, its words of more than a letter in order, and its longest word."""
    artist = plain(artist)
    words = name_words(artist)
    others = "|".join(" ".join(w) for o in leading_acts(artist) if (w := name_words(o)))
    return " ".join(words), others, " ".join(sorted(w for w in words if len(w) > 1)), min(words, key=lambda w: (-len(w), w), default="")


@lru_cache(maxsize=1 << 16)
def _named(title: str) -> tuple[str, str, str]:
    """Words of a title without its edition labels, in their order and sorted, and the labels."""
    base, label = base_title(title)
    words = title_words(base)
    return " ".join(words), " ".join(sorted(words)), label


PREPARED = "side int, id long, title string, artist string, others string, label string, year int, count int, sorted string, longest string, rare string"


def _prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    nothing = ("", "", "", "")
    for pdf in batches:
        title, in_order, label = zip(*(_named(t or "") for t in pdf["title"]), strict=True) if len(pdf) else ((), (), ())
        artist, others, longest, rare = zip(*(_acts(a) if a else nothing for a in pdf["artist"]), strict=True) if len(pdf) else ((), (), (), ())
        others = ["" if s else o for s, o in zip(pdf["side"], others, strict=True)]
        columns = {"title": title, "artist": artist, "others": others, "label": label, "year": pdf["year"], "count": pdf["count"], "sorted": in_order, "longest": longest, "rare": rare}
        out = pd.DataFrame({"side": pdf["side"], "id": pdf["id"]} | columns)
        yield out[(out["title"] != "") & (out["artist"] != "")]


def _as_text(rows: DataFrame) -> DataFrame:
    """`rows` with words as text, which takes a third of the room."""
    joined = lambda c: F.array_join(c, " ")
    forms = {"title": joined("title"), "artist": joined("artist"), "others": F.array_join(F.transform("others", joined), "|")}
    return rows.withColumns({c: forms[c] for c, kind in rows.dtypes if c in forms and kind.startswith("array")})


#: What a title with a number has, and a few others.
NUMBER = re.compile(r"\d|[^\x00-\x7F]|(?<![^ ])[ivx]+(?![^ ])")


class Letters:
    """What bounds similarities of titles and artists from above: letters of each of 32 kinds, all letters, words of one letter, of two, three and eight and more, numbers."""

    def __init__(self, titles: list[str]):
        code = {t: n for n, t in enumerate(dict.fromkeys(titles))}
        self.texts = list(code)
        self.code = np.array([code[t] for t in titles], int)
        chars = np.frombuffer("".join(f"{t} " for t in code).encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = chars == 32
        of = np.repeat(np.arange(len(code)), [len(t) + 1 for t in code])
        per_title = lambda of, width=1: np.bincount(of, minlength=len(code) * width).astype(np.int32)
        self.size = per_title(of[~blank])
        self.kinds = per_title(of[~blank] * 32 + (chars[~blank] & 31), 32).reshape(-1, 32).astype(np.int16)
        ends = np.flatnonzero(blank)
        length = np.diff(ends, prepend=-1) - 1
        self.single, self.parts, self.words, self.long = (per_title(of[ends[k]]) for k in (length == 1, length >= 2, length >= 3, length >= 8))
        numbers: dict[tuple, int] = {(): 0}
        self.numbers = np.array([numbers.setdefault(tuple(sorted(filter(is_number, t.split(" ")))), len(numbers)) if NUMBER.search(t) else 0 for t in code], int)

    def alike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether titles may have a similarity of 0.7; without this they have less.

        A typing variant of a word changes two letters of six, or four of fourteen from eight letters on. Other words hold at
        most a fifth of all letters, and less by what the variants take of it, unless one title is the beginning of the other,
        of which half the characters are letters; only then can numbers differ.
        """
        i, j, x, y, apart, typing = self._apart(i, j)
        begins, more = np.minimum(x, y) >= CUT // 2, apart - np.abs(x - y)
        agree = (apart <= 0.2 * (x + y) + 0.8 * typing + 1e-6) | (begins & (more <= typing))
        return agree & (self.numbers[i] == self.numbers[j]) | begins & (more <= 0)

    def one_act(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether artists may have a similarity of 0.75; without this they have less.

        All words are paired off but for typing, unless there are initials, repeated words or words written together
        (of as many letters, not always the same), or one artist is the beginning of the other.
        """
        special = (self.single > 0) | np.array([len(set(w := t.split(" "))) < len(w) for t in self.texts], bool)
        i, j, x, y, apart, typing = self._apart(i, j)
        begins = (np.minimum(x, y) >= 4) & (apart <= np.abs(x - y))
        p, q = self.parts[i], self.parts[j]
        together = (p != q) & (np.abs(x - y) <= typing) | (np.minimum(p, q) >= 3)
        return (i == j) | special[i] | special[j] | (apart <= typing) | begins | together

    def _apart(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        """Codes, letters, letters that differ, and how many typing variants may change."""
        i, j = self.code[i], self.code[j]
        pairs = np.minimum(self.words[i], self.words[j])
        typing = 2 * pairs + 2 * np.minimum(pairs, self.long[i] + self.long[j])
        return i, j, self.size[i], self.size[j], np.abs(self.kinds[i] - self.kinds[j]).sum(1, dtype=np.int32), typing


def _close_places(pdf: pd.DataFrame, window: int, letters: Letters | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (local, album) of the rows less than `window` places apart whose years and counts fit, and whose titles may, if `letters` are given.

    `pdf` is in order; rows with the same number of 0 or more in `seen` were compared before.
    """
    side, turn, place, seen = (pdf[c].to_numpy() for c in ("side", "turn", "place", "seen"))
    numbers = [np.nan_to_num(pdf[c].to_numpy(float)) for c in ("year", "count")]
    found = [np.zeros((2, 0), int)]
    for step in range(1, window):
        good = (side[:-step] != side[step:]) & (turn[:-step] == turn[step:]) & (place[step:] - place[:-step] < window)
        good &= (seen[step:] < 0) | (seen[:-step] != seen[step:])
        for v in numbers:
            good &= (v[:-step] == 0) | (v[step:] == 0) | (np.abs(v[:-step] - v[step:]) <= 1)
        i = np.flatnonzero(good)
        i = i[letters.alike(i, i + step)] if letters else i
        first = side[i] == 0
        found.append(np.stack([np.where(first, i, i + step), np.where(first, i + step, i)]))
    x, y = np.concatenate(found, axis=1)
    return x, y


def _neighbours(window: int, titles: bool = False, least: float | None = None):
    """Rows in order -> (local, album) of neighbours, or those of at least the confidence `least` with it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        letters = Letters(pdf["title"].tolist()) if titles or least is not None else None
        x, y = _close_places(pdf, window, letters)
        ids = pdf["id"].to_numpy()
        if least is None:
            x, y = np.unique(np.stack([ids[x], ids[y]]), axis=1)
            return pd.DataFrame({"local": x, "album": y}).astype("int64")
        x, y, s = confidences(pdf, x, y, letters, least)
        return pd.DataFrame({"local": ids[x], "album": ids[y], "confidence": s})

    return run


@lru_cache(maxsize=1 << 17)
def _title_similarity(a: str, b: str) -> float:
    return 1.0 if a == b else title_similarity(a.split(" "), b.split(" "))


@lru_cache(maxsize=1 << 17)
def _credit_similarity(a: str, others: str, b: str) -> float:
    """Of the readings of a local credit, the similarity of the one nearest to the artist `b`."""
    b = tuple(b.split(" "))
    return max([artist_similarity(tuple(a.split(" ")), b), *(0.97 * artist_similarity(tuple(z.split(" ")), b) for z in others.split("|") if z)])


def confidences(pdf: pd.DataFrame, x: np.ndarray, y: np.ndarray, letters: Letters, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (x, y) of rows of `pdf` that reach `least`, with what `confidence` gives them; equal pairs of texts are compared once."""

    def per_pair(p: np.ndarray, q: np.ndarray, similarity) -> np.ndarray:
        """`similarity` of the codes p, q."""
        n = int(max(p.max(initial=0), q.max(initial=0))) + 1
        pairs, back = np.unique(p * n + q, return_inverse=True)
        return np.array([similarity(a, b) for a, b in zip((pairs // n).tolist(), (pairs % n).tolist(), strict=True)], float)[back]

    keep = (pdf["others"].to_numpy() != "")[x] | Letters(pdf["artist"].tolist()).one_act(x, y)
    x, y, text = x[keep], y[keep], letters.texts
    title = per_pair(letters.code[x], letters.code[y], lambda a, b: _title_similarity(text[a], text[b]))
    keep = ALBUM * title >= ALBUM * 0.7
    x, y, title = x[keep], y[keep], title[keep]
    code, credit = pd.factorize(pd.Series(list(zip(pdf["artist"], pdf["others"], strict=True)), dtype=object))
    artist = per_pair(code[x], code[y], lambda a, b: _credit_similarity(*credit[a], credit[b][0]))
    keep = artist >= 0.75
    x, y, title, artist = x[keep], y[keep], title[keep], artist[keep]

    def part(name: str) -> np.ndarray:
        v = np.nan_to_num(pdf[name].to_numpy(float))
        return np.where((v[x] == 0) | (v[y] == 0), 0.5, np.where(v[x] == v[y], 1.0, 0.6))

    s = ALBUM * title
    s += ARTIST * artist
    s += YEAR * part("year")
    s += COUNT * part("count")
    s -= 0.01 * (pdf["label"].to_numpy() != "")[y]
    keep = s >= least
    return x[keep], y[keep], s[keep]


def _sweep(window: int, bucket: int, compare):
    """Sorted batches of one range of the order -> results of `compare`, and the first and last rows of the range in one row (`part`, `n`, `seam`)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, head, tail = 0, [], None
        for batch in batches:
            for a in range(0, len(batch), bucket):
                new = batch.iloc[a : a + bucket]
                new = new.assign(place=np.arange(n, n + len(new)), seen=-1)
                if n < window:
                    head.append(new.iloc[: window - n])
                n += len(new)
                rows = new if tail is None else pd.concat([tail, new], ignore_index=True)
                yield compare(rows)
                tail = rows.iloc[-window:].assign(seen=0)
        if n:
            first = pd.concat(head, ignore_index=True)
            seam = pd.concat([first, tail[tail["place"] >= len(first)]], ignore_index=True)
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "n": [n], "seam": [pickle.dumps(seam)]})

    return run


def _seams(compare):
    """The first and last rows of all ranges -> results of `compare` for pairs of two ranges; a few rows per range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offset, parts = 0, []
        for part, n, seam in sorted((r for pdf in batches for r in zip(pdf["part"], pdf["n"], pdf["seam"], strict=True)), key=lambda r: r[0]):
            rows = pickle.loads(seam)
            parts.append(rows.assign(place=rows["place"] + offset, seen=int(part)))
            offset += int(n)
        if len(parts) > 1:
            yield compare(pd.concat(parts, ignore_index=True))

    return run


def neighbour_pairs(rows: DataFrame, keys: list[Column], window: int = WINDOW, bucket: int = BUCKET, titles: bool = False, least: float | None = None) -> DataFrame:
    """(local, album), once each: the records within `window` places of each other in some sort order whose years and counts fit.

    All orders are sorted as one table by ranges, never in one task; each range streams through in vectorised steps of
    `bucket` rows, and the rows at its ends are compared with those of its neighbours afterwards. With `titles` pairs are
    left out whose titles can't be similar enough for a match; with `least` the pairs of
    at least this confidence are given, with it, as often as orders have them.
    """
    rows = _as_text(rows.withColumn("keys", F.array(*(F.concat_ws("", F.lit(chr(65 + n)), k) for n, k in enumerate(keys)))))
    texts = [] if least is None and not titles else ["title"] if least is None else ["title", "artist", "others", "label"]
    slim = rows.select("side", "id", "year", "count", *texts, F.explode("keys").alias("k"))
    order = ("k", "year", "count", "side", "id")  # equal keys mix both sides, close years and counts together
    spread = slim.repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("turn", F.ascii("k")).drop("k")
    result = ["local", "album"] if least is None else ["local", "album", "confidence"]
    schema = "local long, album long" + ", confidence double" * (least is not None)
    compare = _neighbours(window, titles, least)
    columns, sweep = [*result, "part", "n", "seam"], _sweep(window, bucket, compare)
    whole = lambda batches: (pdf.assign(**{c: None for c in columns if c not in pdf})[columns] for pdf in sweep(batches))
    swept = cut(spread.mapInPandas(whole, schema + ", part int, n long, seam binary"))
    across = swept.where("seam IS NOT NULL").select("part", "n", "seam").repartition(1).mapInPandas(_seams(compare), schema)
    found = swept.where("seam IS NULL").select(*result).unionByName(across)
    return found if least is not None else found.distinct()


def scored_pairs(pairs: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """(local, album, confidence) of the pairs (local, album) that reach `least`; each is scored once."""
    own = _as_text(rows).select("side", "id", "title", "artist", "others", "label", "year", "count")
    x = own.where("side = 0").drop("side", "label").toDF("local", *(f"x_{c}" for c in ("title", "artist", "others", "year", "count")))
    y = own.where("side = 1").drop("side", "others").toDF("album", *(f"y_{c}" for c in ("title", "artist", "label", "year", "count")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = np.array([confidence(a, b) for a, b in zip(_records(pdf, "x_"), _records(pdf, "y_"), strict=True)], float)
            yield pdf[["local", "album"]].assign(confidence=s)[s >= least]

    return pairs.join(x, "local").join(y, "album").where(_possible()).mapInPandas(run, "local long, album long, confidence double")


def _possible() -> Column:
    """What every pair of enough confidence fulfils, on the columns of `scored_pairs`; cheap, so that most pairs end here.

    Titles share a word, or their words are typing variants of each other and the lengths so near, or one may be the
    beginning of the other. The same holds for artists, unless there are initials or several readings of a credit.
    """
    words = lambda c: F.split(c, " ")
    letters = lambda c: F.length(F.replace(F.col(c), F.lit(" "), F.lit("")))
    gap = lambda f: F.abs(letters(f"x_{f}") - letters(f"y_{f}"))
    few = lambda f, pick: pick(F.size(words(f"x_{f}")), F.size(words(f"y_{f}")))
    long = F.greatest(letters("x_title"), letters("y_title"))
    title = F.arrays_overlap(words("x_title"), words("y_title")) | (gap("title") <= 0.25 * long + 2 * few("title", F.greatest)) | ((few("title", F.least) == 1) & (F.least(letters("x_title"), letters("y_title")) >= CUT - 3))
    initials = F.concat_ws(" ", "x_artist", "y_artist").rlike(r"(^| )\S( |$)")
    start = F.substring("x_artist", 1, 4) == F.substring("y_artist", 1, 4)
    artist = (F.col("x_others") != "") | initials | start | F.arrays_overlap(words("x_artist"), words("y_artist")) | (gap("artist") <= 2 * few("artist", F.greatest))
    return title & artist


def _records(pdf: pd.DataFrame, prefix: str) -> Iterator[dict]:
    """The rows of a batch as `confidence` takes them, from text columns."""
    nothing = [""] * len(pdf)
    number = lambda name: np.nan_to_num(pdf[prefix + name].to_numpy(float)).astype(int).tolist()
    others = pdf[prefix + "others"].tolist() if prefix + "others" in pdf else nothing
    label = pdf[prefix + "label"].tolist() if prefix + "label" in pdf else nothing
    for t, a, o, l, y, c in zip(pdf[prefix + "title"].tolist(), pdf[prefix + "artist"].tolist(), others, label, number("year"), number("count"), strict=True):
        yield {"title": t.split(" "), "artist": tuple(a.split(" ")), "others": [tuple(z.split(" ")) for z in o.split("|")] if o else [], "label": l, "year": y, "count": c}


#: Columns of the records that are compared.
PAIRED = ("side", "id", "title", "artist", "others", "label", "year", "count")


def _over(rows: DataFrame, block: list[str], window: int) -> DataFrame:
    """`rows` of the blocks with both sides and more rows than a window holds; smaller blocks are compared in their sort order."""
    sizes = rows.groupBy(*block).agg(F.count("*").alias("m"), F.min("side").alias("low"), F.max("side").alias("high")).where((F.col("m") > window) & (F.col("low") < F.col("high")))
    return rows.join(sizes.select(*block, "m"), block)


def _near(side: int, name: str) -> Column:
    """Values of a field under which the two sides meet exactly once if they differ by one at most or one is null."""
    x, null, anything = F.nullif(F.col(name), F.lit(0)), F.lit("null"), F.lit("any")
    if side == 0:
        return F.when(x.isNull(), F.array(anything)).otherwise(F.array((x - 1).cast("string"), x.cast("string"), (x + 1).cast("string"), null))
    return F.when(x.isNull(), F.array(null, anything)).otherwise(F.array(x.cast("string"), anything))


def equal_pairs(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(local, album, confidence) of all pairs with equal titles and artists and fitting years and counts, in blocks beyond the window.

    One join on title, artist, year and count; the albums of a key are salted. Confidences are those of `confidence`.
    """
    in_order = F.col("sorted") if "sorted" in rows.columns else F.array_join(F.array_sort("title"), " ")
    named = _as_text(rows.withColumn("t", in_order)).select("side", "id", "year", "count", "label", "t", F.col("artist").alias("a"))
    block = cut(_over(named, ["t", "a"], window))

    def spread(side: int, salt: Column) -> DataFrame:
        own = block.where(F.col("side") == side).withColumn("yk", F.explode(_near(side, "year"))).withColumn("ck", F.explode(_near(side, "count")))
        return own.withColumn("salt", salt)

    x = spread(0, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).alias("x")
    y = spread(1, F.pmod("id", F.lit(SALT)).cast("int")).alias("y")
    met = x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("t", "a", "yk", "ck", "salt")])

    def part(name: str) -> Column:
        a, b = F.nullif(F.col(f"x.{name}"), F.lit(0)), F.nullif(F.col(f"y.{name}"), F.lit(0))
        return F.when(a.isNull() | b.isNull(), 0.5).when(a == b, 1.0).otherwise(0.6)

    s = F.lit(ALBUM + ARTIST) + F.lit(YEAR) * part("year") + F.lit(COUNT) * part("count") - F.when(F.col("y.label") != "", 0.01).otherwise(0.0)
    return met.select(F.col("x.id").alias("local"), F.col("y.id").alias("album"), s.alias("confidence"))


def _compare_all(least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        letters, ids = Letters(pdf["title"].tolist()), pdf["id"].to_numpy()
        x, y = (np.flatnonzero(pdf["side"].to_numpy() == side) for side in (0, 1))
        x, y = np.repeat(x, len(y)), np.tile(y, len(x))
        alike = letters.alike(x, y)
        x, y, s = confidences(pdf, x[alike], y[alike], letters, least)
        return pd.DataFrame({"local": ids[x], "album": ids[y], "confidence": s})

    return run


def same_artist_pairs(rows: DataFrame, longest: Column, window: int = WINDOW, least: float = THRESHOLD) -> DataFrame:
    """(local, album, confidence) of the pairs with one artist, year and count, in blocks beyond the window: every
    tile of local rows meets every tile of albums, each pair of tiles in a group of its own."""
    named = rows.withColumn("b", F.concat_ws("|", longest, F.coalesce("year", F.lit(0)), F.coalesce("count", F.lit(0))))
    block = _over(_as_text(named).select(*PAIRED, "b"), ["b"], window)
    place = F.row_number().over(Window.partitionBy("b", "side").orderBy("id")) - 1
    tiled = cut(block.withColumn("tile", F.floor(place / TILE)))
    tiles = tiled.groupBy("b").agg(F.max(F.when(F.col("side") == 0, F.col("tile"))).alias("tx"), F.max(F.when(F.col("side") == 1, F.col("tile"))).alias("ty"))
    both = tiled.join(tiles, "b")
    x = both.where("side = 0").withColumn("ti", F.col("tile")).withColumn("tj", F.explode(F.sequence(F.lit(0), F.col("ty"))))
    y = both.where("side = 1").withColumn("tj", F.col("tile")).withColumn("ti", F.explode(F.sequence(F.lit(0), F.col("tx"))))
    return x.unionByName(y).groupBy("b", "ti", "tj").applyInPandas(_compare_all(least), "local long, album long, confidence double")


def best_assignment(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the greatest total of a matrix of non-negative scores (Hungarian method); zeros are no pairs."""
    n, m = score.shape
    size = max(n, m)
    cost = np.zeros((size + 1, size + 1))
    cost[1 : n + 1, 1 : m + 1] = -score
    u, v, match, way = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1, int), np.zeros(size + 1, int)
    for i in range(1, size + 1):
        match[0], j0 = i, 0
        low, used = np.full(size + 1, np.inf), np.zeros(size + 1, bool)
        while True:
            used[j0] = True
            reduced = cost[match[j0]] - u[match[j0]] - v
            better = ~used & (reduced < low)
            better[0] = False
            low[better], way[better] = reduced[better], j0
            free = np.where(used, np.inf, low)
            free[0] = np.inf
            j1 = int(np.argmin(free))
            delta = free[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if 1 <= match[j] <= n and score[match[j] - 1, j - 1] > 0]


def best_pairs(rows: list[tuple]) -> list[tuple]:
    """The pairs (local, album, confidence) of the greatest total confidence, each record in one pair at most.

    Shortest augmenting paths over the given pairs only, so that a component takes room for its pairs, not for a matrix.
    A local record may also stay alone (album None), for nothing.
    """
    cost: dict = {}
    for local, album, s in sorted(rows):
        if s > 0:
            near = cost.setdefault(local, {})
            near[album] = min(near.get(album, 0.0), -s)
    u, v, owner, taken = {}, {}, {}, {}  # prices of both sides, who has an album, which album a record has
    for start, near in cost.items():
        u[start] = min(0.0, min(c - v.get(j, 0.0) for j, c in near.items()))
        heap, best, back, scanned, left = [], {}, {}, [], {}
        row, d = start, 0.0
        while True:
            scanned.append((row, d))
            heappush(heap, (d - u[row], 1, len(scanned), row, None))
            for j, c in cost[row].items():
                nd = d + max(0.0, c - u[row] - v.get(j, 0.0))
                if j not in left and nd < best.get(j, math.inf):
                    best[j], back[j] = nd, row
                    heappush(heap, (nd, 0, j, row, j))
            while True:
                d, _, _, row, album = heappop(heap)
                if album is None or (album not in left and best[album] == d):
                    break
            if album is None or album not in owner:
                break
            left[album] = d
            row = owner[album]
        for r, dr in scanned:
            u[r] += d - dr
        for j, dj in left.items():
            v[j] = v.get(j, 0.0) + dj - d
        end = row if album is None else back[album]
        while True:
            before = taken.get(end)
            taken[end] = album
            if album is not None:
                owner[album] = end
            if end == start:
                break
            album, end = before, back[before]
    return [(x, j, -cost[x][j]) for x, j in taken.items() if j is not None]


def _assign(rows: list[tuple]) -> list[tuple]:
    """The pairs (local, album, confidence) of one component -> those of the best assignment."""
    if len({r[1] for r in rows}) == 1 or len({r[0] for r in rows}) == 1:
        return [min(rows, key=lambda r: (-r[2], r[1], r[0]))]
    return best_pairs(rows)


def assign(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs of the greatest total confidence, exactly for components of any size; one is held by one task."""
    pairs = cut(pairs)
    room = 1 << 62
    if pairs.where(~(F.col("local").between(-room, room - 1) & F.col("album").between(-room, room - 1))).isEmpty():
        # numbers are compared and hashed without sorting: even ones for local records, odd ones for albums
        parts = components(pairs.select(F.shiftleft("local", 1).alias("a"), F.shiftleft("album", 1).bitwiseOR(F.lit(1)).alias("b")))
        of = parts.where(F.col("node").bitwiseAND(F.lit(1)) == 0).select(F.shiftright("node", 1).alias("local"), "component")
    else:
        parts = components(pairs.select(F.concat(F.lit("l"), F.col("local")).alias("a"), F.concat(F.lit("c"), F.col("album")).alias("b")))
        of = parts.where("node LIKE 'l%'").select(F.expr("cast(substr(node, 2) as long)").alias("local"), "component")
    sized = pairs.join(of, "local").select("component", "local", "album", "confidence")
    return grouped_rows(sized, "component", ["local", "album"], _assign, "local long, album long, confidence double")


def copies(x: tuple, y: tuple, title: float, artist: float) -> bool:
    """Whether two local releases (title words, artist words, year, count) have like words and fitting years and counts."""
    fits = all(not p or not q or p != p or q != q or abs(p - q) <= 1 for p, q in zip(x[2:], y[2:], strict=True))
    return fits and title_similarity(x[0], y[0]) >= title and artist_similarity(x[1], y[1]) >= artist


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        side = lambda p: zip((t.split(" ") for t in pdf[p + "title"]), (tuple(a.split(" ")) for a in pdf[p + "artist"]), pdf[p + "year"], pdf[p + "count"], strict=True)  # noqa: B023, E731
        yield pdf.loc[[copies(x, y, *DAMAGED) for x, y in zip(side(""), side("w_"), strict=True)], ["local", "album", "confidence"]]


def _copies(rows: list[tuple]) -> list[tuple]:
    """Rows (id, confidence, title, artist, year, count) of the classes that fit one album best -> (copy, of): those that
    are copies of another, which is the one that fits best among those with like words and fitting years and counts."""
    leaders, out = [], []
    for i, _, title, artist, year, count in sorted(rows, key=lambda r: (-r[1], r[0])):
        title, artist = title.split(" "), tuple(artist.split(" "))
        for j, t, a, y, c in leaders:
            if copies((title, artist, year, count), (t, a, y, c), *ALIKE):
                out.append((i, j))
                break
        else:
            leaders.append((i, title, artist, year, count))
    return out


def joined(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(copy, of): local classes that are copies of another one although their tags differ a little.

    Both fit the same album best; a class that fits an album of its own better is another release. Of albums that
    fit a class equally, the one that any class fits best counts.
    """
    most = pairs.groupBy("album").agg(F.max("confidence").alias("most"))
    top = F.max(F.struct("confidence", "most", (-F.col("album")).alias("o"))).alias("top")
    best = pairs.join(most, "album").groupBy("local").agg(top).select(F.col("local").alias("id"), (-F.col("top.o")).alias("album"), F.col("top.confidence").alias("confidence"))
    words = classes.select("id", "title", "artist", F.col("year").cast("double").alias("year"), F.col("count").cast("double").alias("count"))
    rows = best.join(words, "id").select("album", "id", "confidence", "title", "artist", "year", "count")
    return grouped_rows(rows, "album", ["id"], _copies, "copy long, of long")


def match_releases(groups: DataFrame, albums: DataFrame, window: int = WINDOW, threshold: float = THRESHOLD) -> DataFrame:
    """(group_id, collection_id, confidence): the album of each local release, with a confidence of 0 to 1.

    `groups` has id, title, artist, year, count; `albums` likewise. Null years and counts agree half with anything;
    releases without a title or an artist match nothing. Ids must be distinct within a table; an empty table on
    either side gives no rows.
    """
    cols = ["id", "title", "artist", "year", "count"]
    raw = groups.select(F.lit(0).alias("side"), *cols).unionByName(albums.select(F.lit(1).alias("side"), *cols))
    rows = cut(raw.select("side", "id", "title", "artist", F.col("year").cast("int").alias("year"), F.col("count").cast("int").alias("count")).repartition(shuffle_width(groups.sparkSession), "title").mapInPandas(_prepare, PREPARED))
    # local copies of one release form a class, named by its smallest id
    form = ["sorted", "artist", "y", "c"]
    local = rows.where("side = 0").withColumns({"y": F.coalesce("year", F.lit(-1)), "c": F.coalesce("count", F.lit(-1))})
    local = cut(local.join(local.groupBy(*form).agg(F.min("id").alias("local")), form).drop("y", "c"))
    classes = local.where("id = local").drop("local")
    pool = classes.unionByName(rows.where("side = 1"))
    number = lambda name: F.lpad(F.coalesce(F.col(name), F.lit(0)).cast("string"), 4, "0")
    keys = [
        F.concat_ws("|", "sorted", "artist"),
        F.concat_ws("|", "title", number("year"), "artist"),
        F.concat_ws("|", "rare", "title"),
        F.concat_ws("|", "longest", number("year"), number("count"), "sorted"),
        F.concat_ws("|", number("year"), number("count"), "rare", "sorted"),
        F.concat_ws("|", F.reverse("title"), "rare"),
    ]
    # blocks of equal keys that no window holds are compared as a whole
    beyond = equal_pairs(pool, window).where(F.col("confidence") >= threshold).unionByName(same_artist_pairs(pool, F.col("longest"), window, threshold))
    near = neighbour_pairs(pool, keys, window, least=threshold)
    pairs = cut(near.unionByName(beyond).groupBy("local", "album").agg(F.max("confidence").alias("confidence")))
    same = cut(joined(pairs, classes))
    chosen = cut(assign(pairs.join(same, F.col("local") == F.col("copy"), "left_anti")))
    own = pairs.select("local", "album", F.col("confidence").alias("own"))
    doubles = same.join(chosen, F.col("of") == F.col("local")).select(F.col("copy").alias("local"), "album", "confidence").join(own, ["local", "album"], "left")
    chosen = cut(chosen.unionByName(doubles.select("local", "album", F.coalesce("own", "confidence").alias("confidence"))))
    # a class that lost its best album keeps it only if it is shown to be a copy of the class that has it
    tops = pairs.join(chosen.select("local"), "local", "left_anti").groupBy("local").agg(F.max(F.struct("confidence", (-F.col("album")).alias("o"))).alias("top"))
    tops = tops.select("local", (-F.col("top.o")).alias("album"), F.col("top.confidence").alias("confidence"))
    words = classes.select(F.col("id").alias("local"), "title", "artist", F.col("year").cast("double").alias("year"), F.col("count").cast("double").alias("count"))
    winners = chosen.groupBy("album").agg(F.min("local").alias("local")).join(words, "local").toDF("winner", "album", "w_title", "w_artist", "w_year", "w_count")
    found = chosen.unionByName(tops.join(words, "local").join(winners, "album").mapInPandas(_kept, "local long, album long, confidence double"))
    ids = local.select("id", "local")
    return ids.join(found, "local").select(F.col("id").alias("group_id"), F.col("album").alias("collection_id"), F.round("confidence", 6).alias("confidence"))

"""Problem 5: several values packed in one field.

Method: a finite-state tokenizer walks each distinct field once. It tracks quoting, escapes and the
nesting of brackets and emits values with ordinals from the delimiters outside quotes. Delimiters that
also occur inside names (an ampersand, a comma, `and`, ...) only propose a cut: neighbouring values are
joined again where together they are one known name. Known names are looked up with a distributed
join, never collected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.skew import lookup_join
from tagloom.session import cut

# What separates the acts of a credit.
HARD = {";", "|", "\\\\"}
SOFT = {",", "/", "&", "+", "、", "＆", "×"}
HARD_WORDS = {"feat", "feat.", "ft", "ft.", "featuring", "vs", "vs."}
SOFT_WORDS = {"and", "with", "x"}
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»"}
OPEN, CLOSE = "([{", ")]}"
#: A field without any of these holds one value (a necessary condition, checked on the Java side).
POSSIBLE = r"(?i)[;|\\,/&+、＆×\"“„«]|\b(feat|ft|featuring|vs|and|with|x)\b"
#: What can stand between two pieces of one name.
DELIMITER = r"(?i)[,/&+、＆×]|\b(?:and|with|x)\b"
#: Joining words that don't tell names apart.
IGNORED = ["and"]


def name_key(value: Column) -> Column:
    """Words of a name in lower case and sorted, without joining words: equal for reformatted and reordered names."""
    words = F.regexp_extract_all(F.lower(value), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))
    return F.array_join(F.array_sort(F.array_except(words, F.array(*(F.lit(w) for w in IGNORED)))), " ")


class Piece:
    """A value between delimiters: its span in the field, the delimiter before it and whether it was quoted."""

    __slots__ = ("start", "end", "before", "quoted")

    def __init__(self, start: int, end: int, before: str, quoted: bool):
        self.start, self.end, self.before, self.quoted = start, end, before, quoted


def tokenize(text: str) -> list[Piece]:
    """Pieces of a field in order. Delimiters inside quotes, and escaped ones, don't cut; empty pieces are dropped.

    States: outside and inside quotes; depth counts open brackets. A bracket opens a nested credit if it
    begins with a joining word (feat., with, ...), and then its contents are pieces of their own; any other
    bracket belongs to the piece it stands in, and delimiters in it don't cut. An unclosed quote is an
    ordinary character.
    """
    pieces: list[Piece] = []
    start, before, quoted, depth, credit = 0, "", False, 0, []
    i, n = 0, len(text)

    def close(end: int, delimiter: str, resume: int) -> None:
        nonlocal start, before, quoted
        a, b = start, end
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            if quoted and b - a >= 2 and text[a] in QUOTES and text[b - 1] == QUOTES[text[a]]:
                a, b = a + 1, b - 1
            else:
                quoted = False
            pieces.append(Piece(a, b, before, quoted))
            before = delimiter
        elif not pieces or delimiter in HARD or delimiter in HARD_WORDS:
            before = delimiter
        start, quoted = resume, False

    while i < n:
        c = text[i]
        if c == "\\":
            if text[i : i + 2] == "\\\\":
                close(i, "\\\\", i + 2)
                i += 2
                continue
            i += 2  # an escaped character is an ordinary one
            continue
        if c in QUOTES and not text[start:i].strip():
            end = i + 1
            while end < n and not (text[end] == QUOTES[c] and text[end + 1 : end + 2] != c and text[end - 1] != "\\"):
                end += 2 if text[end] == QUOTES[c] else 1  # a doubled quote stays inside
            if end < n:
                quoted, i = True, end + 1
                continue
        if c in OPEN:
            m = re.match(r"\s*(feat\.?|ft\.?|featuring|with|vs\.?)\s+", text[i + 1 :], re.I)
            if m and depth == 0:
                close(i, m.group(1).lower(), i + 1 + m.end())
                credit.append(c)
                i = start
                continue
            depth += 1
        elif c in CLOSE:
            if depth:
                depth -= 1
            elif credit:
                credit.pop()
                close(i, "", i + 1)
        elif depth == 0:
            if c in HARD or c in SOFT:
                close(i, c, i + 1)
            elif c.isspace() and i + 1 < n:
                m = re.match(r"[^\W\d_]+\.?(?=\s)", text[i + 1 : i + 12])
                word = m.group().lower() if m else ""
                if word in HARD_WORDS or word in SOFT_WORDS:
                    close(i, word, i + 1 + m.end())
                    i = start
                    continue
        i += 1
    close(n, "", n)
    return pieces


def soft(delimiter: str) -> bool:
    return delimiter in SOFT or delimiter in SOFT_WORDS


def runs(pieces: list[Piece], inner: int | None = None) -> list[tuple[int, int]]:
    """Spans [i, j) of unquoted pieces joined by soft delimiters only, of at most `inner` of them; single pieces included."""
    inner = len(pieces) if inner is None else max(1, inner)
    out = []
    for i in range(len(pieces)):
        out.append((i, i + 1))
        j = i + 1
        while j < len(pieces) and j - i <= inner and soft(pieces[j].before) and not pieces[j].quoted and not pieces[i].quoted:
            j += 1
            out.append((i, j))
    return out


def resolve(text: str, pieces: list[Piece], known: set[tuple[int, int]], inner: int | None = None) -> list[str]:
    """The names of a field: the segmentation into runs with the fewest unknown names, then the fewest names.

    An unknown run of several pieces is allowed only where one word is joined with one unknown word
    (a duo such as a name and a noun), where two unknown words stand around a comma (an inverted name), or
    where the second part can't stand alone (`The`, `Choir of ...`, also when the field breaks off in it).
    """
    n = len(pieces)
    best: list[tuple[tuple[float, int], int]] = [((0.0, 0), 0)] + [((float("inf"), 0), 0)] * n
    for i, j in runs(pieces, inner):
        if (i, j) in known or (j == i + 1 and pieces[i].quoted):
            cost = 0.0
        elif j == i + 1:
            cost = 1.0
        elif j == i + 2:
            left, right = text[pieces[i].start : pieces[i].end], text[pieces[i + 1].start : pieces[i + 1].end]
            duo = pieces[i + 1].before in ("/", "&", "+", "and") and " " not in left and " " not in right and (i + 1, j) not in known
            part = right.lower() in ("the", "los", "las", "die", "les") or re.match(r"(?i)choir of\b", right) is not None
            part = part or (j == n and "choir of".startswith(right.lower()) and re.search(r"(?i)orch(estra|\.)?$", left) is not None)
            inverted = pieces[i + 1].before == "," and " " not in left and " " not in right and (i, i + 1) not in known and (i + 1, j) not in known
            if not duo and not part and not inverted:
                continue
            cost = 0.9
        else:
            continue
        value = (best[i][0][0] + cost, best[i][0][1] + 1)
        if value < best[j][0]:
            best[j] = (value, i)
    cuts, j = [], n
    while j > 0:
        i = best[j][1]
        cuts.append((i, j))
        j = i
    return [text[pieces[i].start : pieces[j - 1].end].strip() for i, j in reversed(cuts)]


def _spans(inner: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value in batch["value"]:
                pieces = tokenize(value)
                if len(pieces) > 1:
                    rows += [(value, i, j, value[pieces[i].start : pieces[j - 1].end]) for i, j in runs(pieces, inner)]
            yield pd.DataFrame(rows, columns=["value", "i", "j", "span"])

    return run


def _resolved(inner: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value, known in zip(batch["value"], batch["known"], strict=True):
                names = [x for x in resolve(value, tokenize(value), {(k["i"], k["j"]) for k in known}, inner) if x]
                if len(names) > 1:
                    rows += [(value, pos, name) for pos, name in enumerate(names, 1)]
            yield pd.DataFrame(rows, columns=["value", "pos", "val"]).astype({"pos": "int32"})

    return run


def split_values(values: DataFrame, known_names: DataFrame) -> DataFrame:
    """(value, pos, val): the names packed in each distinct `value`; values with one name give no rows.

    `values` has distinct values in column `value`; `known_names` has names in column `name` (repeats and
    nulls are ignored). Null and empty values give no rows. Positions count from 1 in the order of the field.
    """
    packed = values.select("value").where(F.col("value").rlike(POSSIBLE))
    # no known name has more delimiters inside; names with one that always separates are never joined again
    whole = known_names.where(~F.col("name").rlike(r"[;|]|\\\\"))
    inner = whole.agg(F.max(F.size(F.regexp_extract_all("name", F.lit(DELIMITER), F.lit(0))))).first()[0] or 1
    spans = cut(packed.mapInPandas(_spans(inner), "value string, i int, j int, span string").withColumn("key", name_key(F.col("span"))))
    keys = known_names.select(name_key(F.col("name")).alias("key")).where("key <> ''").distinct()
    known = spans.join(keys, "key", "left_semi")
    per_value = spans.select("value", F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("j")).distinct().unionByName(known.select("value", "i", "j"))
    collected = per_value.groupBy("value").agg(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "j"))).alias("known"))
    return collected.mapInPandas(_resolved(inner), "value string, pos int, val string")


def split_fields(rows: DataFrame, field: str, known_names: DataFrame) -> DataFrame:
    """(tbl, row_id, pos, val) for `rows` (tbl, row_id, `field`): one row per name of each field with two or more names."""
    named = rows.select("tbl", "row_id", F.col(field).alias("value")).where(F.col("value").rlike(POSSIBLE))
    counted = cut(named.groupBy("value").agg(F.count("*").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    names = split_values(counted, known_names)
    lists = names.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("pos", "val"))).alias("names")).join(counted, "value")
    return lookup_join(named, cut(lists), "value", "n", total).select("tbl", "row_id", F.explode("names").alias("x")).select("tbl", "row_id", "x.pos", "x.val")

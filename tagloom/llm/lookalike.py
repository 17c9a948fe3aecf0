"""Problem 6: visually identical text with different characters.

Method: script-aware repair. Compatibility forms, split accents, invisible characters, odd blanks and
hyphens have one plain form each. Look-alike letters of another alphabet are judged word by word: the
dominant script of the word is determined, and the strangers are replaced by their look-alikes of that
script only if the resulting word occurs in the vocabulary of the corpus (counted over all rows).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.session import cut

# Letters that look alike, Latin first, then Cyrillic, then Greek ('-' where there is none).
LOOK_ALIKES = """
A А Α|B В Β|C С -|E Е Ε|H Н Η|I І Ι|J Ј -|K К Κ|M М Μ|N - Ν|O О Ο|P Р Ρ|S Ѕ -|T Т Τ|X Х Χ|Y Ү Υ|Z - Ζ|
a а α|c с -|e е -|i і ι|j ј -|k к κ|n - η|o о ο|p р ρ|s ѕ -|u - υ|v - ν|w - ω|x х χ|y у γ|d ԁ -|h һ -|q ԛ -|w ԝ -|l ӏ -|g ɡ -|
"""
SCRIPTS = ["LATIN", "CYRILLIC", "GREEK"]
INVISIBLE = "­​‌‍‎‏⁠⁡⁢⁣⁤﻿᠎͏؜"
BLANKS = "               　"
HYPHENS = "‐‑‒–—―−­﹘﹣－"
#: Decompositions that count as other forms of the same character (not superscripts, fractions or squares).
FORMS = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>", "<circle>")
#: Compatibility characters that are ordinary text: the ellipsis and spacing accents and letters.
ORDINARY = set("…¨¯´¸µ˘˙˚˛˜˝ͺ΄") | set(HYPHENS)

#: A cheap necessary condition for the Java side: some character outside ASCII.
SUSPECT = r"[^\x00-\x7F]"


def _look_alike_table() -> dict[str, dict[str, str]]:
    """Target script -> stranger -> its look-alike in that script."""
    out: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}
    for entry in LOOK_ALIKES.replace("\n", "").split("|"):
        letters = entry.split()
        for i, target in enumerate(letters):
            for j, other in enumerate(letters):
                if i != j and target != "-" and other != "-":
                    out[SCRIPTS[i]].setdefault(other, target)
    return out


TABLE = _look_alike_table()


def script(c: str) -> str:
    if c.isascii():
        return "LATIN"
    name = unicodedata.name(c, "").split(" ")[0]
    return name


def plain(text: str) -> str:
    """Compatibility forms, split accents, invisible characters, blanks and hyphens in their one plain form."""
    out = []
    for c in text:
        if c in INVISIBLE:
            continue
        if c in BLANKS:
            out.append(" ")
        elif c in "‐‑‒−﹣－":
            out.append("-")
        elif c not in ORDINARY and unicodedata.decomposition(c).startswith(FORMS):
            out.append(unicodedata.normalize("NFKC", c))
        else:
            out.append(c)
    joined = "".join(out)
    # half-width sound marks become combining marks, which then join their letter
    joined = joined.replace("゛", "゙").replace("゜", "゚") if re.search("[ﾞﾟ]", text) else joined
    return unicodedata.normalize("NFC", joined)


def mixed_words(text: str) -> list[tuple[str, list[str]]]:
    """Words of more than one of the alphabets, each with its forms in one alphabet, the dominant alphabet first."""
    out = []
    for word in re.findall(r"[^\W_]+", text):
        counts: dict[str, int] = {}
        for c in word:
            if c.isalpha() and (s := script(c)) in SCRIPTS:
                counts[s] = counts.get(s, 0) + 1
        if len(counts) < 2:
            continue
        forms = []
        for target in sorted(counts, key=lambda s: (-counts[s], SCRIPTS.index(s))):
            new = "".join(TABLE[target].get(c, c) if c.isalpha() and script(c) != target else c for c in word)
            if all(script(c) == target or script(c) not in SCRIPTS for c in new if c.isalpha()):
                forms.append(new)
        out.append((word, forms))
    return out


def odd(text: str) -> bool:
    """Whether the value holds characters that only look like the usual ones (other than mixed words)."""
    return plain(text) != text


def _examine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for value in batch["value"]:
            base = plain(value)
            mixed = mixed_words(base)
            if base != value or mixed:
                rows.append((value, base, [{"word": w, "forms": f} for w, f in mixed]))
        yield pd.DataFrame(rows, columns=["value", "base", "mixed"])


def examine(values: DataFrame) -> DataFrame:
    """(value, base, mixed) for those distinct values that hold odd characters; `base` has all but mixed words repaired."""
    return values.mapInPandas(_examine, "value string, base string, mixed array<struct<word: string, forms: array<string>>>")


def repaired(values: DataFrame) -> DataFrame:
    """(value, consistent): one consistent form of each odd value among `values` (value, n), counted over the corpus.

    Values without odd characters give no row; null never occurs; an empty table gives no rows.
    """
    suspects = values.where(F.col("value").rlike(SUSPECT))
    found = cut(examine(suspects.select("value")))
    forms = found.select("value", "base", F.posexplode("mixed").alias("i", "m")).select("value", "i", "m.word", F.posexplode("m.forms").alias("rank", "form"))
    wanted = forms.select(F.lower("form").alias("w")).distinct()
    words = values.select("n", F.explode(F.regexp_extract_all(F.lower("value"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w"))
    known = words.join(wanted, "w").groupBy("w").agg(F.sum("n").alias("known"))
    best = forms.join(known, F.lower("form") == F.col("w")).groupBy("value", "i", "word").agg(F.max_by("form", F.struct("known", -F.col("rank"))).alias("form"))
    swaps = best.groupBy("value").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("word", "form")))).alias("swap"))
    return found.join(swaps, "value", "left").select("value", "base", F.coalesce("swap", F.create_map().cast("map<string,string>")).alias("swap"))


def apply_swaps(base, swap):
    """`base` with every word that `swap` names replaced; the text between words stays."""
    parts = F.regexp_extract_all(base, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(swap, p), p)), "")


def odd_fields(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value) of every non-ASCII value."""
    value = rows.select(F.col(key).alias("key"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("x"))
    return value.select("key", "x.field", "x.value").where(F.col("value").isNotNull())

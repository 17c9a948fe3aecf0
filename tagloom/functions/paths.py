"""Paths: globs as anchored patterns, protected and layout folders, release folders."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folder names of formats, and prefixes of protected folders.
FORMATS = ["aac", "aiff", "alac", "flac", "lossless", "m4a", "mp3", "ogg", "opus", "wav", "wave"]
PROTECTED = ["00", "dcc", "gzs"]
LAYOUT = rf"^(?:{'|'.join(FORMATS)}|(?:cd|disc|disk)\s*\d{{1,3}})$"


def glob_pattern(glob: str) -> str:
    """Anchored regular expression of a glob: `*` and `?` stay inside a segment, `**` spans any number of segments."""
    out = []
    segments = glob.replace("\\", "/").split("/")
    for i, s in enumerate(segments):
        last = i == len(segments) - 1
        if s == "**":
            out.append(".*" if last else "(?:[^/]+/)*")
        else:
            out.append("".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in s) + ("" if last else "/"))
    return "^" + "".join(out) + "$"


def matches_any(path: Column, globs: list[str]) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | path.rlike(glob_pattern(g))
    return found


def folders(path: Column) -> Column:
    """The folder names of a path, from the root, without the file name."""
    parts = F.split(path, "/")
    return F.filter(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: s != "")


def is_protected(path: Column, prefixes: list[str] = PROTECTED) -> Column:
    """Some folder (not the file name) begins with a protected prefix, whatever its case."""
    return F.exists(folders(path), lambda s: F.lower(s).rlike("^(?:" + "|".join(map(re.escape, prefixes)) + ")"))


def is_layout(folder: Column) -> Column:
    """A folder that only sorts files by format or disc."""
    return F.lower(F.trim(F.regexp_replace(folder, r"[^\p{L}\p{N}_]+", " "))).rlike(LAYOUT)


def release_folder(path: Column, folded_album: Column, fold_segments: Column) -> Column:
    """The folder that stands for the release of a file: the nearest one named like the album, else the nearest
    that is no layout folder. `fold_segments` holds the folded folder names in the order of `folders`."""
    parts = folders(path)
    n = F.size(parts)
    named = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), lambda best, i: F.when((folded_album != "") & (F.try_element_at(fold_segments, i + 1) == folded_album), i + 1).otherwise(best))
    kept = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), lambda best, i: F.when(~is_layout(F.coalesce(F.try_element_at(parts, i + 1), F.lit("cd 1"))), i + 1).otherwise(best))
    return F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), F.when(named > 0, named).otherwise(kept)), "/"))


def common_folder(paths: Column) -> Column:
    """Longest folder that all paths of an array share."""
    shared = lambda a, b: F.slice(a, F.lit(1), F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")))["n"])
    lists = F.transform(paths, folders)
    return F.concat(F.lit("/"), F.array_join(F.aggregate(lists, F.element_at(lists, 1), shared), "/"))

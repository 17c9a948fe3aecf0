"""Similarity of durations, positions, counts and years; unknown scores one half."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_similarity(left: Column, right: Column) -> Column:
    """1 for equal, 0.8 at the tolerance of min(4 s, max(2 s, 0.5 %)), 0 beyond it."""
    gap = F.abs(left - right)
    tolerance = F.least(F.lit(4000.0), F.greatest(F.lit(2000.0), F.greatest(left, right) * 0.005))
    return F.when(left.isNull() | right.isNull(), 0.5).when(gap > tolerance, 0.0).otherwise(1.0 - 0.2 * (gap / tolerance))


def position_similarity(disc: Column, number: Column, other_disc: Column, other_number: Column) -> Column:
    """Share of equal values among disc and track numbers known on both sides."""
    known = (disc.isNotNull() & other_disc.isNotNull()).cast("int") + (number.isNotNull() & other_number.isNotNull()).cast("int")
    equal = F.coalesce((disc == other_disc).cast("int"), F.lit(0)) + F.coalesce((number == other_number).cast("int"), F.lit(0))
    return F.when(known > 0, equal / known).otherwise(0.5)


def count_score(left: Column, right: Column) -> Column:
    top = F.greatest(left, right, F.lit(1))
    return F.when(right > 0, F.greatest(F.lit(0.0), 1.0 - F.abs(left - right) / top)).otherwise(0.5)


def year_score(left: Column, right: Column, scale: int = 5) -> Column:
    return F.when(left.isNull() | right.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(left - right) / scale))


def duration_multiset(left: Column, right: Column, left_count: Column, right_count: Column) -> Column:
    """struct<coverage,closeness,distance> of two arrays of durations, compared rank by rank without order.

    Nulls in the arrays are unknown; counts are the numbers of tracks, known or not. With no known pair the
    coverage is one half.
    """
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  # `f` of a value that is computed once
    a, b = (F.sort_array(F.array_compact(c)) for c in (left, right))
    shorter = lambda s: F.least(F.size(s["a"]), F.size(s["b"]))
    zipped = lambda s, n: F.zip_with(F.slice(s["a"], F.lit(1), n), F.slice(s["b"], F.lit(1), n), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    gap = lambda p: F.abs(p["x"] - p["y"]).cast("double")
    allowed = lambda p: F.greatest(F.lit(10000.0), F.greatest(p["x"], p["y"]) * 0.03)
    below = F.greatest(left_count, right_count, F.lit(1))
    closeness = lambda near: F.aggregate(near, F.lit(0.0), lambda s, p: s + (1.0 - 0.15 * (gap(p) / allowed(p))))
    distance = lambda pairs: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + gap(p))
    scored = lambda e: F.when(F.size(e["pairs"]) == 0, F.struct(F.lit(0.5).alias("coverage"), F.lit(0.0).alias("closeness"), F.lit(0.0).alias("distance"))).otherwise(
        F.struct((F.size(e["near"]) / below).alias("coverage"), (closeness(e["near"]) / below).alias("closeness"), distance(e["pairs"]).alias("distance"))
    )
    pairs = once(F.struct(a.alias("a"), b.alias("b")), lambda s: zipped(s, shorter(s)))
    return once(once(pairs, lambda p: F.struct(p.alias("pairs"), F.filter(p, lambda x: gap(x) <= allowed(x)).alias("near"))), scored)

"""Problem 2: records that are equal but for spacing, case, punctuation or order of words.

Method: every column is dictionary-encoded. Each distinct value is canonicalised once, equal
canonical forms share one integer, records become tuples of integers, and the compact tuples are
grouped. Text is shuffled only while the dictionary is built and looked up; the grouping of
records sees integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.skew import lookup_join
from tagloom.session import cut

#: Runs of Unicode letters and digits are words; everything else separates them.
WORD = r"[\p{L}\p{N}]+"


def canonical_words(value: Column) -> Column:
    """The words of a value in lower case and sorted, repeats kept; a value without words gives ''."""
    return F.array_join(F.array_sort(F.regexp_extract_all(F.lower(value), F.lit(WORD), F.lit(0))), " ")


def encode(records: DataFrame, key: str, word_fields: list[str], exact_fields: list[str], number_fields: list[str]) -> DataFrame:
    """One row per record: `key`, an integer per text field (c0, c1, ...), and the number fields.

    Nulls stay null. Rows of `records` must have distinct, non-null keys; other columns are ignored.
    """
    fields = [*word_fields, *exact_fields]
    # '=' marks values that are compared as they are, '~' values that are compared by their words
    tagged = [F.struct(F.lit(i).alias("f"), F.concat(F.lit("~" if i < len(word_fields) else "="), F.col(f)).alias("value")) for i, f in enumerate(fields)]
    long = records.select(F.col(key).alias("id"), F.explode(F.array(*tagged)).alias("x")).select("id", "x.f", "x.value").where("value IS NOT NULL")
    values = cut(long.groupBy("value").agg(F.count("*").alias("n")).withColumn("canonical", F.when(F.col("value").startswith("~"), canonical_words(F.expr("substr(value, 2)"))).otherwise(F.col("value"))))
    total = values.agg(F.sum("n"), F.count("*")).first()
    codes = cut(values.groupBy("canonical").agg(F.count("*").alias("spellings")).withColumn("code", F.monotonically_increasing_id()))
    dictionary = lookup_join(values, codes, "canonical", "spellings", total[1] or 0).select("value", "n", "code")
    coded = lookup_join(long, cut(dictionary), "value", "n", total[0] or 0).select("id", "f", "code")
    plain = records.select(F.col(key).alias("id"), F.lit(-1).alias("f"), F.lit(None).cast("long").alias("code"), *number_fields)
    rows = coded.unionByName(plain, allowMissingColumns=True)
    return rows.groupBy("id").agg(*(F.max(F.when(F.col("f") == i, F.col("code"))).alias(f"c{i}") for i in range(len(fields))), *(F.max(n).alias(n) for n in number_fields))


def collapse(records: DataFrame, key: str, word_fields: list[str], exact_fields: list[str] = [], number_fields: list[str] = []) -> DataFrame:  # noqa: B006
    """One row per record: `id`, `kept_id` (the smallest id among its equals) and `copies` (how many equals, itself included).

    Null equals only null; an empty value equals any value without words. Plain repeats count.
    An empty table gives no rows. Number fields are compared exactly, in their own type.
    """
    coded = encode(records, key, word_fields, exact_fields, number_fields)
    kinds = {n: t for n, t in coded.dtypes if n != "id"}
    # the tuple itself is the key: per field its value in its own type and whether it is null
    values = [F.coalesce(F.col(n), F.lit(0).cast(t)).alias(n) for n, t in kinds.items()]
    tuples = cut(coded.select("id", F.struct(*(F.col(n).isNull().alias(f"{n}_null") for n in kinds), *values).alias("tuple")))
    groups = cut(tuples.groupBy("tuple").agg(F.min("id").alias("kept_id"), F.count("*").alias("copies")))
    total = groups.agg(F.sum("copies")).first()[0] or 0
    return lookup_join(tuples, groups.withColumn("weight", F.col("copies")), "tuple", "weight", total).select("id", "kept_id", "copies")

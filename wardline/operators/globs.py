"""Globs matched against many values through an index of their rarest literal pieces.

A glob's literal pieces are what stands between its wildcards. A value can only match if it holds every piece, so each
glob is filed under one gram (a run of GRAM characters, fewer if its pieces are shorter) of its pieces, the one that
fewest values hold; values meet the globs filed under their own grams by an equal join, and only those pairs are
verified by the whole pattern. Globs without any literal are filed under the empty gram, which every value holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.scalars import glob_regex
from wardline.storage import materialise

GRAM = 4


def _grams(text: Column, n: Column) -> Column:
    """Distinct runs of ``n`` characters of a text of at least that length."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n)))


def literal_grams(glob: Column, size: int = GRAM) -> Column:
    """The grams of a glob's literal pieces, all of one length: ``size``, or that of its longest piece if this is shorter; one empty gram without pieces."""
    pieces = F.filter(F.split(F.regexp_replace(glob, r"\[[^\]]*\]", "*"), r"[*?]"), lambda p: p != "")
    n = F.least(F.lit(size), F.coalesce(F.array_max(F.transform(pieces, F.length)), F.lit(0)))
    long = F.filter(pieces, lambda p: F.length(p) >= n)
    return F.when(n == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.flatten(F.transform(long, lambda p: _grams(p, n)))))


def value_grams(value: Column, sizes: list[int]) -> Column:
    """The grams of a value in the lengths that the index uses."""
    return F.flatten(F.array(*(F.when(F.length(value) >= n, _grams(value, F.lit(n)) if n else F.array(F.lit(""))).otherwise(F.array().cast("array<string>")) for n in sizes)))


def match_globs(values: DataFrame, value: str, globs: DataFrame, glob: str, size: int = GRAM) -> DataFrame:
    """(value, glob): the distinct values and globs of both tables that match. Nulls match nothing.

    How often a gram occurs is counted over the distinct values, for grams of globs alone. A glob one of whose grams no value holds
    matches nothing and is dropped there. A value's grams are far more bytes than the optimiser takes an exploded value for, so they are
    never a join's broadcast side: they are the left side of a semi join with the globs' grams, a table whose size is known, and are merged with the index.
    """
    tasks = values.sparkSession.sparkContext.defaultParallelism
    own = values.select(F.col(value).alias("_value")).filter("_value is not null").repartition(tasks, "_value").distinct()  # few bytes, but many grams
    filed = globs.select(F.col(glob).alias("_glob")).filter("_glob is not null").distinct()
    filed = materialise(filed.select("_glob", F.explode(literal_grams(F.col("_glob"), size)).alias("_gram")), "glob-grams")
    asked = materialise(filed.select("_gram").distinct(), "asked-grams")
    held = own.select("_value", F.explode(value_grams(F.col("_value"), list(range(size + 1)))).alias("_gram"))
    held = materialise(held.join(asked, "_gram", "left_semi").select("_value", "_gram"), "held-grams")
    often = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = filed.join(often, "_gram", "left").groupBy("_glob").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("x"))
    index = rarest.filter("x.n > 0").select("_glob", glob_regex("_glob").alias("_regex"), F.col("x._gram").alias("_gram"))
    met = held.join(index.hint("merge"), "_gram").filter(F.rlike("_value", "_regex"))
    return met.select(F.col("_value").alias(value), F.col("_glob").alias(glob))

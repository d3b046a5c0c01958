"""Names that resemble each other, exactly and without comparing all pairs.

Two names are similar if the words they share are SHARE of all their words or more, if one contains the other, or if their sequence ratio
(twice the characters of the longest common blocks over all characters) is RATIO or more. Each test has its own candidates, none of
which can miss a pair:

* words: of n distinct words the n - ceil(SHARE * n) + 1 rarest; two sets that share SHARE of their union share one of these;
* containment: of a name its rarest stretch of up to GRAM characters; whatever contains the name has that stretch;
* ratio: with M matching characters of L in both, each gap between matching blocks leaves out a character, so there are L - 2 M + 1
  blocks at most and M - blocks neighbouring pairs of characters in common: (3 RATIO / 2 - 1) * L - 1 or more. A name lists its pairs
  of characters (the second of a kind apart from the first), the rarest first, and keeps as many as leave no room for so many others;
  candidates are then held against the lengths and against the characters that they share at all, before the ratio is computed.

Candidates meet on the rare end of what a name has: what nearly all names have is last in its order and joins only names made of nothing
else. For pairs of few characters the ratio's bound says nothing; names so short meet on any character."""

from __future__ import annotations

import difflib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARE, RATIO, GRAM = 0.6, 0.78, 3
#: Pairs of characters in common that a pair of names with L characters has at least: SLOPE * L - 1.
SLOPE = 3 * RATIO / 2 - 1


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters, by longest common blocks."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(a=x, b=y).ratio() for x, y in zip(a, b)], dtype="float64")


def counted(items: Column) -> Column:
    """Items with how often each has come before it: the second of a kind differs from the first."""
    return F.transform(items, lambda x, i: F.concat_ws("\x00", x, F.size(F.filter(F.slice(items, F.lit(1), i), lambda y: y == x)).cast("string")))


def grams(name: Column, size: int) -> Column:
    n = F.length(name)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(name, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def characters(name: Column) -> Column:
    """The characters of a name, each with how often it has come before: names have as many in common as these arrays have."""
    return counted(F.filter(F.split(name, ""), lambda x: x != ""))


def rarest_first(names: DataFrame, items: Column) -> DataFrame:
    """a, item and place (from 1): the distinct items of each name, the rarest first, each with the number of names that have it."""
    rows = names.select("a", F.explode(F.array_distinct(items)).alias("item"))
    df = rows.groupBy("item").agg(F.count("*").alias("names"))
    return rows.join(df, "item").groupBy("a").agg(F.array_sort(F.collect_list(F.struct("names", "item"))).alias("x")).select("a", F.posexplode("x").alias("place", "y")).select("a", (F.col("place") + 1).alias("place"), "y.item")


def met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of names that share an item."""
    other = right.select(F.col("a").alias("b"), "item")
    return left.select("a", "item").join(other, "item").filter("a <> b").select("a", "b").distinct()


def by_words(names: DataFrame) -> DataFrame:
    words = F.array_distinct(F.filter(F.split("a", " "), lambda w: w != ""))
    rows = rarest_first(names, words).join(names.select("a", F.size(words).alias("n")), "a")
    first = rows.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * SHARE - 1e-9) + 1)
    return met(first, first)


def by_containment(names: DataFrame) -> DataFrame:
    """Pairs of a name (a) and one that it may contain (b)."""
    out = None
    for size in range(1, GRAM + 1):
        own = names if size == GRAM else names.filter(F.length("a") == size)
        own = own.filter(F.length("a") >= size)
        rare = rarest_first(names, grams(F.col("a"), size)).filter("place = 1").join(own, "a", "left_semi")
        inside = names.select("a", F.explode(F.array_distinct(grams(F.col("a"), size))).alias("item"))
        pairs = met(inside, rare)
        out = pairs if out is None else out.unionByName(pairs)
    return out


def by_ratio(names: DataFrame) -> DataFrame:
    """Pairs that may have the ratio."""
    n = F.length("a")
    least = RATIO / (2 - RATIO)  # of the longer's characters that the shorter has
    # with a partner of the least length that the ratio allows, so many pairs of characters are shared
    shared = F.greatest(F.ceil(SLOPE * (1 + least) * n - 1 - 1e-9), F.lit(1))
    pairs = counted(grams(F.col("a"), 2))
    rows = rarest_first(names.filter(n >= 2), pairs).join(names.select("a", (F.size(pairs) - shared + 1).alias("most")), "a")
    first = rows.filter(F.col("place") <= F.greatest("most", F.lit(1)))
    # where the bound says nothing (few characters in both), any shared character makes a candidate
    few = math.ceil(2 / SLOPE)
    single = names.filter(n < few).select("a", F.explode(F.array_distinct(F.filter(F.split("a", ""), lambda c: c != ""))).alias("item"))
    both = met(first, first).unionByName(met(single, single)).distinct()
    la, lb = F.length("a"), F.length("b")
    near = both.filter(2 * F.least(la, lb) >= RATIO * (la + lb) - 1e-9)
    return near.filter(2 * F.size(F.array_intersect(characters(F.col("a")), characters(F.col("b")))) >= RATIO * (la + lb) - 1e-9)


def similar_pairs(names: DataFrame) -> DataFrame:
    """a, b of the pairs of distinct, non-empty names (column a) that are similar, each both ways. The sequence ratio depends on which
    name comes first; a pair counts for a if the ratio of (a, b) does."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    share = F.size(F.array_intersect(words("a"), words("b"))) / F.size(F.array_union(words("a"), words("b")))
    shared = by_words(names).filter(share >= SHARE)
    inside = by_containment(names).filter(F.contains("a", F.col("b")))
    inside = inside.unionByName(inside.select(F.col("b").alias("a"), F.col("a").alias("b")))
    like = by_ratio(names).filter(sequence_ratio("a", "b") >= RATIO)
    return shared.unionByName(inside).unionByName(like).distinct()

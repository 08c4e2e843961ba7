"""Pairs of representatives carried over to the copies that they stand for.

A copy is a row whose content equals another's; of each group the least key is the representative. Rows of members
are (rep, key, n), n the size of the group, the representative itself included; groups of one have no rows. A group is
dealt out to parts of about ``PART`` keys, and parts are paired, so no task holds more than the pairs of two parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 1000


def _parts(part: int) -> Column:
    return F.ceil(F.col("n") / part).cast("int")


def _dealt(members: DataFrame, part: int) -> DataFrame:
    return members.select("rep", "key", "n", F.pmod(F.xxhash64("key"), _parts(part)).cast("int").alias("part"))


def carried(pairs: DataFrame, members: DataFrame, part: int = PART) -> DataFrame:
    """The pairs (a, b, ...) of representatives as pairs of all that they stand for."""
    dealt = _dealt(members, part)
    sizes = members.groupBy("rep").agg(F.first("n").alias("n"))
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    for end in ("a", "b"):
        split = pairs.join(sizes.withColumnRenamed("rep", end), end, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(_parts(part) - 1, F.lit(0))))).drop("n")
        met = split.join(dealt.select(F.col("rep").alias(end), "part", F.col("key").alias("_m")), [end, "part"], "left")
        pairs = met.withColumn(end, F.coalesce("_m", end)).drop("part", "_m")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *rest)


def twins(members: DataFrame, part: int = PART) -> DataFrame:
    """(rep, a, b): the pairs of copies of one another, the smaller key first."""
    every = F.explode(F.sequence(F.lit(0), _parts(part) - 1))
    dealt = _dealt(members, part)
    left = dealt.select("rep", F.col("part").alias("i"), every.alias("j"), F.col("key").alias("a"))
    right = dealt.select("rep", F.col("part").alias("j"), every.alias("i"), F.col("key").alias("b"))
    return left.join(right, ["rep", "i", "j"]).filter("a < b").select("rep", "a", "b")

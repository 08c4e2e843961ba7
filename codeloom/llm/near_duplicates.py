"""Near-duplicate records with small edits.

The method: each set gets many universal hash minima; bands of minima give candidate pairs; the
pairs are verified first by their signatures (the lowest bit of each minimum, compared by one XOR a
word) and then exactly; groups are connected components by alternating large-star and small-star.
Copies are joined to one representative first, so a group of copies costs one row in the bands.

With bands of 4 minima, 48 of them, a pair of similarity 0.7 is missed once in 500,000; the signature
test lets it through up to six standard deviations below its mean. Candidates grow with the number
of similar pairs, not with the square of the rows.

Defined results: null sets are in no pair and form groups of their own, as do empty ones; nulls
inside a set are dropped; values count once; repeated keys count once; further columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.components import components
from codeloom.operators.copies import carried, twins
from codeloom.runtime import checkpoint, spread

ROWS, BANDS, WORDS = 4, 48, 3
MINIMA = ROWS * BANDS
#: Keys of a group of copies that one task pairs with as many others.
PART = 1000


def _coefficients(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, MINIMA, dtype=np.uint64)


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return v ^ (v >> np.uint64(29))


def sketches(sets: DataFrame, key: str, values: str, seed: int = 7) -> DataFrame:
    """(key, size, print_a, print_b, bands, bits): sizes, two content hashes, band hashes, signature bits."""
    schema = f"key {sets.schema[key].dataType.simpleString()}, size int, print_a long, print_b long, bands array<long>, bits array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients(seed)
        for batch in batches:
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            base = _mix(flat)
            minima = np.empty((MINIMA, len(sizes)), np.uint64)
            for i in range(MINIMA):
                minima[i] = np.minimum.reduceat(_mix(base * a[i] + b[i]), starts)
            bands = np.empty((BANDS, len(sizes)), np.uint64)
            for i in range(BANDS):
                code = np.full(len(sizes), i + 1, np.uint64)
                for row in minima[i * ROWS : (i + 1) * ROWS]:
                    code = _mix(code * np.uint64(0x100000001B3) ^ row)
                bands[i] = code
            low = (minima & np.uint64(1)).reshape(WORDS, 64, -1)
            bits = np.bitwise_or.reduce(low << np.arange(64, dtype=np.uint64)[None, :, None], axis=1)
            prints = [np.add.reduceat(_mix(base ^ np.uint64(salt)), starts) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            n = len(sizes)

            def lists(rows: np.ndarray, n=n) -> pa.Array:
                width = rows.shape[0]
                return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows.T).reshape(-1).view(np.int64)))

            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), *[pa.array(p.view(np.int64)) for p in prints], lists(bands), lists(bits)], names=["key", "size", "print_a", "print_b", "bands", "bits"])

    # An array of longs without nulls is a set here already, or is made one.
    clean = sets.select(F.col(key), F.array_distinct(F.array_compact(values)).alias("v")).filter(F.col(key).isNotNull() & (F.size("v") > 0))
    return spread(clean).mapInArrow(run, schema)


def compared(sets: DataFrame, key: str, values: str, numerator: int = 7, denominator: int = 10) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, overlap, union) of representatives, and (rep, key, size, n) of each set that has n copies, itself included."""
    made = checkpoint(sketches(sets.select(key, values), key, values))
    copies = made.groupBy("print_a", "print_b", "size").agg(F.min("key").alias("rep"), F.count_distinct("key").alias("n")).filter("n > 1")
    grouped = made.join(copies, ["print_a", "print_b", "size"], "left")
    member = checkpoint(grouped.filter("rep is not null").select("rep", "key", "size", "n").distinct())
    reps = grouped.filter("rep is null or rep = key").select("key", "size", "bands", "bits")
    row = reps.select("key", "size", F.explode("bands").alias("band"))
    left, right = row.select("band", F.col("key").alias("a"), F.col("size").alias("na")), row.select("band", F.col("key").alias("b"), F.col("size").alias("nb"))
    close = (F.col("na") * denominator >= F.col("nb") * numerator) & (F.col("nb") * denominator >= F.col("na") * numerator)
    pairs = left.join(right, "band").filter((F.col("a") < F.col("b")) & close).select("a", "b", "na", "nb").distinct()
    bits_a, bits_b = reps.select(F.col("key").alias("a"), F.col("bits").alias("ba")), reps.select(F.col("key").alias("b"), F.col("bits").alias("bb"))
    differ = sum((F.expr(f"bit_count(ba[{i}] ^ bb[{i}])") for i in range(WORDS)), F.lit(0))
    share = numerator / denominator
    bound = int(MINIMA * (1 - share) / 2 + 6 * (MINIMA * (1 - share) / 2 * (1 + share) / 2) ** 0.5) + 1
    likely = checkpoint(pairs.join(bits_a, "a").join(bits_b, "b").filter(differ <= bound).select("a", "b", "na", "nb"))
    sides = likely.select(F.col("a").alias("k")).union(likely.select(F.col("b"))).distinct()
    held = sets.select(F.col(key).alias("k"), F.array_distinct(F.array_compact(values)).alias("v")).join(sides, "k", "left_semi").dropDuplicates(["k"])
    exact = likely.join(held.select(F.col("k").alias("a"), F.col("v").alias("va")), "a").join(held.select(F.col("k").alias("b"), F.col("v").alias("vb")), "b")
    exact = exact.withColumn("overlap", F.size(F.array_intersect("va", "vb")).cast("long")).withColumn("union", F.col("na") + F.col("nb") - F.col("overlap"))
    return checkpoint(exact.filter(F.col("overlap") * denominator >= F.col("union") * numerator).select("a", "b", "overlap", "union")), member


def similar_pairs(sets: DataFrame, key: str, values: str, numerator: int = 7, denominator: int = 10) -> DataFrame:
    """(a, b, overlap, union): distinct keys a < b whose sets have a Jaccard similarity of at least numerator / denominator.

    A pair of copies is a pair like any other; the sets of a copy group are compared once.
    """
    return _with_copies(*compared(sets, key, values, numerator, denominator))


def _with_copies(pairs: DataFrame, member: DataFrame) -> DataFrame:
    """Pairs of representatives, carried over to the copies, and the pairs of copies themselves."""
    members = member.select("rep", "key", "n")
    sizes = member.groupBy("rep").agg(F.first("size").cast("long").alias("overlap"))
    alike = twins(members, PART).join(sizes, "rep").select("a", "b", "overlap", F.col("overlap").alias("union"))
    return carried(pairs, members, PART).unionByName(alike).distinct()


def classes(sets: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """(key, component, links): every key with its group, its own if it is in no pair, and its number of links."""
    ends = pairs.select(F.col("a").alias(key)).union(pairs.select("b"))
    links = ends.groupBy(key).agg(F.count("*").alias("links"))
    group = components(pairs).withColumnRenamed("node", key)
    return sets.select(key).dropna().distinct().join(group, key, "left").join(links, key, "left").select(key, F.coalesce("component", key).alias("component"), F.coalesce("links", F.lit(0)).alias("links"))


def groups(sets: DataFrame, key: str, values: str, numerator: int = 7, denominator: int = 10) -> DataFrame:
    """(key, component, links): every key with its group, its own if it is in no pair, and its number of links.

    Copies take the group of their representative, the least of them; their links are counted from the sizes of the groups
    and never made.
    """
    pairs, member = compared(sets, key, values, numerator, denominator)
    sizes = member.groupBy(F.col("rep").alias("b")).agg(F.first("n").alias("n"))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(sizes, "b", "left").groupBy(F.col("a").alias("rep")).agg(F.sum(F.coalesce("n", F.lit(1))).alias("far"))
    group = components(pairs).withColumnRenamed("node", "rep")
    keys = sets.select(key).dropna().distinct()
    rows = keys.join(member.select(F.col("key").alias(key), "rep", "n"), key, "left").withColumn("rep", F.coalesce("rep", key))
    rows = rows.join(group, "rep", "left").join(links, "rep", "left")
    return rows.select(key, F.coalesce("component", "rep").alias("component"), (F.coalesce("far", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).alias("links"))


__all__ = ["classes", "components", "groups", "similar_pairs", "sketches"]

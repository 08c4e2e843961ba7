"""Similar pairs of token sets by exact prefix filtering, and their classes.

Values are ranked from rare to frequent. Two sets that share enough must share one of the rarest values
of the smaller one, so only those are joined: frequent values never meet, and no similar pair is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.copies import carried, twins
from codeloom.runtime import checkpoint

DUPLICATE, STRUCTURAL, COPY, COPY_TOKENS, SHARED = (7, 10), (8, 10), (3, 4), 40, 3


def _ranked(sets: DataFrame, key: str, values: str) -> DataFrame:
    """(k, v, n, at): each value of each set with the set's size and its place from rare to frequent."""
    rows = sets.select(F.col(key).alias("k"), F.size(F.array_distinct(values)).alias("n"), F.explode(F.array_distinct(values)).alias("v"))
    counts = rows.groupBy("v").agg(F.count("*").alias("df"))
    return rows.join(counts, "v").withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy("df", "v")))


def _prefix(n: Column, numerator: int, denominator: int) -> Column:
    """How many of the rarest values a partner must meet one of."""
    return n - F.ceil(n * numerator / denominator) + 1


def ranked(sets: DataFrame, key: str, values: str) -> DataFrame:
    """The values of all sets in their places, written once for the searches over them."""
    return checkpoint(_ranked(sets, key, values).select("k", "v", "n", "at"))


def jaccard_candidates(rows: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """Pairs that meet in a rare value early enough: at their first common value, what is left of both must still hold the overlap."""
    early = rows.filter(F.col("at") <= _prefix(F.col("n"), *ratio))
    a, b = early.select("v", F.col("k").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa")), early.select("v", F.col("k").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"))
    close = (F.col("na") * ratio[1] >= F.col("nb") * ratio[0]) & (F.col("nb") * ratio[1] >= F.col("na") * ratio[0])
    enough = (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1) * (ratio[0] + ratio[1]) >= (F.col("na") + F.col("nb")) * ratio[0]
    return a.join(b, "v").filter((F.col("a") < F.col("b")) & close & enough).select("a", "b").distinct()


def containment_candidates(rows: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """Pairs in which a rare value of the smaller set stands anywhere in the larger one."""
    small = rows.filter(F.col("at") <= _prefix(F.col("n"), *ratio)).select("v", F.col("k").alias("s"), F.col("n").alias("ns"), F.col("at").alias("ps"))
    # Of the larger sets only values that some smaller one begins with can meet.
    large = rows.join(small.select("v").distinct(), "v", "left_semi").select("v", F.col("k").alias("l"), F.col("n").alias("nl"))
    met = small.join(large, "v").filter((F.col("s") != F.col("l")) & (F.col("ns") <= F.col("nl")))
    return met.filter((F.col("ns") - F.col("ps") + 1) * ratio[1] >= F.col("ns") * ratio[0]).select(F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b")).distinct()


def similar_pairs(bodies: DataFrame, key: str = "sym_seq", targets: DataFrame | None = None) -> DataFrame:
    """(a, b, kind, exact, structural, contained): duplicate, structural or modified-copy pairs of bodies.

    bodies: key, file, qualname, exact, normalized, tokens. With targets, a column of keys, only pairs with a target.
    Null sets are in no pair; repeated keys count once. Bodies of equal sets are compared with others once and carried over
    to one another.
    """
    digest = F.md5(F.concat_ws("/", *[F.array_join(F.sort_array(c), ",") for c in ("exact", "normalized")]))
    rows = bodies.select(F.col(key).alias("key"), "file", "qualname", "exact", "normalized", "tokens").dropna(subset=["key", "exact", "normalized"]).withColumn("digest", digest)
    # Of a group the largest text decides whether the group may hold a modified copy; each pair is judged by its own.
    sets = checkpoint(rows.groupBy("digest").agg(F.min("key").alias("key"), F.count_distinct("key").alias("n"), F.max("tokens").alias("most"), F.first("exact").alias("exact"), F.first("normalized").alias("normalized")))
    one = rows.select("key", "file", "qualname", "tokens", "digest").dropDuplicates(["key"])
    members = checkpoint(one.join(sets.filter("n > 1").select("digest", F.col("key").alias("rep"), "n"), "digest").select("rep", "key", "n"))
    exact = ranked(sets, "key", "exact")
    large = exact.join(sets.filter(F.col("most") >= COPY_TOKENS).select(F.col("key").alias("k")), "k", "left_semi")
    parts = [jaccard_candidates(exact, DUPLICATE), jaccard_candidates(ranked(sets, "key", "normalized"), STRUCTURAL), containment_candidates(large, COPY)]
    found = parts[0].union(parts[1]).union(parts[2]).distinct()
    side = lambda s: sets.select(F.col("key").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("exact", "normalized")])
    common = lambda c: F.size(F.array_intersect(f"{c}_a", f"{c}_b"))
    union = lambda c: F.size(F.array_union(f"{c}_a", f"{c}_b"))
    shares = [common("exact").alias("x"), union("exact").alias("xu"), common("normalized").alias("s"), union("normalized").alias("su"), F.least(F.size("exact_a"), F.size("exact_b")).alias("m")]
    compared = checkpoint(found.join(side("a"), "a").join(side("b"), "b").select("a", "b", *shares).filter(F.col("s") >= SHARED))
    alike = twins(members).join(sets.select(F.col("key").alias("rep"), F.size(F.array_distinct("exact")).alias("x"), F.size(F.array_distinct("normalized")).alias("s")), "rep")
    alike = alike.select("a", "b", "x", F.col("x").alias("xu"), "s", F.col("s").alias("su"), F.col("x").alias("m")).filter(F.col("s") >= SHARED)
    pairs = carried(compared, members).unionByName(alike)
    if targets is not None:
        wanted = targets.select(F.col(targets.columns[0]).alias("t")).distinct()
        pairs = pairs.join(wanted, F.col("a") == F.col("t"), "left_semi").union(pairs.join(wanted, F.col("b") == F.col("t"), "left_semi")).distinct()
    who = lambda s: one.select(F.col("key").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("file", "qualname", "tokens")])
    both = pairs.join(who("a"), "a").join(who("b"), "b")
    nested = (F.col("file_a") == F.col("file_b")) & (F.col("qualname_a").startswith(F.concat("qualname_b", F.lit("."))) | F.col("qualname_b").startswith(F.concat("qualname_a", F.lit("."))))
    at_least = lambda part, whole, r: (F.col(part) > 0) & (F.col(part) * r[1] >= F.col(whole) * r[0])
    copy = (F.least("tokens_a", "tokens_b") >= COPY_TOKENS) & ~F.coalesce(nested, F.lit(False)) & at_least("x", "m", COPY)
    kind = F.when(at_least("x", "xu", DUPLICATE), "duplicate").when(at_least("s", "su", STRUCTURAL), "structural").when(copy, "modified-copy")
    ratio = lambda p, w: F.round(F.when(F.col(w) > 0, F.col(p) / F.col(w)).otherwise(0.0), 6)
    return both.withColumn("kind", kind).filter("kind is not null").select("a", "b", "kind", ratio("x", "xu").alias("exact"), ratio("s", "su").alias("structural"), ratio("x", "m").alias("contained"))


def best_pairs(pairs: DataFrame, limit: int) -> DataFrame:
    """The pairs most alike, by exact and then structural similarity, then by key."""
    return pairs.orderBy(F.desc("exact"), F.desc("structural"), "a", "b").limit(limit)

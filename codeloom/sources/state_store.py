"""Keyed state in a shared folder: the newest row of each key.

A save writes a new generation whole and removes the ones before it; a generation without Spark's _SUCCESS file
does not count, so a save that died in the middle leaves the state as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _generations(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [(s.getPath().getName().removeprefix("generation="), s.getPath()) for s in fs.listStatus(root) if s.isDirectory()]
    return sorted((int(n), p.toString()) for n, p in found if n.isdigit() and fs.exists(path(p, "_SUCCESS")))


def load_state(spark: SparkSession, folder: str) -> DataFrame | None:
    """The state, or None before the first save."""
    made = _generations(spark, folder)
    return spark.read.parquet(made[-1][1]) if made else None


def save_state(rows: DataFrame, folder: str, keys: list[str]) -> None:
    """Put rows, one a key, in place of those of their keys."""
    spark = rows.sparkSession
    made = _generations(spark, folder)
    if made:
        rows = rows.unionByName(spark.read.parquet(made[-1][1]).join(rows.select(*keys), keys, "left_anti"))
    rows.write.mode("overwrite").parquet(f"{folder}/generation={made[-1][0] + 1 if made else 0}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    for _, old in made:
        path(old).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(old), True)

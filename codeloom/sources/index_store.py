"""The facts of a repository kept between runs.

An index is a folder of tables and a guard; the guard is written last, so an index that was not written to its
end does not count. It names the version of the facts and the root they are of: an index of another version or
root is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources import extract as E
from codeloom.sources import repository as S

VERSION = 2


def save_index(tables: dict[str, DataFrame], folder: str, root: str, version: int = VERSION) -> None:
    spark = next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
    guard = spark.createDataFrame([(version, root, sorted(tables))], "version int, root string, tables array<string>")
    guard.coalesce(1).write.mode("overwrite").json(f"{folder}/_guard")


def load_index(spark: SparkSession, folder: str, root: str, version: int = VERSION) -> dict[str, DataFrame] | None:
    """The tables of an index, or None if there is none of this version and root."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_guard/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    guard = spark.read.schema("version int, root string, tables array<string>").json(f"{folder}/_guard").first()
    if guard is None or guard["version"] != version or guard["root"] != root:
        return None
    return {name: spark.read.parquet(f"{folder}/{name}") for name in guard["tables"]}


def ensure_index(spark: SparkSession, root: str, folder: str, rebuild: bool = False) -> dict[str, DataFrame]:
    """The tables files and facts of a repository as it is now; facts of files that did not change are not made again.

    The new index is written beside the old one, to the folder's other half, and read from there.
    """
    halves = [f"{folder}/a", f"{folder}/b"]
    old = None if rebuild else next((i for h in halves if (i := load_index(spark, h, root))), None)
    target = halves[1] if old is not None and load_index(spark, halves[0], root) is not None else halves[0]
    files = S.inventory(S.read_repository(spark, root)).withColumn("index_version", F.lit(VERSION))
    wanted = files.filter(F.col("language").isin(*E.EXTRACTORS) & F.col("text").isNotNull())
    if old is not None:
        wanted = S.to_extract(wanted, old["files"].select("path", "size", "mtime_ns", "sha1", "index_version"), VERSION)
    facts = E.extract(wanted)
    if old is not None:
        facts = S.merged_facts(facts, old["facts"], files)
    save_index({"files": files.drop("text"), "facts": facts}, target, root)
    for half in halves:
        if half != target:
            path = spark._jvm.org.apache.hadoop.fs.Path(half)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return load_index(spark, target, root)

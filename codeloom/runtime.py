"""Session, reading, and lineage helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("codeloom")
    defaults = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.adaptive.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's; where none is set, one of this machine if it is all there is."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("intermediate tables need a folder that all executors share: set spark.checkpoint.dir")
    return f"{named or os.path.join(tempfile.gettempdir(), 'codeloom-checkpoints')}/codeloom-{spark.sparkContext.applicationId}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the folder that all executors share.

    A written table is read with its true size. RDD checkpoints keep the size estimate of the plan they cut, and over a few
    rounds of joins that estimate, a product of products, outgrows the driver's memory. The tables go when the process ends,
    or before: one by one by ``release``, or all that are made inside of ``scratch``.
    """
    spark = df.sparkSession
    folder = _shared_folder(spark)
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    done = spark.read.schema(df.schema).parquet(path)
    done._codeloom_table = path
    for made in _scratches:
        made.append(path)
    return done


_folders: set[str] = set()
_scratches: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are removed at the end; results must have been written before."""
    made: list[str] = []
    _scratches.append(made)
    try:
        yield
    finally:
        _scratches.remove(made)
        for path in made:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone, and the folder with it
        pass


def release(*tables: DataFrame) -> None:
    """Remove tables written by ``checkpoint`` from which nothing more will be read."""
    for df in tables:
        if path := getattr(df, "_codeloom_table", None):
            _remove(df.sparkSession, path)


def scan(tables: list[DataFrame]) -> DataFrame:
    """All rows of tables of one schema written by ``checkpoint``, by one scan, however many they are."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t._codeloom_table for t in tables])


def checkpoint_counting(df: DataFrame, condition: Column | None = None) -> tuple[DataFrame, int]:
    """A checkpoint, and how many of its rows meet the condition, counted as they are written."""
    seen = Observation()
    counted = F.count(F.lit(1)) if condition is None else F.count(F.when(condition, F.lit(1)))
    done = checkpoint(df.observe(seen, counted.alias("n")))
    return done, int(seen.get["n"])


def spread(df: DataFrame) -> DataFrame:
    """Rows for work that is heavy on each of them: if a table comes in fewer parts than there are cores, dealt out to all.

    A table in more parts stays as it is, without a shuffle; so does what is not read straight from a table.
    """
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return df
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)


def dense_rank(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """The rows numbered from 1 in a total order, without bringing them into one task.

    They are sorted by ranges; a range is numbered in itself, and on from the rows of the ranges before it, of which
    there is one count each.
    """
    placed = checkpoint(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_before", "_at")


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that ``body`` uses it many times but it is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


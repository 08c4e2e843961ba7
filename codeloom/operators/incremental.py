"""Processing only new or changed records.

The method: a run rereads from the oldest transaction that was open when the last good run read, and
anti-joins key-and-version pairs against the ledger of what that run processed, which removes the
overlap. A failed run leaves no ledger, so its records come again; a good one leaves its own.

``changed_since_last_good`` replays a whole history of runs at once; ``Ledger`` keeps the state of one
history in a shared folder, run by run. Both use the same low-water mark and the same anti-join.

Defined results: rows with a null key or a null in a required part of the version are ignored; nulls in
its other parts equal one another; of several rows of a key in a run, the one with the largest order value
stands (nulls last, ties by the greatest version); a row without a clock value is always reread; repeated
rows count once; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.runtime import checkpoint


def standing(records: DataFrame, keys: list[str], version: list[str], order: str) -> DataFrame:
    """Of each key the one row that stands: (keys, version)."""
    rank = F.struct(F.col(order).isNotNull(), F.col(order), *version)
    return records.groupBy(*keys).agg(F.max_by(F.struct(*version), rank).alias("_v")).select(*keys, *[F.col(f"_v.{v}").alias(v) for v in version])


def good_runs(runs: DataFrame, run: str = "run_id", status: str = "status", good: str = "ok") -> DataFrame:
    """Each good run with the good run before it: (run, before)."""
    ok = runs.filter((F.col(status) == good) & F.col(run).isNotNull()).select(F.col(run).alias("run")).distinct()
    return ok.withColumn("before", F.lag("run").over(Window.orderBy("run"))).filter("before is not null")


def low_water_marks(runs: DataFrame, run: str = "run_id", started: str = "started_at", finished: str = "finished_at") -> DataFrame:
    """(run, before, open_from) of each good run with one before it: when the oldest transaction began that was open as that one read.

    A run that never finished is open from its start on; one without a start is open from ever, and its mark is null. The
    table of runs is small: one row a run.
    """
    spans = runs.select(F.col(run).alias("run"), F.col(started).alias("_s"), F.col(finished).alias("_f")).distinct()
    pairs = good_runs(runs, run)
    read = pairs.join(spans.select(F.col("run").alias("before"), F.col("_s").alias("_from"), F.col("_f").alias("_to")), "before")
    met = read.join(spans.select("_s", "_f"), (F.coalesce(F.col("_s") <= F.col("_to"), F.lit(True))) & F.coalesce(F.col("_f") >= F.col("_from"), F.lit(True)))
    return met.groupBy("run", "before").agg(F.when(F.max(F.col("_s").isNull()), None).otherwise(F.min("_s")).alias("open_from"))


def changed_since_last_good(records: DataFrame, runs: DataFrame, run: str, key: str, version: list[str], required: str, order: str, clock: str | None = None) -> DataFrame:
    """For each good run that has one before it, the keys that are new or of another version since.

    Returns distinct (run, key). ``required`` names the version column whose nulls void a row. With ``clock``, the time at
    which a record was written, a run reads from its low-water mark on.
    """
    pairs = checkpoint(low_water_marks(runs, run)) if clock else good_runs(runs, run)  # a row a run, used four times
    rows = records.filter(F.col(required).isNotNull() & F.col(key).isNotNull())
    wanted = pairs.select("run").unionByName(pairs.select(F.col("before").alias("run"))).distinct()
    rows = rows.join(wanted.withColumnRenamed("run", run), run, "left_semi")
    if clock:
        rows = rows.join(pairs.select(F.col("run").alias(run), "open_from"), run, "left")
        rows = rows.filter(F.col("open_from").isNull() | F.col(clock).isNull() | (F.col(clock) >= F.col("open_from")))
    # What a run has read is what it commits; one pass gives both, for the run itself and as the ledger of the next.
    seen = standing(rows, [run, key], version, order)
    reread = seen.join(pairs.select(F.col("run").alias(run)), run)
    ledger = seen.join(pairs.select("run", F.col("before").alias(run)), run).drop(run).withColumnRenamed("run", run)
    return without_processed(reread, ledger, [run, key], version).select(run, key)


def without_processed(records: DataFrame, ledger: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Records whose key-and-version pair is not in the ledger; null versions equal one another."""
    done = ledger.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(v).alias(f"_v{i}") for i, v in enumerate(version)])
    same = [records[k] == done[f"_k{i}"] for i, k in enumerate(keys)] + [records[v].eqNullSafe(done[f"_v{i}"]) for i, v in enumerate(version)]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    return records.join(done, condition, "left_anti")


class Ledger:
    """A ledger of the last processed version of each key, in a shared folder.

    ``pending`` gives what is to do, ``commit`` records what was done. A commit is a folder written
    whole, numbered and named by its run; without Spark's _SUCCESS file it does not count, so a run that
    died in the middle is repeated whole, and a run that committed never again. ``compact`` merges all
    commits into one, which stands for those before it. ``required`` are the parts of the version that may
    not be null: the first, if not given.
    """

    def __init__(self, spark, path: str, keys: list[str], version: list[str], required: list[str] | None = None):
        self.spark, self.path, self.keys, self.version, self.required = spark, path.rstrip("/"), keys, version, required or version[:1]

    def _files(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def _commits(self) -> list[tuple[int, str, str]]:
        """(number, run, folder) of the commits that count, the last merged one first."""
        path, fs, root = self._files()
        if not fs.exists(root):
            return []
        found = []
        for s in fs.listStatus(root):
            number, _, run = s.getPath().getName().removeprefix("commit=").partition("-")
            if s.isDirectory() and number.isdigit() and fs.exists(path(s.getPath(), "_SUCCESS")):
                found.append((int(number), run, s.getPath().toString()))
        found.sort()
        merged = max((i for i, (_, run, _) in enumerate(found) if run == "merged"), default=0)
        return found[merged:]

    def _read(self, commits: list[tuple[int, str, str]]) -> DataFrame:
        rows = [self.spark.read.parquet(folder).select(*self.keys, *self.version, "_runs", F.lit(number).alias("_at"), "_open_from") for number, _, folder in commits]
        return reduce(DataFrame.unionByName, rows)

    def processed(self) -> DataFrame | None:
        """The pairs of each key's last commit."""
        commits = self._commits()
        if not commits:
            return None
        rows = self._read(commits)
        last = rows.groupBy(*self.keys).agg(F.max("_at").alias("_at"))
        return rows.join(last, [*self.keys, "_at"], "left_semi").dropna(subset=self.keys).select(*self.keys, *self.version).distinct()

    def low_water(self) -> object:
        """The oldest transaction open when the last good run read, or None before any."""
        commits = self._commits()
        return self._read(commits[-1:]).agg(F.max("_open_from")).first()[0] if commits else None

    def pending(self, records: DataFrame, clock: str) -> DataFrame:
        """Records from the low-water mark on whose version is not the last committed of their key.

        Of a key the row that stands counts, over all rows, so a version passed by is not given out after its successor,
        and one that comes back is.
        """
        mark, done = self.low_water(), self.processed()
        rank = F.struct(F.col(clock).isNotNull(), F.col(clock), *self.version)
        rows = records.dropna(subset=[*self.keys, *self.required]).groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(self.keys)]).agg(F.max_by(F.struct(*records.columns), rank).alias("_row")).select("_row.*")
        if mark is not None:
            rows = rows.filter(F.col(clock).isNull() | (F.col(clock) >= F.lit(mark)))
        return rows if done is None else without_processed(rows, done, self.keys, self.version)

    def commit(self, run: str, records: DataFrame, open_from: object) -> None:
        """Record a run's pairs, once; open_from is the clock of the oldest transaction open as it read."""
        commits = self._commits()
        if run in {*[r for _, r, _ in commits], *self._merged_runs(commits)}:
            return
        # A row without a key carries the mark, so that a run without records leaves one too.
        mark = records.sparkSession.range(1).select(*[F.lit(None).cast(records.schema[c].dataType).alias(c) for c in (*self.keys, *self.version)])
        rows = records.select(*self.keys, *self.version).unionByName(mark).select("*", F.array(F.lit(run)).alias("_runs"), F.lit(open_from).alias("_open_from"))
        self._write(rows, commits[-1][0] + 1 if commits else 0, run)

    def _write(self, rows: DataFrame, number: int, run: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/commit={number:012d}-{run}")

    def _merged_runs(self, commits: list[tuple[int, str, str]]) -> list[str]:
        if not commits or commits[0][1] != "merged":
            return []
        row = self._read(commits[:1]).filter(F.col(self.keys[0]).isNull()).select("_runs").first()
        return list(row[0]) if row else []

    def compact(self) -> None:
        """Merge all commits into one, and remove those it stands for."""
        commits = self._commits()
        if len(commits) < 2:
            return
        runs, mark = [*self._merged_runs(commits), *[r for _, r, _ in commits if r != "merged"]], self.low_water()
        done = self.processed()
        last = done.sparkSession.range(1).select(*[F.lit(None).cast(done.schema[c].dataType).alias(c) for c in (*self.keys, *self.version)])
        self._write(done.unionByName(last).select("*", F.array(*map(F.lit, runs)).alias("_runs"), F.lit(mark).alias("_open_from")), commits[-1][0] + 1, "merged")
        path, fs, _ = self._files()
        for _, _, folder in commits:
            fs.delete(path(folder), True)


__all__ = ["Ledger", "changed_since_last_good", "good_runs", "low_water_marks", "standing", "without_processed"]

"""Repositories as tables: a walk in a fixed order, configuration, notes and logs as JSON lines, and diffs from git."""

from __future__ import annotations

import fnmatch
import os
import subprocess
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file_seq long, path string, size long, mtime_ns long, is_text boolean, content binary"
PROBE = 4096


@dataclass(frozen=True)
class Config:
    """What a walk leaves out."""

    exclude_dirs: tuple[str, ...] = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".mypy_cache", ".pytest_cache")
    exclude_globs: tuple[str, ...] = ("*.pyc", "*.lock")


def load_config(root: str, name: str = "codeloom.toml") -> Config:
    """The file's lists replace the defaults; lists named extra_... are added."""
    path, config = os.path.join(root, name), Config()
    if not os.path.isfile(path):
        return config
    with open(path, "rb") as f:
        given = tomllib.load(f)
    for key in ("exclude_dirs", "exclude_globs"):
        values = tuple(given.get(key, getattr(config, key))) + tuple(given.get(f"extra_{key}", ()))
        config = replace(config, **{key: values})
    return config


def excluded_dir(rel: str, config: Config) -> bool:
    return rel.rpartition("/")[2] in config.exclude_dirs or any(fnmatch.fnmatch(rel, g.rstrip("/")) for g in config.exclude_globs if g.endswith("/"))


def excluded_file(rel: str, config: Config) -> bool:
    return any(fnmatch.fnmatch(rel.rpartition("/")[2], g) or fnmatch.fnmatch(rel, g) for g in config.exclude_globs)


def walk(root: str, config: Config) -> Iterator[str]:
    """Relative paths: a folder's files before its folders, both sorted; links and excluded folders are not entered."""
    for folder, dirs, files in os.walk(root):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        rel = "" if rel == "." else rel + "/"
        dirs[:] = sorted(d for d in dirs if not os.path.islink(os.path.join(folder, d)) and not excluded_dir(rel + d, config))
        yield from (rel + f for f in sorted(files) if not os.path.islink(os.path.join(folder, f)) and not excluded_file(rel + f, config))


class Part(InputPartition):
    def __init__(self, first: int, paths: list[str]):
        self.first, self.paths = first, paths


class RepositoryReader(DataSourceReader):
    """Lists on the driver, reads contents on the executors; the folder must be one that all can read."""

    def __init__(self, options: dict[str, str]):
        self.root, self.size = options["path"], int(options.get("filesPerPartition", "200"))

    def partitions(self) -> list[Part]:
        paths = list(walk(self.root, load_config(self.root)))
        return [Part(i, paths[i : i + self.size]) for i in range(0, len(paths), self.size)] or [Part(0, [])]

    def read(self, partition: Part) -> Iterator[tuple]:
        for i, rel in enumerate(partition.paths):
            full = os.path.join(self.root, rel)
            try:
                at = os.stat(full)
                with open(full, "rb") as f:
                    content = f.read()
            except OSError:
                continue
            yield partition.first + i, rel, at.st_size, at.st_mtime_ns, b"\x00" not in content[:PROBE], content


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepositoryReader:
        return RepositoryReader(self.options)


def read_repository(spark: SparkSession, root: str) -> DataFrame:
    """The files of a repository with their SHA-1 and, where they are text, their text."""
    spark.dataSource.register(RepositorySource)
    rows = spark.read.format("repo").load(root)
    text = F.when(F.col("is_text"), F.decode("content", "UTF-8"))
    return rows.select("file_seq", "path", "size", "mtime_ns", "is_text", F.sha1("content").alias("sha1"), text.alias("text"))


def inventory(files: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """The files with language, kind, reason, lines and, where roots (root) are given, the project that each lies in."""
    from codeloom.functions import text as X
    from codeloom.operators.relational import longest_prefix

    rows = files.withColumn("language", X.language_of(F.col("path")))
    kind = X.classify(F.col("path"), F.col("language"), X.header_of(F.coalesce("text", F.lit(""))), F.col("is_text"))
    rows = rows.withColumn("_k", kind).select("*", "_k.kind", "_k.reason", X.line_count(F.col("text")).alias("lines")).drop("_k")
    return rows if roots is None else longest_prefix(rows, "path", roots, roots.columns[0], "project")


def project_roots(files: DataFrame) -> DataFrame:
    """(root): the folders that hold a manifest; ``.`` for the top one."""
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")
    return files.filter("kind = 'manifest'").select(folder.alias("root")).distinct()


def to_extract(files: DataFrame, state: DataFrame, version: int) -> DataFrame:
    """Files whose facts cannot be reused: no row of this index version has their size and time, or else their SHA-1."""
    same = state.filter(F.col("index_version") == version)
    by_stat = files.join(same.select("path", "size", "mtime_ns"), ["path", "size", "mtime_ns"], "left_anti")
    return by_stat.join(same.select("path", "sha1"), ["path", "sha1"], "left_anti")


def merged_facts(fresh: DataFrame, old: DataFrame, files: DataFrame) -> DataFrame:
    """The facts (file, ...) of the files there are: the fresh ones, and for all other files those of before."""
    kept = old.join(fresh.select("file"), "file", "left_anti").join(files.select(F.col("path").alias("file")), "file", "left_semi")
    return fresh.unionByName(kept)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines file, and its lines that are no objects of the schema."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.withColumn("_r", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    names = [f.name for f in parsed.schema["_r"].dataType.fields if f.name != "_corrupt"]
    return parsed.filter(~bad).select(*[F.col(f"_r.{n}").alias(n) for n in names]), parsed.filter(bad).select("value")


def as_json_lines(rows: DataFrame, key: str) -> DataFrame:
    """(key, value): rows as JSON without empty fields, for a text sink sorted by key."""
    kept: list[Column] = [F.when(F.size(c) > 0, F.col(c)).alias(c) if t.startswith("array") else F.when(F.col(c) != "", F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    return rows.select(F.col(key), F.to_json(F.struct(*kept)).alias("value"))


def merged_handoff(old: DataFrame, new: DataFrame, key: str, lists: list[str], scalars: list[str]) -> DataFrame:
    """New values over old ones: scalars replace, lists append what is not there yet."""
    from codeloom.operators.relational import append_unique

    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in (*lists, *scalars)])
    met = old.join(n, key, "full_outer")
    return met.select(key, *[append_unique(F.col(c), F.col(f"_{c}")).alias(c) for c in lists], *[F.coalesce(f"_{c}", c).alias(c) for c in scalars])


def content_map(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def tree_signature(status: DataFrame, path: str = "path", mtime: str = "mtime_ns") -> DataFrame:
    """(signature): one hash over the paths and times of a changed tree, by path."""
    rows = status.select(F.concat_ws("\t", F.col(path), F.col(mtime).cast("string")).alias("r"))
    return rows.agg(F.sha1(F.array_join(F.sort_array(F.collect_list("r")), "\n").cast("binary")).alias("signature"))


def git_lines(root: str, *args: str) -> list[str]:
    """Lines of a git command's output, run on the driver; none if git fails."""
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60)
    return done.stdout.splitlines() if done.returncode == 0 else []


def git_changes(spark: SparkSession, root: str, base: str | None = None, staged: bool = False) -> DataFrame:
    """(path, status, added, removed, whitespace_only, old_path, kind, language): the change of a work tree.

    Against a base, staged, or, with neither, everything against HEAD, untracked files included. git runs on the driver; its
    lines are parsed as columns.
    """
    from codeloom.functions import text as X
    from codeloom.operators import changes as C

    against = [base] if base else ["--cached"] if staged else ["HEAD"]
    frame = lambda lines: spark.createDataFrame([(x,) for x in lines], "row string")
    counts = lambda *more: frame(git_lines(root, "diff", "-M", *more, "--numstat", *against)).select(C.numstat(F.col("row")).alias("n")).select("n.*")
    parts = F.split("row", "\t")
    named = frame(git_lines(root, "diff", "-M", "--name-status", *against)).select(F.substring(F.get(parts, 0), 1, 1).alias("status"), F.element_at(parts, -1).alias("path"), F.when(F.col("row").startswith("R"), F.get(parts, 1)).otherwise("").alias("old_path"))
    bare = counts("-w").select("path", F.col("added").alias("_w"))
    rows = named.join(counts(), "path", "left").join(bare, "path", "left")
    rows = rows.select("path", "status", F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("removed", F.lit(0)).alias("removed"), C.whitespace_only(F.coalesce("added", F.lit(0)), F.col("_w")).alias("whitespace_only"), "old_path")
    if not base and not staged:
        fresh = []
        for rel in git_lines(root, "ls-files", "--others", "--exclude-standard"):
            with open(os.path.join(root, rel), "rb") as f:
                content = f.read()
            if b"\x00" not in content:
                fresh.append((rel, "A", content.count(b"\n") + (1 if content and not content.endswith(b"\n") else 0), 0, 0, ""))
        rows = rows.unionByName(spark.createDataFrame(fresh, "path string, status string, added int, removed int, whitespace_only int, old_path string"))
    rows = rows.withColumn("language", X.language_of(F.col("path")))
    return rows.withColumn("kind", X.classify(F.col("path"), F.col("language"), F.lit(""), F.lit(True))["kind"])

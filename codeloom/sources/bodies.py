"""Operators over the text of functions and files: bodies, wrappers, guarded calls, comments and imports from outside.

Each reads a text once. Null texts have nothing; repeated rows give repeated rows unless a docstring says otherwise.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.runtime import spread
from codeloom.sources import python_code

LEAST_TOKENS = 25


def function_bodies(symbols: DataFrame, files: DataFrame, key: str = "sym_seq") -> DataFrame:
    """(key, file, qualname, body): the lines of each symbol after that of its declaration, up to its last.

    symbols: key, file, qualname, line, end_line; files: path, text. The places of a file's symbols are joined to its text
    at once, so a text moves once and not once a symbol. Symbols without a last line, or of files without text, are left out;
    repeated keys count once.
    """
    place = F.struct(F.col(key).alias("key"), "qualname", "line", "end_line")
    wanted = symbols.filter("line is not null and end_line is not null and file is not null").dropDuplicates([key])
    places = wanted.groupBy(F.col("file").alias("path")).agg(F.collect_list(place).alias("places"))
    met = files.select("path", "text").filter("text is not null").join(places, "path")

    def cut(lines, p):
        return F.array_join(F.slice(lines, p["line"] + 1, F.greatest(p["end_line"] - p["line"], F.lit(0))), "\n")

    rows = met.select("path", X.let(X.lines_of(F.col("text")), lambda lines: F.transform("places", lambda p: F.struct(p["key"].alias("key"), p["qualname"].alias("qualname"), cut(lines, p).alias("body")))).alias("bodies"))
    return rows.select(F.col("path").alias("file"), F.explode("bodies").alias("b")).select(F.col("b.key").alias(key), "file", "b.qualname", "b.body")


def collected_bodies(symbols: DataFrame, files: DataFrame, key: str = "sym_seq", least: int = LEAST_TOKENS) -> DataFrame:
    """(key, file, qualname, exact, normalized, tokens) of functions and methods of at least so many tokens."""
    rows = function_bodies(symbols.filter(F.col("kind").isin("function", "method")), files, key)
    tokens = rows.select(key, "file", "qualname", X.code_tokens(F.col("body")).alias("t")).filter(F.size("t") >= least)
    return tokens.select(key, "file", "qualname", X.shingles(F.col("t")).alias("exact"), X.shingles(X.normalised(F.col("t"))).alias("normalized"), F.size("t").alias("tokens"))


def _rows_of_python(files: DataFrame, read: Callable[[str], Iterator[dict]], fields: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """(path, fields...): what a reader finds in the text of each Python file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for row in read(text) or ():
                    at.append(i)
                    rows.append(row)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array([r[name] for r in rows], kind) for name, kind in fields]]
            yield pa.RecordBatch.from_arrays(columns, names=["path", *[name for name, _ in fields]])

    wanted = files.filter(F.col("text").isNotNull() & X.suffix_of(F.col("path")).isin(".py", ".pyi")).select("path", "text")
    return spread(wanted).mapInArrow(run, f"path string, {schema}")


def thin_wrappers(files: DataFrame) -> DataFrame:
    """(path, name, line, callee): Python functions that only return a call of another with their own parameters."""
    return _rows_of_python(files, python_code.thin_wrappers, [("name", pa.string()), ("line", pa.int32()), ("callee", pa.string())], "name string, line int, callee string")


def guarded_calls(files: DataFrame) -> DataFrame:
    """(path, func, params, callee, unconditional, guards): each call of each Python function, and what it hangs on."""
    fields = [("func", pa.string()), ("params", pa.list_(pa.string())), ("callee", pa.string()), ("unconditional", pa.bool_()), ("guards", pa.list_(pa.string()))]
    return _rows_of_python(files, python_code.guarded_calls, fields, "func string, params array<string>, callee string, unconditional boolean, guards array<string>")


def markers(files: DataFrame) -> DataFrame:
    """(path, line, text): markers such as TODO, in Python in real comments only, if the file has tokens to its end."""

    def comments(text: str) -> Iterator[dict]:
        found = python_code.comments(text)
        yield {"line": None, "comment": None} if found is None else {"line": -1, "comment": ""}
        yield from ({"line": c["line"], "comment": c["text"]} for c in found or ())

    read = _rows_of_python(files, comments, [("line", pa.int32()), ("comment", pa.string())], "line int, comment string")
    whole = read.filter("line = -1").select("path").distinct()
    wanted = read.filter(F.col("line") > 0).filter(F.col("comment").rlike(rf"^#+\s*{X._MARK}(?![\w/-])")).select("path", "line").distinct()
    native = files.filter("text is not null").select("path", F.explode(X.marker_lines(F.col("path"), F.col("text"))).alias("m")).select("path", "m.line", "m.text").distinct()
    return native.join(whole, "path", "left_anti").unionByName(native.join(whole, "path", "left_semi").join(wanted, ["path", "line"], "left_semi").select("path", "line", "text"))


def added_markers(files: DataFrame, added: DataFrame, new_files: DataFrame) -> DataFrame:
    """(path, line, text): markers on added lines (path, line), and all of new files (path)."""
    fresh = new_files.select("path").distinct()
    some = files.join(added.select("path").union(fresh).distinct(), "path", "left_semi")
    found = markers(some)
    return found.join(fresh, "path", "left_semi").unionByName(found.join(fresh, "path", "left_anti").join(added.select("path", "line").distinct(), ["path", "line"], "left_semi").select("path", "line", "text"))


def foreign_imports(imports: DataFrame) -> DataFrame:
    """Imports of Python modules that are neither of the workspace nor of the standard library."""
    session = imports.sparkSession
    known = session.createDataFrame([(m,) for m in sorted(sys.stdlib_module_names)], "_m string")
    outside = imports.filter(F.col("resolved").isNull() & ~F.coalesce(F.col("is_relative"), F.lit(False)))
    return outside.withColumn("_m", F.split_part("module", F.lit("."), F.lit(1))).join(F.broadcast(known), "_m", "left_anti").drop("_m")


__all__ = ["added_markers", "collected_bodies", "foreign_imports", "function_bodies", "guarded_calls", "markers", "thin_wrappers"]

"""Extraction of source text to tables: one pass in Python, everything after it native.

A registry names the extractor of each language; a language without one gives a status row of unknown
confidence, never an empty success. Null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import relational as R
from codeloom.runtime import spread
from codeloom.sources import python_code, script_code
from codeloom.sources.python_code import Facts

EXTRACTORS: dict[str, Callable[[str], Facts]] = {"python": python_code.facts, "javascript": script_code.facts, "typescript": script_code.facts}

#: Files whose facts are held at once.
SLICE = 128

_S, _I, _B = pa.string(), pa.int32(), pa.bool_()
_PARTS = {
    "symbols": pa.struct([("name", _S), ("kind", _S), ("line", _I), ("qualname", _S), ("end_line", _I), ("parent", _S), ("signature", _S), ("exported", _B), ("doc", _S)]),
    "imports": pa.struct([("module", _S), ("level", _I), ("bindings", pa.list_(pa.struct([("name", _S), ("alias", _S)]))), ("line", _I)]),
    "uses": pa.struct([("use_kind", _S), ("name", _S), ("line", _I), ("scope", _S), ("receiver", _S)]),
    "bases": pa.struct([("qualname", _S), ("base", _S), ("line", _I), ("relation", _S)]),
}
_SCHEMA = (
    "file string, language string, confidence string, error string, exports array<string>, "
    "symbols array<struct<name:string,kind:string,line:int,qualname:string,end_line:int,parent:string,signature:string,exported:boolean,doc:string>>, "
    "imports array<struct<module:string,level:int,bindings:array<struct<name:string,alias:string>>,line:int>>, "
    "uses array<struct<use_kind:string,name:string,line:int,scope:string,receiver:string>>, "
    "bases array<struct<qualname:string,base:string,line:int,relation:string>>"
)


def extract(files: DataFrame, path: str = "path", language: str = "language", text: str = "text") -> DataFrame:
    """One row a file: its status and its facts as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                paths, languages, texts = (batch.column(i).to_pylist() for i in range(3))
                got = []
                for lang, source in zip(languages, texts):
                    extractor = EXTRACTORS.get(lang or "")
                    got.append(extractor(source or "") if extractor else Facts(confidence="unknown", error=""))
                columns = [pa.array(paths, _S), pa.array(languages, _S), pa.array([g.confidence for g in got], _S), pa.array([g.error for g in got], _S), pa.array([g.exports for g in got], pa.list_(_S))]
                columns += [pa.array([getattr(g, name) for g in got], pa.list_(kind)) for name, kind in _PARTS.items()]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "language", "confidence", "error", "exports", *_PARTS])

    return spread(files.select(F.col(path), F.col(language), F.col(text))).mapInArrow(run, _SCHEMA)


def status(facts: DataFrame) -> DataFrame:
    return facts.select("file", "language", "confidence", "error", "exports")


def rows_of(facts: DataFrame, part: str, seq: str) -> DataFrame:
    """The facts of one kind as rows, with their place in the file; file and place together are a key."""
    fields = [f.name for f in facts.schema[part].dataType.elementType.fields]
    rows = facts.select("file", "language", "confidence", F.posexplode(part).alias("_at", "_r"))
    return rows.select(F.col("_at").alias(seq), "file", "language", "confidence", *[F.col(f"_r.{f}").alias(f) for f in fields])


def resolved_imports(facts: DataFrame, paths: DataFrame, path: str = "path") -> DataFrame:
    """(file, import_seq, module, bindings, line, resolved, confidence, is_relative): each import with the first file it may mean.

    A Python ``from package import name`` whose name is a module of its own becomes an import of that module.
    """
    known = paths.select(F.col(path).alias("_c")).distinct()
    specs = rows_of(facts, "imports", "import_seq").select(F.concat_ws(":", "import_seq", "file").alias("_id"), "import_seq", "file", "module", "level", "bindings", "line")
    named = specs.filter("level >= 0").select("_id", "import_seq", "file", "module", "level", "line", F.posexplode_outer("bindings").alias("_n", "b"))
    joined = F.when(F.col("module") == "", F.col("b.name")).otherwise(F.concat_ws(".", "module", F.col("b.name")))
    named = named.withColumn("_sub", F.when(F.col("b.name").isNotNull() & (F.col("b.name") != "*"), joined)).withColumn("_id", F.concat_ws(":", F.col("_n").cast("string"), "_id"))
    named = named.withColumn("_cand", R.module_candidates(F.col("file"), F.col("module"), F.col("level"))).withColumn("_subs", F.when(F.col("_sub").isNotNull(), R.module_candidates(F.col("file"), F.col("_sub"), F.col("level"))))
    named = R.first_match(R.first_match(named, "_cand", known, "_c", "_whole"), "_subs", known, "_c", "_part")
    part = F.col("_part").isNotNull() & ~F.coalesce(F.col("_part") == F.col("_whole"), F.lit(False))
    python = named.select("file", "import_seq", "_n", F.when(part, F.col("_sub")).otherwise(F.col("module")).alias("module"), "line", F.when(part, F.struct(F.lit(None).cast("string").alias("name"), F.col("b.alias").alias("alias"))).otherwise(F.col("b")).alias("b"), F.when(part, F.col("_part")).otherwise(F.col("_whole")).alias("resolved"), (F.col("level") > 0).alias("is_relative"))
    python = python.groupBy("file", "import_seq", "module", "line", "resolved", "is_relative").agg(F.sort_array(F.collect_list(F.struct("_n", "b"))).alias("bs")).withColumn("bindings", F.filter(F.transform("bs", lambda x: x["b"]), lambda b: b.isNotNull())).drop("bs")
    script = specs.filter("level < 0").withColumn("_cand", R.specifier_candidates(F.col("file"), F.col("module")))
    script = R.first_match(script, "_cand", known, "_c", "resolved").select("file", "import_seq", "module", "line", "resolved", F.col("module").startswith(".").alias("is_relative"), "bindings")
    both = python.unionByName(script)
    return both.select("file", "import_seq", "module", "bindings", "line", "resolved", F.when(F.col("resolved").isNotNull(), "confirmed").otherwise("inferred").alias("confidence"), "is_relative")

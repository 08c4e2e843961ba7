import json

from pyspark.sql import functions as F

from codeloom.operators import state as ST
from codeloom.plans import reports as P
from codeloom.sources import repository as S
from codeloom.streaming import evidence as V


def drain(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def stream(spark, tmp_path, rows, schema):
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = [("u", 1, 1, "s1"), ("u", 2, 0, "s1"), ("u", 3, 2, "s2"), ("u", 4, 1, "s2"), ("v", 1, 1, None)]
    schema = "k string, seq long, outstanding int, signature string"
    batch = {(r["k"], r["seq"]): (r["decision"], r["cached"]) for r in ST.stop_gate(spark.createDataFrame(rows, schema), "k", ["seq"]).collect()}
    got = {(r["key"], r["seq"]): (r["decision"], r["cached"]) for r in drain(spark, V.capped_gate(stream(spark, tmp_path, rows, schema), "k"), "gate").collect()}
    assert got == batch and got[("u", 4)][0] == "allow"


def test_stream_transitions(spark, tmp_path):
    rows = [("u", i, lv) for i, lv in enumerate(["low", "elevated", "elevated", "high", "low", "elevated"])]
    schema = "k string, seq long, level string"
    batch = {(r["seq"], r["from_level"]) for r in ST.transitions(spark.createDataFrame(rows, schema), "k", ["seq"], "level", ("low", "elevated", "high")).collect()}
    assert {(r["seq"], r["from_level"]) for r in drain(spark, V.level_transitions(stream(spark, tmp_path, rows, schema), "k"), "levels").collect()} == batch


def test_repository_walk_and_reuse(spark, tmp_path):
    for path, text in {"b.py": "x", "a/c.py": "y", "a/b/d.py": "z", "node_modules/q.js": "n", "bin.dat": "\x00", "a.lock": "l"}.items():
        full = tmp_path / "repo" / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text(text)
    files = S.read_repository(spark, str(tmp_path / "repo"))
    rows = files.orderBy("file_seq").collect()
    assert [r["path"] for r in rows] == ["b.py", "bin.dat", "a/c.py", "a/b/d.py"] and rows[1]["text"] is None and rows[0]["text"] == "x"
    state = files.filter("path <> 'a/c.py'").select("path", "size", "mtime_ns", "sha1", F.lit(3).alias("index_version"))
    assert [r["path"] for r in S.to_extract(files, state, 3).collect()] == ["a/c.py"] and S.to_extract(files, state, 4).count() == 4


def test_json_lines_and_notes(spark, tmp_path):
    cols = "id string, category string, statement string, status string, created string, updated string, expires string, superseded_by string, supersedes string, key string, evidence array<string>, paths array<string>, symbols array<string>, tags array<string>"
    note = {"category": "fact", "statement": "Retries use backoff", "status": "confirmed", "created": "2025-01-01", "updated": "2025-01-02", "evidence": ["x"], "paths": ["app/net"], "symbols": ["net.Retry"], "tags": ["net"], "key": "k"}
    notes = [note | {"id": "M-0001"}, note | {"id": "M-0002", "status": "temporary", "expires": "2025-01-05", "updated": "2025-02-01", "key": ""}, note | {"id": "M-3", "evidence": [], "superseded_by": "M-0009"}, note | {"id": "M-0004", "status": "superseded", "key": ""}]
    file = tmp_path / "notes.jsonl"
    file.write_text("\n".join([*map(json.dumps, notes), "{broken"]) + "\n")
    good, bad = S.read_json_lines(spark, str(file), cols)
    assert good.count() == 4 and bad.count() == 1
    problems = {(r["id"], r["problem"]) for r in P.note_problems(good, "2025-03-01").collect()}
    assert {("M-3", "id must look like M-0001"), ("M-3", "status needs evidence"), ("M-3", "dangling superseded_by"), ("M-0002", "expired"), ("M-0001", "conflict"), ("M-0004", "superseded items need superseded_by")} <= problems
    ranked = P.note_scores(good, "2025-01-03", text="backoff", path="app/net/x.py", symbol="Retry").collect()
    assert [(r["id"], r["score"]) for r in ranked] == [("M-0002", 16), ("M-0001", 16), ("M-3", 16)]
    assert "superseded_by" not in json.loads(S.as_json_lines(good, "id").filter("id = 'M-0001'").first()["value"])


def test_reports(spark):
    rows = spark.createDataFrame([("b", "confirmed"), ("a", "inferred")], "n string, c string")
    made = P.findings(rows, 1, "hit", F.col("n"), "warn", F.col("c"), F.array("n"), F.col("n"))
    assert [r["value"] for r in P.as_markdown(made).orderBy("seq").collect()][0] == "- [warn, inferred] hit: a\n  - a"
    assert json.loads(P.as_json(made).orderBy("seq").first()["value"])["kind"] == "hit"
    files = spark.createDataFrame([("a/pyproject.toml", "a"), ("a/x.py", "a"), ("b/package.json", "b")], "path string, project string")
    assert {tuple(r) for r in P.steps(files).collect()} == {("a", "pytest"), ("b", "npm test")}


def test_reconcile(spark):
    from codeloom.functions import text as X

    docs = spark.createDataFrame([(1, "Verification\n- pytest - PASS\n"), (2, "all tests pass"), (3, "nothing")], "k int, text string")
    claims = docs.select("k", X.model_claims(F.col("text")).alias("c")).select("k", "c.*")
    records = spark.createDataFrame([(1, True, True, "not verified")], "k int, ran boolean, fresh boolean, verdict string")
    assert {r["k"]: r["status"] for r in P.reconciled(claims, records, "k").collect()} == {1: "NOT VERIFIED", 2: "UNVERIFIED CLAIM", 3: "NO VERIFICATION"}


def test_stream_evidence_and_once(spark, tmp_path):
    from datetime import datetime, timedelta

    at = lambda m: datetime(2025, 1, 1) + timedelta(minutes=m)

    def source(name, rows, schema):
        folder = str(tmp_path / name)
        for i, row in enumerate(rows):  # a file a row, so that watermarks move
            spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    edits = [("u", at(50), 1), ("u", at(100), 2), ("v", at(10), 3), ("v", at(400), 4), ("v", at(900), 5)]
    activity = [("u", at(5), "a"), ("u", at(4), "b"), ("u", at(60), "c"), ("w", at(10), "d"), ("v", at(399), "e"), ("v", at(901), "f")]
    met = V.evidence_join(source("edits", edits, "k string, t timestamp, n int"), source("activity", activity, "k string, t timestamp, c string"), "k", "t")
    got = {(r["n"], r["activity_c"]) for r in drain(spark, met, "evidence").collect()}
    # Both ends of the 45 minutes count; what stays without evidence comes out once the watermark has passed it.
    assert {(1, "a"), (2, "c"), (4, "e")} <= got and not {(1, "b"), (1, "c"), (5, "f")} & got and (3, None) in got
    first = V.once(source("events", [("u", at(0)), ("u", at(1)), ("v", at(2)), ("u", at(40))], "k string, t timestamp"), "k", "t")
    assert sorted(r["k"] for r in drain(spark, first, "first").collect()) == ["u", "v"]

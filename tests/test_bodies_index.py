import subprocess

from pyspark.sql import functions as F

from codeloom.operators import changes as C
from codeloom.operators import relational as R
from codeloom.operators import state as ST
from codeloom.plans import reports as P
from codeloom.sources import bodies as B
from codeloom.sources import index_store as I
from codeloom.sources import repository as S
from codeloom.sources import state_store as T

PY = "import os\n\n\ndef load(path, mode):\n    return read(path, mode)\n\n\ndef check(x, strict):\n    if strict:\n        verify(x)\n    save(x)  # TODO: later\n    return 'TODO'\n"


def test_bodies_wrappers_guards_and_markers(spark):
    files = spark.createDataFrame([("a.py", PY, 1), ("b.js", "function f(a) {\n  // FIXME: x\n  return a;\n}\n", 2), ("c.py", None, 3), ("d.py", "", 4), ("e.py", "def f(:\n# TODO: bad\n", 5)], "path string, text string, sym_seq int")
    symbols = spark.createDataFrame([(1, "a.py", "load", "function", 4, 5), (2, "a.py", "check", "function", 8, 12), (3, "b.js", "f", "function", 1, 4), (4, "c.py", "g", "function", 1, 2), (5, "a.py", "X", "constant", 1, None), (2, "a.py", "check", "function", 8, 12), (6, "a.py", "odd", "function", 9, 3)], "sym_seq int, file string, qualname string, kind string, line int, end_line int")
    got = {r["sym_seq"]: r["body"] for r in B.function_bodies(symbols, files).collect()}
    assert got == {1: "    return read(path, mode)", 2: "\n".join(PY.split("\n")[8:12]), 3: "  // FIXME: x\n  return a;\n}", 6: ""}
    assert {r["sym_seq"] for r in B.collected_bodies(symbols, files, least=7).collect()} == {1, 2}
    assert [tuple(r) for r in B.thin_wrappers(files).collect()] == [("a.py", "load", 4, "read")]
    calls = {(r["func"], r["callee"]): (r["unconditional"], r["guards"]) for r in B.guarded_calls(files).collect()}
    assert calls[("check", "verify")] == (False, ["strict"]) and calls[("check", "save")] == (True, [])
    assert {(r["path"], r["line"]) for r in B.markers(files).collect()} == {("a.py", 11), ("b.js", 2), ("e.py", 2)}
    added = spark.createDataFrame([("a.py", 3), ("b.js", 2)], "path string, line int")
    assert {(r["path"], r["line"]) for r in B.added_markers(files, added, spark.createDataFrame([("e.py",)], "path string")).collect()} == {("b.js", 2), ("e.py", 2)}
    assert B.function_bodies(symbols.limit(0), files).count() == 0 and B.markers(files.limit(0)).count() == 0
    imports = spark.createDataFrame([("os.path", None, False), ("numpy.linalg", None, False), ("pkg", "pkg.py", False), ("", None, True)], "module string, resolved string, is_relative boolean")
    assert [r["module"] for r in B.foreign_imports(imports).collect()] == ["numpy.linalg"]


def test_bypasses_from_texts(spark):
    before = spark.createDataFrame([("a.py", "def f(x):\n    check(x)\n    save(x)\n")], "path string, text string")
    after = spark.createDataFrame([("a.py", "def f(x, fast):\n    if not fast:\n        check(x)\n")], "path string, text string")
    known = spark.createDataFrame([("check",), ("save",)], "name string")
    got = {(r["callee"], r["kind"]) for r in C.bypasses(B.guarded_calls(before), B.guarded_calls(after), known).collect()}
    assert got == {("check", "invariant-bypass"), ("save", "shared-call-removed")}


def test_index_is_kept_refreshed_and_guarded(spark, tmp_path):
    root, folder = tmp_path / "repo", str(tmp_path / "index")
    root.mkdir()
    (root / "a.py").write_text("def one():\n    pass\n")
    (root / "b.py").write_text("def two():\n    pass\n")
    first = I.ensure_index(spark, str(root), folder)
    assert first["facts"].count() == 2 and {r["kind"] for r in first["files"].collect()} == {"source"}
    (root / "a.py").unlink()
    (root / "b.py").write_text("def three():\n    return 1\n")
    (root / "c.py").write_text("x = 1\n")
    second = I.ensure_index(spark, str(root), folder)
    names = {s["name"] for r in second["facts"].collect() for s in r["symbols"]}
    assert names == {"three", "x"} and {r["file"] for r in second["facts"].collect()} == {"b.py", "c.py"}
    assert I.load_index(spark, f"{folder}/b", "other") is None and I.load_index(spark, f"{folder}/b", str(root), 99) is None and I.load_index(spark, f"{folder}/nowhere", str(root)) is None
    assert I.load_index(spark, f"{folder}/b", str(root)) is not None


def test_changes_of_a_work_tree(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "keep.py").write_text("a = 1\nb = 2\n")
    (tmp_path / "old.py").write_text("".join(f"x{i} = {i}\n" for i in range(30)))
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "keep.py").write_text("a  =  1\nb = 3\n")
    (tmp_path / "old.py").rename(tmp_path / "new.py")
    (tmp_path / "fresh.md").write_text("one\ntwo")
    git("add", "-A", "new.py", "old.py")
    rows = {r["path"]: r for r in S.git_changes(spark, str(tmp_path)).collect()}
    assert (rows["keep.py"]["status"], rows["keep.py"]["added"], rows["keep.py"]["whitespace_only"]) == ("M", 2, 1)
    assert rows["new.py"]["status"] == "R" and rows["new.py"]["old_path"] == "old.py" and rows["fresh.md"]["added"] == 2 and rows["fresh.md"]["kind"] == "docs"
    assert {r["path"] for r in S.git_changes(spark, str(tmp_path), staged=True).collect()} == {"new.py"}
    assert S.git_changes(spark, str(tmp_path / "none")).count() == 0


def test_steps_from_manifests(spark):
    rows = [
        ("a", "a/pyproject.toml", "config", "toml", "[tool.ruff]\n[tool.mypy]\n"), ("a", "a/tests/test_x.py", "test", "python", ""), ("b", "b/package.json", "manifest", "json", '{"scripts": {"test": "jest", "lint": "", "build": "echo \\"no test specified\\""}}'),
        ("b", "b/tsconfig.json", "config", "json", "{}"), (".", "go.mod", "manifest", "", ""), ("a", "a/sub/Cargo.toml", "manifest", "toml", ""), ("c", "c/tsconfig.json", "config", "json", "{}"), ("d", "d/package.json", "manifest", "json", "{broken"),
    ]
    files = spark.createDataFrame(rows, "project string, path string, kind string, language string, text string")
    assert {tuple(r) for r in P.steps(files).collect()} == {("a", "pytest"), ("a", "ruff"), ("a", "mypy"), ("b", "npm test"), ("b", "tsc"), (".", "go test")}
    assert P.run_steps("/", {"yes": ["true"], "no": ["false"], "gone": ["no-such-command-here"], "slow": ["sleep", "5"]}, timeout=1) == [("yes", "pass", 0), ("no", "fail", 1), ("gone", "unavailable", None), ("slow", "timeout", None)]


def test_successors_inherit_and_terminal_items_stay(spark):
    items = spark.createDataFrame([("M-1", "confirmed", "d1", "k", ["p"]), ("M-2", "deprecated", "d1", "k2", [])], "id string, status string, updated string, key string, paths array<string>")
    new = spark.createDataFrame([("M-3", "inferred", "d2", "", [], "M-1"), ("M-4", "inferred", "d2", "own", ["q"], "M-2"), ("M-5", "inferred", "d3", None, None, None), ("M-6", "inferred", "d3", "", [], "M-9")], "id string, status string, updated string, key string, paths array<string>, supersedes string")
    got = {r["id"]: (r["status"], r["key"], r["paths"], r["superseded_by"], r["updated"]) for r in ST.superseded_items(items, new, inherited=("key", "paths")).collect()}
    assert got["M-1"] == ("superseded", "k", ["p"], "M-3", "d2") and got["M-3"] == ("inferred", "k", ["p"], None, "d2")
    assert got["M-2"] == ("deprecated", "k2", [], None, "d1") and got["M-4"][0] == "rejected" and got["M-4"][1] == "own"
    assert got["M-5"] == ("inferred", None, None, None, "d3") and got["M-6"][0] == "rejected"
    assert ST.superseded_items(items.limit(0), new.limit(0), inherited=("key",)).count() == 0


def test_contradictions_skills_and_verdicts(spark):
    claims = spark.createDataFrame([(1, {"python -m pytest -q": "PASS", "ruff": "FAIL"}), (2, {"pytest": "PASS"})], "k int, steps map<string,string>")
    records = spark.createDataFrame([(1, True, True, {"demo: pytest": "fail", "ruff check": "fail"}), (2, True, False, {"pytest": "fail"})], "k int, ran boolean, fresh boolean, step_results map<string,string>")
    assert [tuple(r) for r in P.contradictions(claims, records, "k").collect()] == [(1, "python -m pytest -q", "PASS", "FAIL")]
    skills = spark.createDataFrame([(1, "plan", "plan a retry handler"), (2, "plan", "other"), (3, "test", "write tests for a cache"), (4, "zip", None)], "seq int, name string, description string")
    assert [(r["name"], r["overlap"] > 0) for r in P.matching_skills(skills, "retry of a handler", 3).collect()] == [("plan", True)]
    assert [r["name"] for r in P.matching_skills(skills, "", 2).collect()] == ["plan", "test"]
    scores = spark.createDataFrame([(1, True, "ok"), (1, True, "warn"), (1, False, "error"), (2, False, "error")], "run int, req boolean, score string")
    assert {tuple(r) for r in P.run_verdict(scores, "run", "req", "score", ("ok", "info", "warn", "error")).collect()} == {(1, "warn"), (2, "ok")}
    none, steps = spark.createDataFrame([], "x int"), spark.createDataFrame([("pytest", "pass")], "step string, status string")
    assert P.verdict(none, steps, none, none).first()["verdict"] == "verified" and P.verdict(none, steps.limit(0), none, none).first()["verdict"] == "not verified"
    assert P.verdict(none, steps, steps, none).first().asDict() == {"verdict": "not verified", "outstanding": 1, "advisories": 0}
    found = spark.createDataFrame([("hit", "see a/b.py and c/d.py"), ("next", "open e/f.py")], "kind string, text string")
    files = spark.createDataFrame([("a/b.py",), ("e/f.py",)], "path string")
    assert [r["path"] for r in P.surfaced_files(found, files, "text", "kind").collect()] == ["a/b.py"]
    sections = spark.createDataFrame([("direct-caller", f"n{i}", 1, "inferred") for i in range(12)] + [("other", "x", 1, "inferred")], "section string, node string, depth int, confidence string")
    made = P.brief(sections, spark.createDataFrame([("boundary", 3, "inferred")], "finding string, amount long, confidence string"), changes=steps)
    assert made.filter("section = 'direct-caller'").count() == 8 and {r["item"] for r in made.filter("section <> 'direct-caller'").collect()} == {"boundary 3", "1 uncommitted change(s)"}
    assert P.context({"brief": made.select("rank", "item"), "skills": made.select("rank", "item")}).groupBy("part").count().collect().__len__() == 2
    scope = spark.createDataFrame([("source", "M", "p"), ("docs", "M", "."), ("script", "D", ".")], "kind string, status string, project string")
    assert C.project_scope(scope).first()[0] == ["p"] and C.project_scope(scope.withColumn("project", F.lit("."))).first()[0] == []


def test_keyed_state_survives_a_save_that_died(spark, tmp_path):
    folder = str(tmp_path / "state")
    table = lambda rows: spark.createDataFrame(rows, "k string, v int")
    assert T.load_state(spark, folder) is None
    T.save_state(table([("a", 1), ("b", 2)]), folder, ["k"])
    T.save_state(table([("b", 3), ("c", 4)]), folder, ["k"])
    (tmp_path / "state" / "generation=9").mkdir()
    assert sorted(map(tuple, T.load_state(spark, folder).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    calls = spark.createDataFrame([(1, "deny"), (2, None)], "i int, decision string")
    assert [tuple(r) for r in ST.permissive(calls).orderBy("i").collect()] == [(1, "deny", False), (2, "allow", True)]


def test_evidence_records(spark):
    schema = "test string, model string, date string, prompt string, observed map<string,string>, scores map<string,string>, final_verdict string"
    seen = {"files_touched": "1", "lines_added": "2", "lines_removed": "0"}
    rows = [("t1", "m", "d", "p", seen, {"a": "PASS", "b": "FAIL"}, "PASS"), ("t9", None, "d", "p", {}, {"a": "PASS"}, "MAYBE"), ("t1", "m", "d", "sk-" + "a" * 30, seen, {"a": "GOOD", "b": None}, ""), (None,) * 7]
    rules = P.record_rules(("a", "b"), ("PASS", "PARTIAL", "FAIL"), ("t1",))
    got = [r["e"] for r in spark.createDataFrame(rows, schema).select(R.rule_errors(rules).alias("e")).collect()]
    assert got[0] == [] and set(got[1]) == {"missing model", "unknown test", "scores must contain exactly the dimensions", "final_verdict must be PASS, PARTIAL, FAIL or empty", "observed.files_touched missing", "observed.lines_added missing", "observed.lines_removed missing"}
    assert got[2] == ["invalid score values", "a record must not contain secrets"] and "missing scores" in got[3]
    text = spark.createDataFrame([("see /w/x/a.py and \\\\w\\\\x",)], "t string").select(P.without_root(F.col("t"), "/w/x").alias("t")).first()["t"]
    assert text.startswith("see <root>/a.py")


def test_the_command_line(spark, capsys):
    from codeloom.__main__ import main

    assert main([]) == 0 and "p1_found" in capsys.readouterr().out and main(["nothing"]) == 2


def test_configuration_walk_and_digests(spark, tmp_path):
    root = tmp_path / "r"
    for path in ("keep/a.py", "node_modules/x.js", "own/b.py", "own/c.tmp", "z.pyc", "data/deep/d.py"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(path)
    assert S.load_config(str(root)) == S.Config() and list(S.walk(str(root), S.Config())) == ["data/deep/d.py", "keep/a.py", "own/b.py", "own/c.tmp"]
    (root / "codeloom.toml").write_text('exclude_globs = ["*.tmp", "data/*/"]\nextra_exclude_dirs = ["keep"]\n')
    config = S.load_config(str(root))
    assert config.exclude_globs == ("*.tmp", "data/*/") and "keep" in config.exclude_dirs and "node_modules" in config.exclude_dirs
    assert list(S.walk(str(root), config)) == ["codeloom.toml", "z.pyc", "own/b.py"]
    digests = {r["path"].rpartition("/")[2]: r["sha256"] for r in S.content_map(spark, str(root / "own")).collect()}
    assert set(digests) == {"b.py", "c.tmp"} and all(len(v) == 64 for v in digests.values())
    assert S.git_lines(str(tmp_path), "rev-parse", "HEAD") == []


def test_a_log_is_trimmed_to_its_newest(spark):
    log = spark.range(30).select(F.col("id").alias("t"))
    assert ST.trimmed_log(log, ["t"], limit=40, keep=5).count() == 30
    assert sorted(r["t"] for r in ST.trimmed_log(log, ["t"], limit=20, keep=5).collect()) == [25, 26, 27, 28, 29]
    assert ST.trimmed_log(log.limit(0), ["t"]).count() == 0


def test_settled_gates(spark):
    gates = spark.createDataFrame([("a", 1, "x"), ("b", 5, "x"), ("c", 1, "x")], "f string, t int, d string")
    seen = spark.createDataFrame([("a", 1, "y"), ("a", 2, "x"), ("a", 4, "z"), ("a", 3, "y"), ("b", 4, "y")], "f string, t int, d string")
    assert {r["f"]: r["settled_at"] for r in ST.settled_gates(gates, seen, "f", "t", "d").collect()} == {"a": 3, "b": None, "c": None}

from pyspark.sql import functions as F

from codeloom.operators import changes as C
from codeloom.operators import components as G8
from codeloom.operators import graph as G
from codeloom.operators import relational as R
from codeloom.operators import similarity as S
from codeloom.operators import state as ST


def test_identifier_lines_are_whole_words(spark):
    files = spark.createDataFrame([("a", "foo(x)\nfoo_bar\n$foo\nx.foo\n"), ("b", None), ("c", "")], "path string, text string")
    assert sorted(r["line"] for r in R.identifier_lines(files, "foo").collect()) == [1, 4]
    assert R.identifier_lines(files, "not a name").count() == 0


def test_definition_falls_back_to_any_case(spark):
    symbols = spark.createDataFrame([("Token", "a.Token", "f"), ("other", "x.other", "g")], "name string, qualname string, file string")
    assert R.definition(symbols, "token").first()["tier"] == 2 and R.definition(symbols, "Token").first()["tier"] == 1
    assert R.definition(symbols, "none").count() == 0


def test_import_candidates(spark):
    row = spark.range(1).select(R.module_candidates(F.lit("a/b/c.py"), F.lit("x.y"), F.lit(0)).alias("top"), R.module_candidates(F.lit("a/b/c.py"), F.lit("x"), F.lit(2)).alias("up"), R.specifier_candidates(F.lit("w/a.js"), F.lit("../u")).alias("js")).first()
    assert row["top"][:2] == ["x/y.py", "x/y/__init__.py"] and row["top"][-2:] == ["a/b/x/y.py", "a/b/x/y/__init__.py"]
    assert row["up"] == ["a/x.py", "a/x/__init__.py"]
    assert row["js"][:2] == ["u", "u.ts"] and "u/index.js" in row["js"]


def test_longest_root_wins_and_one_letter_never(spark):
    rows = spark.createDataFrame([("a/b/c.py",), ("a/d.py",), ("z.py",)], "path string")
    roots = spark.createDataFrame([("a",), ("a/b",), (None,)], "root string")
    assert {r["path"]: r["project"] for r in R.longest_prefix(rows, "path", roots, "root", "project").collect()} == {"a/b/c.py": "a/b", "a/d.py": ".", "z.py": "."}


def test_next_id_is_padded_and_never_cut(spark, tmp_path):
    from codeloom.plans import reference

    ids = lambda *keys: R.next_id(spark.createDataFrame([(k,) for k in keys], "id string"), "id").first()["next_id"]
    assert ids("M-0007", "M-12", None) == "M-0013" and ids("M-9999", "M-1") == "M-10000" and ids("M-123456") == "M-123457" and ids(None) == "M-0001"
    spark.createDataFrame([(1,), (8999,), (10000,)], "doc_id long").write.parquet(str(tmp_path / "documents.parquet"))
    assert reference.win10_next_id(spark, str(tmp_path)).first()["next_id"] == "M-10001"


def test_drift_and_renames(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, sha string")
    new = spark.createDataFrame([("a", "9"), ("d", "2"), ("c", None)], "path string, sha string")
    diff = R.drift(old, new, "path", "sha")
    assert {tuple(r) for r in diff.collect()} == {("a", "changed"), ("b", "removed"), ("d", "added")}
    assert [tuple(r) for r in R.renames(diff, old, new, "path", "sha").collect()] == [("b", "d")]


def test_related_prefers_names_and_reuse_decides(spark):
    symbols = spark.createDataFrame(
        [(1, "validate_email", "validate_email", "function", "app/v.py", 1, True, ""), (2, "send", "send", "function", "app/m.py", 2, True, "Check an email."), (3, "other", "other", "class", "app/o.py", 3, True, None), (4, "_email", "_email", "variable", "app/o.py", 4, False, "")],
        "sym_seq long, name string, qualname string, kind string, file string, line int, exported boolean, doc string",
    )
    got = [r["sym_seq"] for r in R.related(symbols, "verify the email address").collect()]
    assert got == [1, 2]
    assert R.reuse_decision(symbols, "verify email", ["validate_email"]).first()["decision"] == "reuse"
    assert R.reuse_decision(symbols, "paint walls", []).first()["decision"] == "create"


def test_components_of_chains_stars_and_loops(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 1)], "a int, b int")
    got = {r["node"]: r["component"] for r in G8.components(links).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[100 + i] for i in range(60)} == {100}
    assert G8.components(links.limit(0)).count() == 0


def test_walk_claims_by_first_edge_and_keeps_the_weakest(spark):
    rows = [(1, "b", "a", "calls", "confirmed", 1, ""), (2, "c", "b", "calls", "inferred", 1, ""), (3, "c", "a", "references", "confirmed", 1, ""), (4, "d", "c", "calls", "confirmed", 1, ""), (5, "a", "d", "calls", "confirmed", 1, "")]
    edges = spark.createDataFrame(rows, "edge_seq long, src string, dst string, kind string, confidence string, line int, note string")
    got = {r["node"]: (r["depth"], r["confidence"]) for r in G.walk(edges, "a", 2).collect()}
    assert got == {"b": (1, "confirmed"), "c": (1, "confirmed"), "d": (2, "confirmed")}
    calls = {r["node"]: (r["depth"], r["confidence"], r["chain"]) for r in G.walk(edges, "a", 3, True, ("calls",)).collect()}
    assert calls["c"] == (2, "inferred", ["a", "b", "c"]) and calls["d"][:2] == (3, "inferred") and "a" not in calls


def test_similar_classes(spark):
    base = list(range(100))
    rows = [(1, "f", "a", base, base, 90), (2, "g", "b", base, base, 90), (3, "h", "c", [x + 1000 for x in base], base, 90), (4, "i", "d", base + list(range(500, 560)), list(range(900, 1030)) + base[:5], 130), (5, "f", "a.in", base[:80], list(range(2000, 2100)) + base[:4], 60), (6, "j", "e", None, None, 0), (2, "g", "b", base, base, 90)]
    bodies = spark.createDataFrame(rows, "sym_seq long, file string, qualname string, exact array<long>, normalized array<long>, tokens int")
    got = {(r["a"], r["b"]): r["kind"] for r in S.similar_pairs(bodies).collect()}
    assert got == {(1, 2): "duplicate", (1, 3): "structural", (2, 3): "structural", (1, 4): "modified-copy", (2, 4): "modified-copy", (1, 5): "duplicate", (2, 5): "duplicate", (4, 5): "modified-copy"}


def test_state_over_events(spark):
    events = spark.createDataFrame([("u", i, lv) for i, lv in enumerate(["low", "elevated", "elevated", "high", "low", "elevated"])], "k string, t int, level string")
    assert [(r["t"], r["from_level"]) for r in ST.transitions(events, "k", ["t"], "level", ("low", "elevated", "high")).orderBy("t").collect()] == [(1, "low"), (3, "elevated")]
    assert [r["count"] for r in ST.capped_count(events, "k", ["t"], F.col("level") != "low", 2).orderBy("t").collect()] == [0, 1, 2, 2, 2, 2]
    assert ST.once(events, "k", ["t"]).count() == 1 and ST.supersede(events, "k", ["t"], "t").filter("status = 'current'").first()["t"] == 5


def test_task_frame(spark):
    cols = "k string, t int, assumption string, material boolean, question string, resolve string, answer string, confirm string"
    rows = [("a", 1, "Uses UTC", True, None, None, None, None), ("a", 2, None, None, "Which zone?", None, None, None), ("a", 3, None, None, None, "ZONE", "UTC", None), ("b", 1, None, None, "Open?", None, None, None), ("c", 1, "X", False, None, None, None, None), ("d", 1, "Y z", True, None, None, None, None), ("d", 2, None, None, None, None, None, "y Z")]
    got = {r["k"]: r["state"] for r in ST.task_state(spark.createDataFrame(rows, cols), "k", ["t"]).collect()}
    assert got == {"a": "awaiting-confirmation", "b": "blocked", "c": "clear", "d": "clear"}


def test_edit_decisions(spark):
    cols = "is_write boolean, inside boolean, is_code boolean, open_questions int, shape string, lines int, evidence string, evidence_command string, pending int"
    rows = [(False, True, True, 9, "edit", 9, None, None, 0), (True, True, True, 1, "edit", 1, None, None, 0), (True, True, True, 0, "edit", 2, None, None, 0), (True, True, True, 0, "new-file", 9, "target", "refs", 0), (True, True, True, 0, "new-file", 9, "task", "reuse", 0), (True, True, True, 0, "rewrite", 9, "task", "brief", 0), (True, True, True, 0, "rewrite", 9, "target", "def", 2), (True, True, True, 0, "rewrite", 9, None, None, 2)]
    got = [r["decision"] for r in ST.edit_decision(spark.createDataFrame(rows, cols).coalesce(1)).collect()]
    assert got == ["allow", "deny", "allow", "deny", "allow", "ask", "ask", "deny"]


def test_change_signals(spark):
    cols = "path string, status string, added int, removed int, whitespace_only int, kind string, language string, old_path string, new_symbols array<string>"
    rows = [("a/x.py", "M", 10, 1, 0, "source", "python", "", []), ("b/y.py", "A", 20, 0, 0, "source", "python", "", ["f"]), ("c/z.py", "M", 200, 2, 60, "source", "python", "", []), ("d/w.py", "M", 1, 1, 0, "source", "python", "", [])]
    changes = spark.createDataFrame(rows, cols)
    imports = spark.createDataFrame([("a/x.py", "b/y.py"), ("b/y.py", None)], "file string, resolved string")
    none = spark.createDataFrame([], "qualname string, kind string")
    assert sorted(r["path"] for r in C.unrelated(changes, imports).collect()) == ["c/z.py", "d/w.py"]
    assert [r["path"] for r in C.unrelated(changes, imports, ["x.py"]).orderBy("path").collect()] == ["c/z.py", "d/w.py"]
    reasons = [r["reason"] for r in C.reasons(changes, imports, none).collect()]
    assert any("single small symbol" in r for r in reasons) and any("growth" in r for r in reasons) and any("churn" in r for r in reasons) and any("4 top-level" in r for r in reasons)
    assert C.level(C.reasons(changes, imports, none)).first()["level"] == "elevated"
    assert C.level(C.reasons(changes.limit(0), imports, none)).first()["level"] == "low"


def test_numstat_and_added_lines(spark):
    row = spark.range(1).select(C.numstat(F.lit("3\t1\tsrc/{old => new}/a.py")).alias("r"), C.numstat(F.lit("-\t-\ta.png")).alias("b")).first()
    assert tuple(row["r"]) == (3, 1, "src/new/a.py") and tuple(row["b"]) == (0, 0, "a.png")
    diff = spark.createDataFrame([(1, i, r) for i, r in enumerate(["+++ b/a.py", "@@ -1,2 +3,2 @@ x", "+y", "@@ -9 +20 @@", "+++ /dev/null", "@@ -1 +0,0 @@"])], "diff_id int, seq int, row string")
    assert sorted((r["path"], r["line"]) for r in C.added_lines(diff).collect()) == [("a.py", 3), ("a.py", 4), ("a.py", 20)]


def test_bypassed_checks(spark):
    from codeloom.sources import python_code as P

    before = "def f(a):\n    check(a)\n    save(a)\n    log(a)\n"
    after = "def f(a, skip=False):\n    if not skip:\n        check(a)\n    log(a)\n"
    cols = "path string, func string, params array<string>, callee string, unconditional boolean, guards array<string>"
    frame = lambda src: spark.createDataFrame([("p.py", r["func"], r["params"], r["callee"], r["unconditional"], r["guards"]) for r in P.guarded_calls(src)], cols)
    known = spark.createDataFrame([("check",), ("save",), ("log",)], "name string")
    got = {(r["callee"], r["kind"]) for r in C.bypasses(frame(before), frame(after), known).collect()}
    assert got == {("check", "invariant-bypass"), ("save", "shared-call-removed")}

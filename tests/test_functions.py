from pyspark.sql import functions as F

from codeloom.functions import text as X


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_language_and_kind(spark):
    rows = [
        ("pkg/users.py", "x = 1", "source"), ("tests/test_users.py", "", "test"), ("pkg/test_users.py", "", "test"), ("config/settings.yaml", "", "config"), ("generated/schema_pb2.py", "", "generated"),
        ("a/x.py", "# DO NOT EDIT\n", "generated"), ("scripts/run.py", "", "script"), ("run.sh", "", "script"), ("pyproject.toml", "", "manifest"), ("requirements-dev.txt", "", "manifest"), ("README.md", "", "docs"), ("t.csv", "", "data"), ("x.bin", "", "other"), ("Dockerfile", "", "manifest"),
    ]
    df = spark.createDataFrame(rows, "path string, text string, want string")
    got = df.select("path", "want", X.classify(F.col("path"), X.language_of(F.col("path")), X.header_of(F.col("text")), F.lit(True))["kind"].alias("kind")).collect()
    assert {r["path"]: r["kind"] for r in got} == {p: w for p, _, w in rows}
    assert one(spark, X.language_of(F.col("p")), p="web/App.TSX") == "typescript"
    assert one(spark, X.language_of(F.col("p")), p=".env") == ""
    assert one(spark, X.language_of(F.col("p")), p=None) is None


def test_terms_fold_and_expand(spark):
    assert set(one(spark, X.terms(F.col("t")), t="validateUserEmails")) == {"validate", "valid", "user", "us", "emails", "email"} - {"us"}
    assert set(one(spark, X.keys(X.terms(F.col("t"))), t="HTTPServer parsing")) == {"http", "serve", "serv", "parsi", "pars"}
    assert "is_valid" in one(spark, X.expanded(F.array(F.col("t"))), t="check")


def test_tokens_shingles_and_ratios(spark):
    code = "# note\ndef f(a):\n    return a + 1\n\n// c\n"
    assert one(spark, X.code_tokens(F.col("t")), t=code) == ["def", "f", "(", "a", ")", ":", "return", "a", "+", "1"]
    assert one(spark, X.normalised(X.code_tokens(F.col("t"))), t=code)[:4] == ["def", "_", "(", "_"]
    assert one(spark, F.size(X.shingles(X.code_tokens(F.col("t")))), t=code) == 7
    assert one(spark, F.size(X.shingles(X.code_tokens(F.col("t")))), t="a b") == 0
    assert one(spark, X.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == 1 / 3
    assert one(spark, X.containment(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2)))) == 1.0
    assert one(spark, X.code_tokens(F.col("t")), t="x = '" + "a" * 200_000 + "'")[2].startswith("'a")


def test_paths_and_nodes(spark):
    assert one(spark, X.mentioned_paths(F.col("t")), t="see a/b.py::f, a/b.py and https://x.y/z.html c/d/e.ts") == ["a/b.py", "c/d/e.ts"]
    assert one(spark, X.node_file(F.col("t")), t="sym:a/b.py::C.m") == "a/b.py"
    assert one(spark, X.top_dir(F.col("t")), t="x.py") == "."
    assert one(spark, X.is_inside(F.col("t")), t="a/../b") is False


def test_ranks_lines_and_labels(spark):
    assert one(spark, X.weakest(F.lit("confirmed"), F.lit("inferred"))) == "inferred"
    assert [one(spark, X.line_count(F.col("t")), t=t) for t in ("", "a", "a\n", "a\nb", None)] == [0, 1, 1, 2, 0]
    assert one(spark, X.step_label(F.array(F.lit("/usr/bin/python3"), F.lit("-m"), F.lit("pytest"), F.lit("-q"), F.lit("x")))) == "python -m pytest -q"
    assert one(spark, X.matcher_matches("a|b", F.col("t")), t="ab") is False and one(spark, X.matcher_matches("*", F.col("t")), t="ab") is True and one(spark, X.matcher_matches("(", F.col("t")), t="x") is False


def test_edit_shapes(spark):
    shape = lambda tool, args, exists=True: tuple(one(spark, X.edit_shape(F.lit(tool), F.lit(args), F.lit(exists))))
    assert shape("write_to_file", '{"CodeContent": "a\\nb\\n"}', False) == ("new-file", 2)
    assert shape("replace_file_content", '{"TargetContent": "a", "ReplacementContent": "a\\nb\\nc"}') == ("edit", 3)
    assert shape("multi_replace_file_content", '{"ReplacementChunks": [{"TargetContent": "a\\nb"}, {"ReplacementContent": "c"}]}') == ("edit", 3)
    assert shape("other", "{}") == ("unknown", 0)


def test_markers_in_code_prose_and_fences(spark):
    found = lambda path, text: [tuple(r) for r in one(spark, X.marker_lines(F.col("p"), F.col("t")), p=path, t=text)]
    assert found("a.js", "x(); // TODO later\ny('// TODO no');\n") == [(1, "x(); // TODO later")]
    assert found("a.md", "- TODO: one\n```\nTODO: two\n```\nsay TODO: three\n") == [(1, "- TODO: one")]
    assert found("a.json", "// TODO x") == [] and found("tests/fixtures/a.js", "// TODO x") == []
    assert found("a.js", "// TODO/later\n") == []


def test_claims(spark):
    text = "Done.\n\n## Verification:\n- pytest -q - PASSED\n- ruff check - FAIL\ntool verify - NOT VERIFIED (x)\n\nall tests pass"
    row = one(spark, X.model_claims(F.col("t")), t=text)
    assert row["present"] and row["steps"] == {"pytest -q": "PASS", "ruff check": "FAIL"} and row["verdict"] == "NOT VERIFIED" and row["prose_pass"]
    assert not one(spark, X.model_claims(F.col("t")), t="all tests pass")["present"]


def test_frontmatter(spark):
    assert one(spark, X.frontmatter(F.col("t")), t="---\nname: x\ndescription: a: b\n---\nbody") == {"name": "x", "description": "a: b"}


def test_patterns_from_word_tables(spark):
    from pyspark.sql import functions as F

    from codeloom.functions import text as X

    rows = [("- [ ] TODO: x", True), ("  > * **FIXME** (me)", True), ("TODOS: x", False), ("a TODO: x", False), ("1. HACK : x", True), ("## XXX(y)", True), ("text <!-- TODO -->", True), ("- TODO x", False)]
    frame = spark.createDataFrame(rows, "line string, want boolean")
    assert frame.filter(X.prose_marker(F.col("line")) != F.col("want")).count() == 0
    names = [(n, w) for w, many in ((True, ("a/.env", ".env.local", "x.PEM", "id_rsa.pub", "credentials.json", "tokens.json", "a.token")), (False, ("env", "my.env", "pem", "credentials.yaml", "x.tokens"))) for n in many]
    assert spark.createDataFrame(names, "p string, want boolean").filter(X.secret_name(F.col("p")) != F.col("want")).count() == 0
    joined = spark.createDataFrame([("r/", "./a/b"), ("r", "../x"), ("r", "/etc"), ("r", "c:\\x"), ("r", None)], "root string, p string").select(X.safe_join(F.col("root"), F.col("p")).alias("j"))
    assert [r["j"] for r in joined.collect()] == ["r/a/b", None, None, None, None]
    claim = "Verification:\n- `pytest -q` - PASSED\n* ruff check : fail\ncodeloom verify — NOT VERIFIED\n\nlater: x - PASS\nAll the tests now pass."
    got = spark.createDataFrame([(claim,)], "t string").select(X.model_claims(F.col("t")).alias("c")).first()["c"]
    assert got["steps"] == {"pytest -q": "PASS", "ruff check": "FAIL"} and got["verdict"] == "NOT VERIFIED" and got["prose_pass"]
    assert spark.range(1).select(X.edge_line(F.lit("sym:a.py::f"), F.lit("calls"), F.lit("sym:b.py::g"), F.lit("inferred"), F.lit(3))).first()[0] == "a.py::f calls b.py::g (inferred, line 3)"

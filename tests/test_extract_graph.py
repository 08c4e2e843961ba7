from pyspark.sql import functions as F

from codeloom.operators import graph as G
from codeloom.sources import extract as E

FILES = [
    (1, "pkg/__init__.py", "python", "source", ""),
    (2, "pkg/names.py", "python", "source", "LIMIT = 3\n\n\ndef tidy(x):\n    \"\"\"Tidy up.\"\"\"\n    return x.strip()\n"),
    (3, "pkg/people.py", "python", "source", "from .names import tidy\nfrom pkg import names\n\n\nclass Base:\n    def label(self):\n        return tidy(self.raw)\n\n\nclass Person(Base):\n    def show(self):\n        return self.label() + names.tidy('x')\n"),
    (4, "pkg/broken.py", "python", "source", "def f(:\n"),
    (5, "tests/test_people.py", "python", "test", "from pkg.people import Person\n\n\ndef test_it():\n    assert Person().show()\n"),
    (6, "web/app.js", "javascript", "source", "import { tidy as clean } from './util';\n\nexport class App extends Page {\n  run(a) {\n    clean(a);\n    this.stop();\n  }\n  stop() {\n  }\n}\n"),
    (7, "web/util.js", "javascript", "source", "export function tidy(x) {\n  return x;\n}\n"),
    (8, "conf/app.yaml", "yaml", "config", "handler: pkg.people.Person\nother: tidy\n"),
    (9, "lib/x.rs", "rust", "source", "fn f() {}\n"),
]


def tables(spark):
    files = spark.createDataFrame([(*f, "extra") for f in FILES], "file_seq long, path string, language string, kind string, text string, name string").withColumn("project", F.lit("."))
    return files, E.extract(files)


def test_tables(spark):
    files, facts = tables(spark)
    status = {r["file"]: r for r in E.status(facts).collect()}
    assert status["pkg/broken.py"]["confidence"] == "unknown" and "SyntaxError" in status["pkg/broken.py"]["error"]
    assert status["lib/x.rs"]["confidence"] == "unknown" and status["pkg/people.py"]["exports"] == ["Base", "Person"]
    symbols = {(r["file"], r["qualname"]): r["kind"] for r in E.rows_of(facts, "symbols", "sym_seq").collect()}
    assert symbols[("pkg/names.py", "LIMIT")] == "constant" and symbols[("pkg/people.py", "Person.show")] == "method" and symbols[("web/app.js", "App.run")] == "method"
    imports = {(r["file"], r["module"]): r["resolved"] for r in E.resolved_imports(facts, files).collect()}
    assert imports[("pkg/people.py", "names")] == "pkg/names.py" and imports[("pkg/people.py", "pkg.names")] == "pkg/names.py"
    assert imports[("tests/test_people.py", "pkg.people")] == "pkg/people.py" and imports[("web/app.js", "./util")] == "web/util.js"


def test_edges_impact_and_trace(spark):
    files, facts = tables(spark)
    symbols = E.rows_of(facts, "symbols", "sym_seq")
    edges = G.build_edges(files, files.select(F.lit("x").alias("root")), E.status(facts), symbols, E.resolved_imports(facts, files), E.rows_of(facts, "uses", "use_seq"), E.rows_of(facts, "bases", "base_seq"), files.select("path", "kind", "text")).cache()
    got = {(r["src"], r["dst"], r["kind"]) for r in edges.collect()}
    assert ("sym:pkg/people.py::Base.label", "sym:pkg/names.py::tidy", "calls") in got
    assert ("sym:pkg/people.py::Person.show", "sym:pkg/people.py::Base.label", "calls") in got
    assert ("sym:pkg/people.py::Person.show", "sym:pkg/names.py::tidy", "calls") in got
    assert ("sym:pkg/people.py::Person", "sym:pkg/people.py::Base", "extends") in got
    assert ("file:tests/test_people.py", "sym:pkg/people.py::Person", "tests") in got
    assert ("sym:web/app.js::App.run", "sym:web/util.js::tidy", "calls") in got and ("sym:web/app.js::App.run", "sym:web/app.js::App.stop", "calls") in got
    assert ("file:conf/app.yaml", "sym:pkg/people.py::Person", "configures") in got
    assert not any("broken" in a for a, _, _ in got)
    hit = {(r["section"], r["node"]) for r in G.impact(edges, ["sym:pkg/names.py::tidy"], 2).collect()}
    assert ("direct-caller", "sym:pkg/people.py::Base.label") in hit and ("direct-caller", "sym:pkg/people.py::Person.show") in hit and ("dependent-file", "file:pkg/people.py") in hit
    causes = [r["node"] for r in G.trace(edges, symbols, "sym:tests/test_people.py::test_it").filter("direction = 'downstream'").orderBy("cause_rank").collect()]
    assert "sym:pkg/people.py::Person" in causes


def test_self_methods_are_followed_up_any_number_of_bases(spark):
    asks = spark.createDataFrame([(1, "f", "run", "C11.go", "exact"), (2, "f", "run", "D1.go", "exact"), (3, "f", "stop", "C11.go", "exact")], "ask int, file string, short string, scope string, own string")
    goal = spark.createDataFrame([("f", "run", "C0", "C0.run", "method"), ("f", "run", "Z", "Z.run", "method"), ("f", "stop", "Z", "Z.stop", "method")], "dfile string, short string, dparent string, dst string, dkind string")
    # A chain of eleven links, and a cycle of two that leads nowhere.
    bases = spark.createDataFrame([*[("f", f"C{i}", f"m.C{i - 1}") for i in range(1, 12)], ("f", "D1", "D2"), ("f", "D2", "D1")], "file string, qualname string, base string")
    got = {(r["ask"], r["dst"], r["confidence"]) for r in G._self_targets(asks, goal, bases, ["ask", "own"]).collect()}
    assert got == {(1, "C0.run", "exact"), (2, "C0.run", "inferred"), (2, "Z.run", "inferred"), (3, "Z.stop", "inferred")}


def build(spark, files, symbols, imports=(), uses=(), bases=(), texts=(), status=None):
    f = spark.createDataFrame(files, "path string, file_seq long, kind string, root string, project string")
    s = spark.createDataFrame(symbols, "file string, sym_seq int, name string, kind string, line int, qualname string, parent string, confidence string")
    i = spark.createDataFrame(list(imports), "file string, import_seq int, resolved string, bindings array<struct<name:string,alias:string>>, line int, confidence string")
    u = spark.createDataFrame(list(uses), "file string, use_seq int, use_kind string, name string, line int, scope string, receiver string")
    b = spark.createDataFrame(list(bases), "file string, base_seq int, qualname string, base string, line int, relation string")
    t = spark.createDataFrame(list(texts), "path string, kind string, text string")
    st = spark.createDataFrame(status or [(x[0], "confirmed", "") for x in files], "file string, confidence string, error string")
    return G.build_edges(f, f.select("root"), st, s, i, u, b, t)


def test_edges_stand_in_the_order_of_files_and_places_and_are_unique(spark):
    files = [("z.py", 1, "source", "r", "r"), ("a.py", 2, "test", "r", "r")]
    symbols = [("z.py", 0, "f", "function", 1, "f", "", "confirmed"), ("z.py", 1, "g", "function", 9, "g", None, "confirmed"), ("a.py", 0, "t", "function", 1, "t", "", "confirmed")]
    uses = [("a.py", 5, "call", "g", 3, "t", ""), ("a.py", 2, "call", "f", 8, "t", ""), ("z.py", 7, "call", "g", 2, "f", ""), ("a.py", 6, "reference", "f", 8, "t", ""), ("a.py", 9, "reference", "g", 4, "", "")]
    edges = build(spark, files, symbols, uses=uses, imports=[("a.py", 0, "z.py", [], 1, "confirmed")])
    rows = edges.orderBy("edge_seq").collect()
    assert len({r["edge_seq"] for r in rows}) == len(rows)
    f, g, t, a = "sym:z.py::f", "sym:z.py::g", "sym:a.py::t", "file:a.py"
    assert [(r["src"], r["dst"], r["kind"]) for r in rows] == [("file:z.py", f, "defines"), ("file:z.py", g, "defines"), (f, g, "calls"), (a, t, "defines"), (a, "file:z.py", "imports"), (a, "file:z.py", "tests"), (t, f, "calls"), (a, f, "tests"), (t, g, "calls"), (a, g, "tests"), (a, g, "references"), (a, g, "tests")]
    # Breadth first, each node is claimed by its first edge: f calls g before t does.
    assert [(r["node"], r["depth"], r["rank"]) for r in G.walk(edges, g, 2, True, ("calls",)).orderBy("depth", "rank").collect()] == [(f, 1, 1), (t, 1, 2)]


def test_names_are_looked_for_within_one_root(spark):
    files = [(f"{r}/{n}.py", i, "source", r, r) for r in ("r", "s") for i, n in enumerate("ab")]
    symbols = [(f"{r}/b.py", 0, "helper", "function", 1, "helper", "", "confirmed") for r in ("r", "s")] + [(f"{r}/b.py", 1, "run", "method", 2, "C.run", "C", "confirmed") for r in ("r", "s")]
    uses = [("r/a.py", 0, "call", "helper", 1, "", ""), ("r/a.py", 1, "call", "run", 2, "", "thing"), ("s/b.py", 0, "call", "helper", 3, "", "")]
    got = {(r["src"], r["dst"], r["confidence"]) for r in build(spark, files, symbols, uses=uses).filter("kind = 'calls'").collect()}
    assert got == {("file:r/a.py", "sym:r/b.py::helper", "inferred"), ("file:r/a.py", "sym:r/b.py::C.run", "inferred"), ("file:s/b.py", "sym:s/b.py::helper", "confirmed")}


def test_the_last_import_of_a_name_decides(spark):
    files = [(p, i, "source", "r", "r") for i, p in enumerate(("m.py", "n.py", "x.py"))]
    symbols = [(p, 0, "f", "function", 1, "f", "", "confirmed") for p in ("m.py", "n.py")]
    imports = [("x.py", 0, "m.py", [("f", "f")], 1, "confirmed"), ("x.py", 1, "n.py", [("f", "f"), ("gone", "f2")], 2, "confirmed"), ("x.py", 2, "m.py", [("gone", "f")], 3, "confirmed")]
    edges = build(spark, files, symbols, imports=imports, uses=[("x.py", 0, "call", "f", 5, "", "")])
    assert [r["dst"] for r in edges.filter("kind = 'calls'").collect()] == ["sym:n.py::f"]


def test_long_configuration_dirty_facts_and_empty_tables(spark):
    text = "x: 1\n" * 200_000 + "handler: app.worker_pool\nworker_pool: 2\nodd: elsewhere.worker_pool\n"
    files = [("app/a.py", 1, "source", "r", "r"), ("conf.yaml", 2, "config", "r", "r"), ("bad.py", 3, "source", "r", "r"), ("nul.yaml", 4, "config", "r", "r")]
    symbols = [("app/a.py", 0, "worker_pool", "function", 1, "worker_pool", "", "confirmed"), ("gone.py", 0, "x", "function", 1, "x", "", "confirmed"), ("bad.py", 0, "y", "function", None, "y", "", "confirmed"), (None, 0, "z", "function", 1, "z", "", "confirmed")]
    edges = build(spark, files, symbols, texts=[("conf.yaml", "config", text), ("nul.yaml", "config", None)], bases=[("app/a.py", 0, "Q", None, 1, None), ("app/a.py", 1, "Q", "worker_pool", None, None)], status=[("app/a.py", "confirmed", ""), ("app/a.py", "confirmed", ""), ("bad.py", "unknown", "broken")])
    got = {(r["kind"], r["src"], r["dst"], r["note"], r["line"]) for r in edges.collect()}
    node = "sym:app/a.py::worker_pool"
    assert got == {("defines", "file:app/a.py", node, "", 1), ("configures", "file:conf.yaml", node, "app.worker_pool", 200_001), ("configures", "file:conf.yaml", node, "worker_pool", 200_002), ("extends", "file:app/a.py", node, "", None)}
    assert build(spark, [], [], status=[("x", "confirmed", "")]).count() == 0 and G.walk(edges.limit(0), node, 2).count() == 0

"""One small repository from its folder to reports."""

import pytest
from pyspark.sql import functions as F

from codeloom.operators import graph as G
from codeloom.operators import relational as R
from codeloom.plans import reports as P
from codeloom.sources import bodies as B
from codeloom.sources import extract as E
from codeloom.sources import repository as S

TREE = {
    "pyproject.toml": "[project]\nname = 'shop'\n[tool.pytest]\n",
    "shop/__init__.py": "",
    "shop/clean.py": 'LIMIT = 30\n\n\ndef trim_label(text):\n    """Trim a label."""\n    return text.strip()[:LIMIT]\n',
    "shop/orders.py": "import json\n\nfrom shop.clean import trim_label\n\n\nclass OrderBook:\n    def add(self, text):\n        self.keep(trim_label(text))\n\n    def keep(self, label):\n        # trim_label has run before\n        return json.dumps(label)\n\n\nclass RushBook(OrderBook):\n    def rush(self, text):\n        return self.add(text)\n",
    "shop/broken.py": "def f(:\n",
    "shop/gen/table.py": "# @generated by a tool\nX = 1\n",
    "tests/test_clean.py": "from shop.clean import trim_label\n\n\ndef test_trim():\n    assert trim_label(' a ') == 'a'\n",
    "web/app.ts": "import { show as render } from './view';\n\nexport class App {\n  run(): void {\n    render(1);\n  }\n}\n",
    "web/view.ts": "export const show = (x: number) => {\n  return x;\n};\n",
    "conf/settings.yaml": "hook: shop.clean.trim_label\n",
    "native/main.rs": "fn main() { trim_label(); }\n",
    "build/out.py": "trim_label = 1\n",
}


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    files = S.inventory(S.read_repository(spark, str(root)))
    files = S.inventory(S.read_repository(spark, str(root)), S.project_roots(files)).cache()
    facts = E.extract(files).cache()
    symbols = E.rows_of(facts, "symbols", "sym_seq").cache()
    imports, uses = E.resolved_imports(facts, files).cache(), E.rows_of(facts, "uses", "use_seq")
    edges = G.build_edges(files, S.project_roots(files), E.status(facts), symbols, imports, uses, E.rows_of(facts, "bases", "base_seq"), files).cache()
    return files, facts, symbols, imports, uses, edges


def test_inventory(shop):
    kinds = {r["path"]: (r["kind"], r["project"]) for r in shop[0].collect()}
    assert "build/out.py" not in kinds and len(kinds) == len(TREE) - 1
    assert {p: k for p, (k, _) in kinds.items() if k != "source"} == {"pyproject.toml": "manifest", "shop/gen/table.py": "generated", "tests/test_clean.py": "test", "conf/settings.yaml": "config"}
    assert {r["what"] for r in P.unavailable(E.status(shop[1]).filter("language <> ''"), ["python", "javascript", "typescript", "toml", "yaml"]).collect()} == {"rust: 1 file(s) without an extractor", "shop/broken.py: parse error"}
    assert {tuple(r) for r in P.steps(shop[0]).collect()} == {(".", "pytest")}


def test_references_tell_uses_imports_and_text(shop):
    files, _, symbols, imports, uses, _ = shop
    got = {tuple(r) for r in P.references(uses, imports, R.identifier_lines(files, "trim_label"), symbols, "trim_label").collect()}
    assert {(s, f, n) for s, f, n in got if s != "text"} == {("use", "shop/orders.py", 8), ("import", "shop/orders.py", 3), ("use", "tests/test_clean.py", 5), ("import", "tests/test_clean.py", 1)}
    assert {(f, n) for s, f, n in got if s == "text"} == {("shop/orders.py", 11), ("native/main.rs", 1), ("conf/settings.yaml", 1)}


def test_dependencies_tests_and_symbols(shop):
    files, _, symbols, imports, _, _ = shop
    names = imports.select("file", "resolved", F.coalesce(F.col("bindings")[0]["name"], "module").alias("name"))
    deps = {(r["path"], r["target"]): r["names"] for r in P.dependencies(names).collect()}
    assert deps[("shop/orders.py", "shop/clean.py")] == ["trim_label"] and deps[("shop/orders.py", None)] == ["json"] and ("web/app.ts", "web/view.ts") in deps
    homes = files.select("path", "kind", "project")
    assert {tuple(r) for r in P.importers_in_project(homes, imports, "shop/clean.py").collect()} == {("shop/orders.py", 1), ("tests/test_clean.py", 1)}
    assert {tuple(r) for r in P.tests_for_symbol(homes, symbols, files, "trim_label").collect()} == {("tests/test_clean.py", 2)}
    assert P.tests_for_symbol(homes, symbols, files, "rush").count() == 0 and P.tests_for_symbol(homes, symbols, files, "nowhere").count() == 0
    assert {tuple(r) for r in P.tests_for_file(homes, imports, symbols, files, "shop/clean.py").collect()} == {("tests/test_clean.py", 3)}
    shown = [r["summary"] for r in P.symbols_in(symbols.filter("file = 'shop/orders.py'")).orderBy("sym_seq").collect()]
    assert shown == ["6: OrderBook", "7: OrderBook.add (self, text)", "10: OrderBook.keep (self, label)", "15: RushBook (OrderBook)", "16: RushBook.rush (self, text)"]


def test_impact_and_consequences(shop):
    files, _, symbols, _, uses, edges = shop
    start = "sym:shop/clean.py::trim_label"
    sections = G.impact(edges, [start], 2)
    got = {(r["section"], G.plain_label(r["node"])) for r in sections.collect()}
    assert got == {
        ("direct-caller", "shop/orders.py::OrderBook.add"), ("direct-caller", "tests/test_clean.py::test_trim"), ("indirect-caller", "shop/orders.py::RushBook.rush"), ("callee", "shop/clean.py::LIMIT"),
        ("dependent-file", "shop/orders.py"), ("dependent-file", "tests/test_clean.py"), ("test", "tests/test_clean.py"), ("config", "conf/settings.yaml"),
    }
    said = {r["finding"]: r["amount"] for r in G.consequences(sections, files, [start], P.R.unsupported(files, list(E.EXTRACTORS), F.col("kind") == "source")).collect()}
    assert said == {"boundary": 3, "directories": 2, "direct-sites": 1, "indirect-callers": 1, "tests": 1, "config": 1, "overall": 6, "unsupported": 1}
    missing = {r["name"] for r in G.unresolved_calls(uses, edges).collect()}
    assert "trim_label" not in missing
    assert {r["callee"] for r in B.guarded_calls(files).filter("func = 'add'").collect()} == {"keep", "trim_label"}

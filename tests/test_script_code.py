import time

import pytest

from codeloom.sources import script_code as S

SOURCE = """import React, { useState as us, type Foo } from 'react';
import * as ns from "./ns";
import './side';
const { a, b: c } = require('./req');
const fs = require("fs");
export const LIMIT = 30 * 2;
export default class App<T> extends ns.Base<T> implements One, Two {
  #z = /[/]\\/x{/g;
  constructor(private a: string, b = {x: 1}, ...rest) { super(); this.go(`t ${a + `u ${b}`} {`); }
  static async run(x: number): Promise<void> {
    if (x) { fs.readFile(x, () => { inner(); }); }
    return new Thing(x).done();
  }
}
export interface I extends J, K<string> { m(): void; }
type U<T> = 'a' | T;
enum E { A }
const add = async ({a}, b): Promise<{x: number}> => {
  return helper(a);
};
const small = x => x + 1;
app.get('/users', (req, res) => { res.send(1); });
function* gen(a, b = 2) { yield a; }
export { gen as generator, small };
module.exports.extra = 1;
import("./lazy").then(x => x);
"""


def test_declarations():
    f = S.facts(SOURCE)
    got = {s["qualname"]: (s["kind"], s["line"], s["end_line"], s["signature"], s["exported"]) for s in f.symbols}
    assert got["App"] == ("class", 7, 14, "", True) and got["App.constructor"] == ("method", 9, 9, "(a, b, ...rest)", True)
    assert got["App.run"][:3] == ("method", 10, 13) and got["LIMIT"] == ("constant", 6, None, "30 * 2", True)
    assert got["add"][:3] == ("function", 18, 20) and got["small"][0] == "function" and got["gen"] == ("function", 23, 23, "(a, b)", True)
    assert {got[n][0] for n in ("I", "U", "E", "/users")} == {"interface", "type", "enum", "route"}
    assert f.exports == ["App", "I", "LIMIT", "gen", "small"]
    assert [(b["qualname"], b["base"], b["relation"]) for b in f.bases] == [("App", "ns.Base", "extends"), ("App", "One", "implements"), ("App", "Two", "implements"), ("I", "J", "extends"), ("I", "K", "extends")]


def test_imports_and_calls():
    f = S.facts(SOURCE)
    assert [i["module"] for i in f.imports] == ["react", "./ns", "./side", "./req", "fs", "./lazy"]
    assert f.imports[0]["bindings"] == [{"name": "default", "alias": "React"}, {"name": "useState", "alias": "us"}, {"name": "Foo", "alias": "Foo"}]
    assert f.imports[1]["bindings"] == [{"name": None, "alias": "ns"}] and f.imports[3]["bindings"] == [{"name": "a", "alias": "a"}, {"name": "b", "alias": "c"}]
    calls = {(u["name"], u["receiver"], u["scope"]) for u in f.uses}
    assert {("go", "this", "App.constructor"), ("readFile", "fs", "App.run"), ("inner", "", "App.run"), ("helper", "", "add"), ("send", "res", "")} <= calls
    assert not {n for n, _, _ in calls} & {"if", "super", "async", "m", "run", "gen"}


@pytest.mark.parametrize("text", ["", "class A {", "import {", "import", "export", "const x =", "`${`", "function f(", "class", "}}}", "const {a", "a.b.(", "interface I<", "x = '", "/* open", "enum"])
def test_source_that_stops_in_the_middle(text):
    S.facts(text)


def test_deep_and_long_source():
    began = time.perf_counter()
    S.facts("f(" * 20_000)
    S.facts("class A{m(){}}" * 5_000)
    S.facts("`${" * 5_000)
    assert time.perf_counter() - began < 5

import random
from collections import defaultdict

import pytest

from codeloom.operators import hierarchy as H


def brute(nodes, edges):
    up = defaultdict(set)
    known = set(nodes)
    for t, n, u in edges:
        if (t, n) in known and (t, u) in known:
            up[t, n].add(u)
    pairs = set()
    for t, n in known:
        seen, work = set(), [*up[t, n]]
        while work:
            x = work.pop()
            if x not in seen:
                seen.add(x)
                work += up[t, x]
        pairs |= {(t, n, a) for a in seen}
    return pairs


def run(spark, nodes, edges):
    n = spark.createDataFrame(nodes, "tree string, node string, extra string") if nodes and len(nodes[0]) == 3 else spark.createDataFrame(nodes, "tree string, node string")
    e = spark.createDataFrame(edges, "tree string, node string, up string")
    got = [tuple(r) for r in H.ancestor_pairs(n, e).select("tree", "node", "above").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_with_cycles_and_several_uppers(spark, seed):
    rng = random.Random(seed)
    nodes = [(t, f"n{i:02}") for t in "ab" for i in range(25)]
    edges = [(t, f"n{rng.randrange(25):02}", f"n{rng.randrange(27):02}") for t in "ab" for _ in range(18)]
    assert run(spark, nodes, edges) == brute(nodes, edges)


def test_long_chain_hot_parent_loop_nulls_and_repeats(spark):
    nodes = [("t", f"c{i:03}") for i in range(70)] + [("t", f"k{i:03}") for i in range(150)] + [("t", None), ("t", "c000"), ("t", "self")]
    edges = [("t", f"c{i:03}", f"c{i - 1:03}") for i in range(1, 70)] + [("t", f"k{i:03}", "c069") for i in range(150)] + [("t", "self", "self"), ("t", None, "c000"), ("t", "c001", None), ("t", "c001", "c000"), ("t", "c003", "gone")]
    clean = [(t, n) for t, n in nodes if n]
    assert run(spark, nodes, edges) == brute(clean, [e for e in edges if all(e)])


def test_empty_tables(spark):
    assert run(spark, [], []) == set()


def test_paths_depth_and_counts(spark):
    nodes = spark.createDataFrame([("t", x) for x in "abcdxy"], "tree string, node string")
    edges = spark.createDataFrame([("t", "b", "a"), ("t", "c", "b"), ("t", "d", "a"), ("t", "x", "y"), ("t", "y", "x")], "tree string, node string, up string")
    rows = {r["node"]: r for r in H.hierarchy(nodes, edges).collect()}
    assert rows["c"]["path"] == "a > b > c" and rows["c"]["depth"] == 2 and rows["c"]["root"] == "a"
    assert rows["a"]["descendants"] == 3 and rows["c"]["ancestors"] == 2
    assert rows["x"]["on_cycle"] and rows["y"]["on_cycle"] and not rows["a"]["on_cycle"]
    assert sorted(rows[n]["pre"] for n in "abcd") == [0, 1, 2, 3] and [rows[n]["size"] for n in "abcd"] == [4, 2, 1, 1]
    assert rows["c"]["pre"] == rows["b"]["pre"] + 1


def test_symbol_links_prefer_the_own_file(spark):
    symbols = spark.createDataFrame([("p/a.py", "A", "class", ""), ("p/a.py", "B", "class", None), ("p/b.py", "A", "class", ""), ("p/b.py", "A.m", "method", "A"), ("p/b.py", "A.m", "method", "A")], "file string, qualname string, kind string, parent string")
    bases = spark.createDataFrame([("p/a.py", "B", "A"), ("p/b.py", "A", "p.a.A"), ("p/b.py", "A", None), ("p/b.py", "A", "object")], "file string, qualname string, base string")
    got = {tuple(r) for r in H.ancestor_pairs(*H.symbol_links(symbols, bases)).select("tree", "node", "above").collect()}
    assert got == {("parent", "p/b.py::A.m", "p/b.py::A"), ("base", "p/a.py::B", "p/a.py::A"), ("base", "p/b.py::A", "p/a.py::A")}

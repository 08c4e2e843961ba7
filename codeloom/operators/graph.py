"""The relationship graph: edges from extracted tables, bounded traversal, and dumps of one node.

Edges are (edge_seq, src, dst, kind, confidence, line, note); edge_seq is unique and of any type that has
an order. Of edges of one src, dst, kind and line the first stands; edges of a node to itself are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions import text as X
from codeloom.operators.relational import distinctive, longest_prefix
from codeloom.runtime import checkpoint, checkpoint_counting, dense_rank

#: Method names of built-in types, which link only within a file and its imports.
BUILTIN_METHODS = sorted({n for t in (dict, list, str, set, tuple, bytes, int, float) for n in dir(t) if not n.startswith("_")})
KINDS = ("calls", "references", "extends", "implements")


def first_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each (src, dst, kind, line), loops left out."""
    rest = F.struct("edge_seq", "confidence", "note")
    rows = edges.filter(F.col("src") != F.col("dst")).groupBy("src", "dst", "kind", "line").agg(F.min(rest).alias("e"))
    return rows.select("e.edge_seq", "src", "dst", "kind", "e.confidence", "line", "e.note")


def neighbourhood(edges: DataFrame, node: str) -> DataFrame:
    """(direction, kind, other, confidence, line): all edges of one node."""
    out = edges.filter(F.col("src") == node).select(F.lit("outgoing").alias("direction"), "kind", F.col("dst").alias("other"), "confidence", "line")
    return out.unionByName(edges.filter(F.col("dst") == node).select(F.lit("incoming").alias("direction"), "kind", F.col("src").alias("other"), "confidence", "line"))


def walk(edges: DataFrame, start: str, depth: int, upstream: bool = True, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(node, depth, rank, chain, confidence): breadth-first, each node claimed by the first edge of the first parent.

    One join and one aggregate a level; only the frontier moves. A node's turn in the queue is the list of the edges that led
    to it, so turns compare without numbering a level; ranks are numbered at the end. The confidence is the weakest on the
    chain.
    """
    near, far = ("dst", "src") if upstream else ("src", "dst")
    usable = edges if kinds is None else edges.filter(F.col("kind").isin(*kinds))
    step = usable.select(F.col(near).alias("at"), F.col(far).alias("node"), "edge_seq", X.rank_in(F.col("confidence"), X.CONFIDENCES).alias("c"))
    session = edges.sparkSession
    first = session.createDataFrame([(start, 0, [plain_label(start)], 0)], "node string, depth int, chain array<string>, c int")
    found = first.withColumn("turn", F.array().cast(T.ArrayType(edges.schema["edge_seq"].dataType)))
    frontier = found
    for d in range(1, depth + 1):
        ahead = frontier.select(F.col("node").alias("at"), "turn", F.col("chain").alias("way"), F.col("c").alias("pc"))
        claim = F.min(F.struct("turn", "edge_seq", "way", F.greatest("pc", "c").alias("c"))).alias("m")
        level = step.join(ahead, "at").join(found.select("node"), "node", "left_anti").groupBy("node").agg(claim)
        level = level.select("node", F.lit(d).alias("depth"), F.concat("m.way", F.array(X.node_label(F.col("node")))).alias("chain"), F.col("m.c").alias("c"), F.concat("m.turn", F.array("m.edge_seq")).alias("turn"))
        frontier, n = checkpoint_counting(level)
        if not n:
            break
        found = found.unionByName(frontier)
    ranked = dense_rank(found.filter("depth > 0"), ["depth", "turn"], "rank")
    before = ranked.groupBy("depth").agg((F.min("rank") - 1).alias("_before"))
    return ranked.join(before, "depth").select("node", "depth", (F.col("rank") - F.col("_before")).alias("rank"), "chain", X.named_rank(F.col("c"), X.CONFIDENCES).alias("confidence"))


def plain_label(node: str) -> str:
    return node.split(":", 1)[-1]


def merge_starts(walks: list[DataFrame], shallower: bool) -> DataFrame:
    """Walks of several starts as one: of each node the first start's row, or the shallowest and then the first."""
    rows = [w.withColumn("start_seq", F.lit(i)) for i, w in enumerate(walks)]
    everything = reduce(DataFrame.unionByName, rows)
    order = ["depth", "start_seq"] if shallower else ["start_seq"]
    return everything.withColumn("_n", F.row_number().over(Window.partitionBy("node").orderBy(*order))).filter("_n = 1").drop("_n")


# ---------------------------------------------------------------- building


#: Edges stand in this order: files in theirs; in a file definitions, imports, calls, references and bases, each in their
#: places; of one place the targets in theirs, and an edge before the test edge that it gives. Configuration comes last.
ORDER = "struct<part:int,file_seq:bigint,stage:int,at:bigint,to_file:bigint,to_at:bigint,twin:int>"


def _order(stage: int, at: Column | str, to_file: Column | None = None, to_at: Column | None = None, twin: int = 0, part: int = 0) -> Column:
    none = F.lit(0).cast("long")
    at = F.col(at) if isinstance(at, str) else at
    values = [F.lit(part), F.col("file_seq").cast("long"), F.lit(stage), at.cast("long"), none if to_file is None else to_file.cast("long"), none if to_at is None else to_at.cast("long"), F.lit(twin)]
    names = ("part", "file_seq", "stage", "at", "to_file", "to_at", "twin")
    return F.struct(*[v.alias(n) for v, n in zip(values, names)])


def build_edges(files: DataFrame, roots: DataFrame, status: DataFrame, symbols: DataFrame, imports: DataFrame, uses: DataFrame, bases: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """All edges of eight kinds.

    files: path, file_seq, kind and, where the table holds several repositories, root; project, or else it is the longest of
    ``roots``, a column of folders, above the path; status: file, confidence,
    error; symbols (sym_seq), imports (import_seq, with resolved), uses (use_seq) and bases (base_seq) as the extractors give
    them, each number unique in its file; texts: path, kind, text of configuration files. Files with an error give no edges,
    nor do symbols of files that are not listed. Names are looked for within one root.

    A use is resolved by the first rule whose condition holds, not by the first that finds something: a module alias; an
    attribute of self; self itself, along the bases of its class; an imported class; any other receiver; and for bare names an
    import, the file's own top level, then the same name elsewhere.
    """
    good = status.filter(F.coalesce("error", F.lit("")) == "").select("file", F.col("confidence").alias("own")).dropDuplicates(["file"])
    if "project" not in files.columns:
        files = longest_prefix(files, "path", roots.select(F.col(roots.columns[0]).alias("_root")), "_root", "project")
    root = F.coalesce("root", F.lit(".")) if "root" in files.columns else F.lit(".")
    home = checkpoint(files.select(F.col("path").alias("file"), F.col("file_seq").cast("long").alias("file_seq"), root.alias("root"), "project", (F.col("kind") == "test").alias("is_test"), F.col("kind").isin("source", "script", "test").alias("is_code")))
    syms = symbols.select("file", "sym_seq", "name", "kind", "line", "qualname", F.coalesce("parent", F.lit("")).alias("parent"), "confidence").dropna(subset=["file", "qualname"])
    syms = checkpoint(syms.join(home, "file").withColumn("node", X.symbol_node(F.col("file"), F.col("qualname"))))
    top = syms.filter("parent = ''")

    def edge(rows: DataFrame, order: Column, src: Column, dst: Column, kind: Column | str, confidence: str, note: Column | None = None) -> DataFrame:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return rows.select(order.alias("edge_seq"), src.alias("src"), dst.alias("dst"), kind.alias("kind"), F.col(confidence).alias("confidence"), F.col("line").cast("int").alias("line"), (F.lit("") if note is None else note).alias("note"))

    here = X.file_node(F.col("file"))
    defines = edge(syms.join(good.select("file"), "file", "left_semi"), _order(1, "sym_seq"), here, F.col("node"), "defines", "confidence")
    done = checkpoint(imports.filter(F.col("resolved").isNotNull()).join(good, "file").join(home.select("file", "file_seq", "is_test"), "file"))
    names = F.transform(F.filter("bindings", lambda b: b["name"].isNotNull()), lambda b: b["name"])
    there = X.file_node(F.col("resolved"))
    importing = edge(done, _order(2, "import_seq", twin=0), here, there, "imports", "confidence", F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("(module)"))
    testing = edge(done.filter("is_test"), _order(2, "import_seq", twin=1), here, there, "tests", "confidence")

    # What each name of a file is bound to: the last import that finds something decides.
    bound = done.select("file", "resolved", "import_seq", F.posexplode("bindings").alias("_n", "b")).select("file", "resolved", F.struct("import_seq", "_n").alias("turn"), F.col("b.name").alias("name"), F.col("b.alias").alias("alias"))
    target = top.select(F.col("file").alias("resolved"), "name", F.col("node").alias("dst"), F.col("qualname").alias("dst_qualname"), F.col("file_seq").alias("to_file"), F.col("sym_seq").alias("to_at"))
    met = bound.filter("name is not null").join(target, ["resolved", "name"])
    latest = met.groupBy("file", "alias").agg(F.max("turn").alias("turn"))
    bindings = checkpoint(met.join(latest, ["file", "alias", "turn"], "left_semi").select("file", "alias", "resolved", "dst", "dst_qualname", "to_file", "to_at").distinct())
    whole = bound.filter("name is null").select("file", "alias", F.col("resolved").alias("module"), "turn")
    inner = bound.filter(F.col("name").isNotNull() & F.col("resolved").endswith("__init__.py")).join(met.select("file", "alias", "turn").distinct(), ["file", "alias", "turn"], "left_anti")
    folder = F.regexp_replace("resolved", r"__init__\.py$", "")
    inner = inner.select("file", "alias", "turn", F.posexplode(F.array(F.concat(folder, "name", F.lit(".py")), F.concat(folder, "name", F.lit("/__init__.py")))).alias("at", "module"))
    inner = inner.join(home.select(F.col("file").alias("module")), "module", "left_semi").groupBy("file", "alias", "turn").agg(F.min_by("module", "at").alias("module"))
    aliases = checkpoint(whole.unionByName(inner.select("file", "alias", "module", "turn")).groupBy("file", "alias").agg(F.max_by("module", "turn").alias("module")))

    # What each use asks for, and which rule answers.
    short = lambda c: F.element_at(F.split(c, r"\."), -1)
    asks = uses.select("file", F.col("use_seq").cast("long").alias("at"), "use_kind", short("name").alias("short"), "line", F.coalesce("scope", F.lit("")).alias("scope"), F.coalesce("receiver", F.lit("")).alias("receiver"), F.lit(False).alias("is_base"))
    parents = bases.dropna(subset=["base", "qualname"]).select("file", F.col("base_seq").cast("long").alias("at"), F.coalesce("relation", F.lit("extends")).alias("use_kind"), short("base").alias("short"), "line", F.col("qualname").alias("scope"), F.when(F.col("base").contains("."), F.regexp_replace("base", r"\.[^.]*$", "")).otherwise("").alias("head"))
    alias_only = aliases.select("file", F.col("alias").alias("head"), F.lit(True).alias("_m"))
    parents = parents.join(alias_only, ["file", "head"], "left").select("file", "at", "use_kind", "short", "line", "scope", F.when(F.col("_m"), F.col("head")).otherwise("").alias("receiver"), F.lit(True).alias("is_base"))
    asks = asks.unionByName(parents).join(good, "file").join(home.select("file", "file_seq", "root", "is_test", "project"), "file").withColumn("ask", F.monotonically_increasing_id())
    asks = asks.withColumn("head", F.split_part("receiver", F.lit("."), F.lit(1))).withColumn("bare", F.col("receiver") == F.col("head"))
    asks = asks.join(aliases.select("file", F.col("alias").alias("head"), "module"), ["file", "head"], "left")
    asks = asks.join(bindings.select("file", F.col("alias").alias("head")).distinct().withColumn("_class", F.lit(True)), ["file", "head"], "left")
    own = F.col("head").isin("self", "cls", "this", "super")
    rule = (
        F.when((F.col("receiver") != "") & F.col("module").isNotNull() & F.col("bare"), "module")
        .when((F.col("receiver") != "") & own & ~F.col("bare"), "unknown")
        .when((F.col("receiver") != "") & own, "self")
        .when((F.col("receiver") != "") & F.col("_class") & F.col("bare"), "class")
        .when(F.col("receiver") != "", "unknown")
        .otherwise("bare")
    )
    asks = checkpoint(asks.withColumn("rule", rule))
    cols = ["ask", "file", "file_seq", "at", "use_kind", "line", "scope", "is_test", "is_base", "own"]
    to = ["dst", "to_file", "to_at"]
    goal = syms.select(F.col("file").alias("dfile"), F.col("name").alias("short"), F.col("parent").alias("dparent"), F.col("kind").alias("dkind"), F.col("node").alias("dst"), F.col("root").alias("droot"), F.col("project").alias("dproject"), F.col("is_code").alias("dcode"), F.col("file_seq").alias("to_file"), F.col("sym_seq").alias("to_at"))
    sure, guess = F.col("own").alias("confidence"), F.lit("inferred").alias("confidence")

    def of(name: str) -> DataFrame:
        return asks.filter(F.col("rule") == name)

    hit_module = of("module").join(goal.filter("dparent = ''"), (F.col("module") == F.col("dfile")) & (asks["short"] == goal["short"])).select(*cols, *to, sure)
    imported = done.select("file", F.col("resolved").alias("dfile")).distinct().withColumn("_imported", F.lit(True))
    method = goal.filter((F.col("dparent") != "") & (F.col("dkind") == "method") & F.col("dcode")).withColumnRenamed("droot", "root").withColumnRenamed("dproject", "project")
    # Methods that built-in types have too are looked for in the file and its imports only, so they join on the file.
    usual = of("unknown").filter(F.col("short").isin(BUILTIN_METHODS))
    within = imported.select("file", "dfile").unionByName(usual.select("file", F.col("file").alias("dfile"))).distinct()
    hit_usual = usual.join(within, "file").join(method, ["root", "project", "dfile", "short"]).select(*cols, *to, guess)
    hit_unknown = of("unknown").filter(~F.col("short").isin(BUILTIN_METHODS)).join(method, ["root", "project", "short"]).select(*cols, *to, guess)
    hit_class = of("class").join(bindings.select("file", F.col("alias").alias("head"), F.col("resolved").alias("dfile"), F.col("dst_qualname").alias("dparent")).distinct(), ["file", "head"]).join(goal, ["dfile", "dparent", "short"]).select(*cols, *to, guess)
    hit_self = _self_targets(of("self"), goal, bases, cols, to)

    plain = of("bare").select(*cols, "short", "root")
    by_import = plain.join(bindings.select("file", F.col("alias").alias("short"), *to), ["file", "short"]).select(*cols, *to, sure)
    rest = plain.join(bindings.select("file", F.col("alias").alias("short")).distinct(), ["file", "short"], "left_anti")
    near = goal.filter("dparent = ''").select(F.col("dfile").alias("file"), "short", *to)
    by_file = rest.join(near, ["file", "short"]).select(*cols, *to, sure)
    # Only names that the file neither imports nor defines go to the others; those are all in other files then.
    rest = rest.join(near.select("file", "short").distinct(), ["file", "short"], "left_anti")
    by_name = rest.join(goal.filter((F.col("dparent") == "") & F.col("dcode")).select(F.col("droot").alias("root"), "short", *to), ["root", "short"]).select(*cols, *to, guess)
    hits = reduce(DataFrame.unionByName, [hit_module, hit_usual, hit_unknown, hit_class, hit_self, by_import, by_file, by_name])
    scopes = syms.select("file", F.col("qualname").alias("scope"), F.col("node").alias("scope_node")).distinct()
    hits = checkpoint(hits.join(scopes, ["file", "scope"], "left").withColumn("src", F.coalesce("scope_node", here)))
    calls = hits.filter("use_kind = 'call' and not is_base")
    refs = hits.filter("use_kind = 'reference' and not is_base and src <> dst").join(calls.select("src", "dst", "line").distinct(), ["src", "dst", "line"], "left_anti")
    parts = [defines, importing, testing]
    for stage, rows, kind in ((3, calls, "calls"), (4, refs, "references")):
        parts.append(edge(rows, _order(stage, "at", F.col("to_file"), F.col("to_at"), 0), F.col("src"), F.col("dst"), kind, "confidence"))
        parts.append(edge(rows.filter("is_test"), _order(stage, "at", F.col("to_file"), F.col("to_at"), 1), here, F.col("dst"), "tests", "confidence"))
    parts.append(edge(hits.filter("is_base"), _order(5, "at", F.col("to_file"), F.col("to_at")), F.col("src"), F.col("dst"), F.col("use_kind"), "confidence"))
    if texts is not None:
        parts.append(_config_edges(texts, home, top))
    return first_edges(reduce(DataFrame.unionByName, parts))


def _self_targets(asks: DataFrame, goal: DataFrame, bases: DataFrame, cols: list[str], to: list[str] = ["dst"]) -> DataFrame:  # noqa: B006
    """Methods of self: of the own class, else of the nearest class up its bases in the file, however far, else any method of the file."""
    owner = F.when(F.col("scope").contains("."), F.regexp_replace("scope", r"\.[^.]*$", "")).otherwise(F.col("scope"))
    open_ = asks.select("ask", "file", "short", owner.alias("cls"), F.lit(0).alias("depth"))
    up = bases.select("file", F.col("qualname").alias("cls"), F.element_at(F.split("base", r"\."), -1).alias("next")).distinct()
    methods = goal.select(F.col("dfile").alias("file"), "short", F.col("dparent").alias("cls"), *to, "dkind")
    found = open_.join(methods, ["file", "short", "cls"]).select("ask", *to, "depth")
    seen, level, hits, d = open_, open_, found, 0
    while True:  # ends: a level holds only classes not seen before, and a file has finitely many
        d += 1
        level = level.join(found.select("ask").distinct(), "ask", "left_anti").join(up, ["file", "cls"]).select("ask", "file", "short", F.col("next").alias("cls"), F.lit(d).alias("depth")).distinct()
        level, n = checkpoint_counting(level.join(seen.select("ask", "cls"), ["ask", "cls"], "left_anti").select("ask", "file", "short", "cls", "depth"))
        if not n:
            break
        seen = seen.unionByName(level)
        found = level.join(methods, ["file", "short", "cls"]).select("ask", *to, "depth")
        hits = hits.unionByName(found)
    first = hits.withColumn("_d", F.min("depth").over(Window.partitionBy("ask"))).filter("depth = _d").select("ask", *to)
    rest = open_.join(hits.select("ask").distinct(), "ask", "left_anti").join(methods.filter("dkind = 'method'").drop("cls"), ["file", "short"]).select("ask", *to)
    known = asks.select(*cols)
    return known.join(first, "ask").select(*cols, *to, F.col("own").alias("confidence")).unionByName(known.join(rest, "ask").select(*cols, *to, F.lit("inferred").alias("confidence")))


def _config_edges(texts: DataFrame, home: DataFrame, top: DataFrame) -> DataFrame:
    """Configuration files that name a symbol of their root, dotted with parts of its path, or plain if the name is distinctive."""
    rows = texts.filter(F.col("kind").isin("config", "manifest") & F.col("text").isNotNull()).select(F.col("path").alias("cfile"), F.posexplode(X.lines_of(F.col("text"))).alias("at", "row"))
    tokens = rows.select("cfile", (F.col("at") + 1).alias("row_at"), F.posexplode(F.regexp_extract_all("row", F.lit(r"[A-Za-z_][\w.]*"), F.lit(0))).alias("_n", "token"))
    tokens = tokens.groupBy("cfile", "row_at", "token").agg(F.min("_n").alias("_n")).withColumn("parts", F.split("token", r"\.")).withColumn("name", F.element_at("parts", -1))
    tokens = tokens.filter((F.col("name") != "") & ((F.size("parts") >= 2) | distinctive(F.col("name"))))
    tokens = tokens.join(home.select(F.col("file").alias("cfile"), "root", F.col("file_seq").alias("cseq")), "cfile")
    met = tokens.join(top.select("name", "root", "file", "node", F.col("file_seq").alias("to_file"), F.col("sym_seq").alias("to_at")), ["root", "name"])
    stem = F.regexp_replace(X.name_of(F.col("file")), r"(?<=[^.])\.[^.]+$", "")
    dotted = F.forall(F.slice("parts", F.lit(1), F.size("parts") - 1), lambda p: F.array_contains(F.split(F.col("file"), "/"), p) | F.contains(stem, p))
    kept = met.filter((F.size("parts") < 2) | dotted).withColumn("file_seq", F.col("cseq"))
    order = _order(6, F.shiftleft(F.col("row_at").cast("long"), 31) + F.col("_n"), F.col("to_file"), F.col("to_at"), part=1)
    return kept.select(order.alias("edge_seq"), X.file_node(F.col("cfile")).alias("src"), F.col("node").alias("dst"), F.lit("configures").alias("kind"), F.lit("inferred").alias("confidence"), F.col("row_at").cast("int").alias("line"), F.col("token").alias("note"))


# ---------------------------------------------------------------- reports


def _touching(edges: DataFrame, near: str, nodes: list[str], kinds: tuple[str, ...]) -> DataFrame:
    """(other, kinds, edges, c): the other ends of the edges of some nodes, each once, with the weakest rank of confidence."""
    far = "src" if near == "dst" else "dst"
    rows = edges.filter(F.col(near).isin(*nodes) & F.col("kind").isin(*kinds))
    return rows.groupBy(F.col(far).alias("other")).agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.count("*").alias("edges"), F.max(X.rank_in(F.col("confidence"), X.CONFIDENCES)).alias("c"))


def impact(edges: DataFrame, starts: list[str], depth: int = 2) -> DataFrame:
    """(section, node, depth, chain, confidence): what a change of the starts may touch, section by section.

    Sections: direct-caller and indirect-caller along uses, callee, dependency and dependent-file along imports, related-type,
    test and config. Several starts are one target: of a node reached from several the first start's row stands, of a
    dependent file the shallowest.
    """
    homes = sorted({f"file:{plain_label(s).split('::')[0]}" for s in starts})
    named = lambda c: X.named_rank(F.col(c), X.CONFIDENCES).alias("confidence")

    def near(section: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(section).alias("section"), F.col("other").alias("node"), F.lit(1).alias("depth"), F.array(X.node_label(F.col("other"))).alias("chain"), named("c"))

    direct = checkpoint(_touching(edges, "dst", starts, KINDS))
    callers = merge_starts([walk(edges, s, depth, True, KINDS).filter("depth > 1") for s in starts], shallower=False)
    callers = callers.join(direct.select(F.col("other").alias("node")), "node", "left_anti")
    files = merge_starts([walk(edges, f, depth, True, ("imports",)) for f in homes], shallower=True)
    types = ("extends", "implements")
    related = _touching(edges, "dst", starts, types).unionByName(_touching(edges, "src", starts, types)).groupBy("other").agg(F.max("c").alias("c"))
    by_file = lambda kind: _touching(edges, "dst", [*starts, *homes], (kind,)).groupBy(X.file_node(X.node_file(F.col("other"))).alias("other")).agg(F.max("c").alias("c"))
    parts = [
        near("direct-caller", direct),
        callers.select(F.lit("indirect-caller").alias("section"), "node", "depth", "chain", "confidence"),
        near("callee", _touching(edges, "src", starts, KINDS)),
        near("dependency", _touching(edges, "src", homes, ("imports",))),
        files.select(F.lit("dependent-file").alias("section"), "node", "depth", "chain", "confidence"),
        near("related-type", related),
        near("test", by_file("tests")),
        near("config", by_file("configures")),
    ]
    return reduce(DataFrame.unionByName, parts)


def consequences(sections: DataFrame, files: DataFrame, starts: list[str], unsupported: DataFrame | None = None) -> DataFrame:
    """(finding, amount, confidence): what the sections of an impact come to.

    files: path, kind. boundary: the affected files; directories: their top folders; direct-sites: direct callers outside of
    tests; indirect-callers, subtypes, tests, untested, config; overall: the weakest confidence of direct callers, dependents,
    callees and tests. Findings that come to nothing are left out. unsupported: language, files.
    """
    rows = checkpoint(sections.withColumn("_f", X.node_file(F.col("node"))).withColumn("_c", X.rank_in(F.col("confidence"), X.CONFIDENCES)))
    rows = rows.join(files.select(F.col("path").alias("_f"), (F.col("kind") == "test").alias("_test")).distinct(), "_f", "left")
    homes = sorted({plain_label(s).split("::")[0] for s in starts})
    own = rows.sparkSession.createDataFrame([(h,) for h in homes], "_f string")
    affected = rows.filter(F.col("section").isin("direct-caller", "indirect-caller", "dependent-file")).select("_f").union(own).distinct()
    spread = affected.agg(F.count("*").alias("n"), F.count_distinct(X.top_dir(F.col("_f"))).alias("d"))
    inferred, worst = F.lit("inferred").alias("confidence"), lambda d: d.agg(F.count("*").alias("amount"), X.worst(F.col("confidence"), X.CONFIDENCES).alias("confidence"))

    def say(finding: str, d: DataFrame) -> DataFrame:
        return d.select(F.lit(finding).alias("finding"), F.col("amount").cast("long").alias("amount"), "confidence")

    of = lambda section: rows.filter(F.col("section") == section)
    tests = of("test").agg(F.count("*").alias("amount"))
    parts = [
        say("boundary", spread.select(F.col("n").alias("amount"), inferred)),
        say("directories", spread.filter("d > 1").select(F.col("d").alias("amount"), inferred)),
        say("direct-sites", of("direct-caller").agg(F.count(F.when(~F.coalesce("_test", F.lit(False)), 1)).alias("amount"), X.worst(F.col("confidence"), X.CONFIDENCES).alias("confidence")).filter("amount > 0")),
        say("indirect-callers", worst(of("indirect-caller")).filter("amount > 0")),
        say("tests", tests.filter("amount > 0").select("amount", inferred)),
        say("untested", tests.filter("amount = 0").select("amount", inferred)),
        say("config", of("config").agg(F.count("*").alias("amount")).filter("amount > 0").select("amount", inferred)),
        say("overall", worst(rows.filter(F.col("section").isin("direct-caller", "dependent-file", "callee", "test"))).select("amount", F.when(F.col("amount") > 0, F.col("confidence")).otherwise("inferred").alias("confidence"))),
    ]
    if unsupported is not None:
        parts.append(say("unsupported", unsupported.agg(F.sum("files").alias("amount")).filter("amount > 0").select("amount", F.lit("unknown").alias("confidence"))))
    return reduce(DataFrame.unionByName, parts)


KIND_RANK = {"function": 0, "method": 0, "route": 0, "class": 1, "interface": 1, "type": 1, "enum": 1, "constant": 2, "variable": 2}


def trace(edges: DataFrame, symbols: DataFrame, start: str, depth: int = 3) -> DataFrame:
    """(direction, node, depth, chain, confidence, cause_rank): both ways from a symbol; downstream nodes ranked as causes.

    Causes rank by depth, then kind of symbol, then other files before the own one, then label.
    """
    down, up = walk(edges, start, depth, False, KINDS), walk(edges, start, depth, True, KINDS)
    kinds = symbols.select(X.symbol_node(F.col("file"), F.col("qualname")).alias("node"), "kind").groupBy("node").agg(F.min("kind").alias("kind"))
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KIND_RANK.items() for x in kv]), F.col("kind")), F.lit(3))
    own = X.node_file(F.col("node")) == start.split(":", 1)[1].split("::")[0]
    causes = dense_rank(down.join(kinds, "node", "left").select("node", "depth", "chain", "confidence", rank.alias("_k"), own.alias("_own")), ["depth", "_k", "_own", "node"], "cause_rank")
    causes = causes.select(F.lit("downstream").alias("direction"), "node", "depth", "chain", "confidence", "cause_rank")
    return causes.unionByName(up.select(F.lit("upstream").alias("direction"), "node", "depth", "chain", "confidence", F.lit(None).cast("long").alias("cause_rank")))


def next_steps(traced: DataFrame, limit: int = 3) -> DataFrame:
    """(step, node): what to look at next: the first causes in their order, then the nearest caller."""
    causes = traced.filter(F.col("cause_rank") <= limit).select(F.col("cause_rank").cast("int").alias("step"), "node")
    caller = traced.filter("direction = 'upstream'").orderBy("depth", "node").limit(1).select(F.lit(limit + 1).alias("step"), "node")
    return causes.unionByName(caller)


def unresolved_calls(uses: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls by bare name that lead to no symbol and are no built-in function."""
    import builtins

    known = edges.filter("kind = 'calls'").select(F.element_at(F.split(X.node_label(F.col("dst")), r"[.:]"), -1).alias("name")).distinct()
    calls = uses.filter((F.col("use_kind") == "call") & (F.coalesce("receiver", F.lit("")) == "") & ~F.col("name").isin(*dir(builtins)))
    return calls.join(known, "name", "left_anti").groupBy("name").agg(F.count("*").alias("calls"), F.count_distinct("file").alias("files"))

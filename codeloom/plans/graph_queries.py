"""Queries over the relationship graph, with their SQL.

The graph of these queries is built by ``graph.build_edges`` from facts that SQL can derive from the tables too:
symbols and bases as they stand, calls by name on the lines of hits, imports of the modules that dotted bases name,
and configuration texts. ``gra01_edge_counts`` builds it from extracted facts instead, which SQL cannot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators import changes as C
from codeloom.operators import graph as G
from codeloom.operators import relational as R
from codeloom.plans import reference as P
from codeloom.plans import reports
from codeloom.plans.registry import registrar
from codeloom.runtime import checkpoint, table
from codeloom.sources import extract as E

QUERIES: dict[str, object] = {}
ORACLES: dict[str, str] = {}
query = registrar(QUERIES, ORACLES)


def _homes(spark: SparkSession, d: str) -> DataFrame:
    """(path, file_seq, kind, project, root): project is the deepest project root above a file, root the outermost."""
    roots = table(spark, d, "project_roots")
    files = R.longest_prefix(P._files(spark, d, "file_seq", "kind"), "path", roots, "root", "project")
    return R.longest_prefix(files, "path", roots, "root", "root", shortest=True)


def _imports(spark: SparkSession, d: str) -> DataFrame:
    """The modules that the dotted bases of a file name, as imports of the class."""
    named = P.join01_module_of_base(spark, d).filter("resolved is not null")
    lines = table(spark, d, "bases").groupBy("file", "base").agg(F.min("line").alias("line"))
    rows = named.join(lines, ["file", "base"]).withColumn("short", F.element_at(F.split("base", r"\."), -1))
    at = F.row_number().over(Window.partitionBy("file").orderBy("base"))
    return rows.select("file", at.alias("import_seq"), "base", "resolved", F.array(F.struct(F.col("short").alias("name"), F.col("short").alias("alias"))).alias("bindings"), "line", F.lit("confirmed").alias("confidence"))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """The names before a parenthesis on the lines of hits, as calls."""
    lines = table(spark, d, "hits").filter("line is not null and path is not null").groupBy(F.col("path").alias("file"), "line").agg(F.max("text").alias("text"))
    names = lines.select("file", "line", F.posexplode(F.regexp_extract_all("text", F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1))).alias("n", "name"))
    return names.select("file", (F.col("line").cast("long") * 1000 + F.col("n") + 1).alias("use_seq"), F.lit("call").alias("use_kind"), "name", "line", F.lit("").alias("scope"), F.lit("").alias("receiver"))


def _bases(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "bases").select("file", "qualname", "base", "line", "relation").dropna(subset=["file", "qualname", "base"]).distinct()
    order = Window.partitionBy("file").orderBy(F.asc_nulls_first("line"), "qualname", "base", F.asc_nulls_first("relation"))
    return rows.withColumn("base_seq", F.row_number().over(order))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    homes = checkpoint(_homes(spark, d))
    status = homes.select(F.col("path").alias("file"), F.lit("confirmed").alias("confidence"), F.lit("").alias("error"))
    texts = P._texts(spark, d, "kind").filter(F.col("kind").isin("config", "manifest"))
    return checkpoint(G.build_edges(homes, table(spark, d, "project_roots"), status, P._symbols(spark, d), _imports(spark, d), _calls(spark, d), _bases(spark, d), texts))


_KINDS = ", ".join(f"'{k}'" for k in G.KINDS)
_FACTS = f"""
fi AS (SELECT f.path, f.file_seq, f.kind, coalesce((SELECT arg_max(root, length(root)) FROM project_roots r WHERE starts_with(f.path, r.root || '/') AND length(r.root) > 1), '.') AS project,
  coalesce((SELECT arg_min(root, length(root)) FROM project_roots r WHERE starts_with(f.path, r.root || '/') AND length(r.root) > 1), '.') AS root FROM (SELECT DISTINCT ON (path) path, file_seq, kind FROM files) f),
im AS (SELECT m.file, m.base, m.resolved, string_split(m.base, '.')[-1] AS short, l.line, row_number() OVER (PARTITION BY m.file ORDER BY m.base) AS pl FROM ({P.ORACLES["join01_module_of_base"]}) m JOIN (SELECT file, base, min(line) AS line FROM bases GROUP BY ALL) l USING (file, base) WHERE m.resolved IS NOT NULL),
hl AS (SELECT path AS file, line, max(text) AS text FROM hits WHERE line IS NOT NULL AND path IS NOT NULL GROUP BY ALL),
hn AS (SELECT file, line, regexp_extract_all(text, '([A-Za-z_]\\w*)\\s*\\(', 1) AS ns FROM hl),
ca AS (SELECT file, line, unnest(ns) AS name, line::BIGINT * 1000 + unnest(range(1, len(ns) + 1)) AS pl FROM hn),
ba AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line NULLS FIRST, qualname, base, relation NULLS FIRST) AS pl FROM (SELECT DISTINCT file, qualname, base, line, relation FROM bases WHERE file IS NOT NULL AND qualname IS NOT NULL AND base IS NOT NULL)),
sy AS (SELECT s.file, s.sym_seq, s.name, s.kind, s.line, s.qualname, coalesce(s.parent, '') AS parent, s.confidence, f.file_seq, f.root, f.kind IN ('source', 'script', 'test') AS is_code, 'sym:' || s.file || '::' || s.qualname AS node FROM (SELECT DISTINCT ON (sym_seq) * FROM symbols) s JOIN fi f ON f.path = s.file WHERE s.qualname IS NOT NULL)"""
_EDGES = f"""{_FACTS},
bi AS (SELECT im.file, im.short, y.node, y.file_seq AS tf, y.sym_seq AS ta, im.pl, max(im.pl) OVER (PARTITION BY im.file, im.short) AS last FROM im JOIN sy y ON y.file = im.resolved AND y.name = im.short AND y.parent = ''),
ak AS (SELECT c.file, f.file_seq, f.root, f.kind = 'test' AS is_test, 3 AS stage, c.pl, 'calls' AS kind, c.name AS short, c.line, '' AS scope FROM ca c JOIN fi f ON f.path = c.file
  UNION ALL SELECT b.file, f.file_seq, f.root, f.kind = 'test', 5, b.pl, coalesce(b.relation, 'extends'), string_split(b.base, '.')[-1], b.line, b.qualname FROM ba b JOIN fi f ON f.path = b.file),
h1 AS (SELECT ak.*, bi.node AS dst, bi.tf, bi.ta, 'confirmed' AS confidence FROM ak JOIN bi ON bi.file = ak.file AND bi.short = ak.short AND bi.pl = bi.last),
r1 AS (SELECT * FROM ak WHERE NOT EXISTS (FROM bi WHERE bi.file = ak.file AND bi.short = ak.short)),
h2 AS (SELECT r1.*, y.node AS dst, y.file_seq AS tf, y.sym_seq AS ta, 'confirmed' AS confidence FROM r1 JOIN sy y ON y.file = r1.file AND y.name = r1.short AND y.parent = ''),
r2 AS (SELECT * FROM r1 WHERE NOT EXISTS (FROM sy y WHERE y.file = r1.file AND y.name = r1.short AND y.parent = '')),
h3 AS (SELECT r2.*, y.node AS dst, y.file_seq AS tf, y.sym_seq AS ta, 'inferred' AS confidence FROM r2 JOIN sy y ON y.root = r2.root AND y.name = r2.short AND y.parent = '' AND y.is_code),
hi AS (SELECT h.*, coalesce(n.node, 'file:' || h.file) AS src FROM (FROM h1 UNION ALL FROM h2 UNION ALL FROM h3) h LEFT JOIN (SELECT DISTINCT file, qualname, node FROM sy) n ON n.file = h.file AND n.qualname = h.scope),
cl AS (SELECT path, unnest({P._LINES}) AS row, unnest(range(1, len({P._LINES}) + 1)) AS line FROM (SELECT DISTINCT ON (path) path, text FROM files WHERE kind IN ('config', 'manifest') AND text IS NOT NULL)),
ct AS (SELECT path, line, regexp_extract_all(row, '[A-Za-z_][\\w.]*') AS ts FROM cl), cu AS (SELECT path, line, unnest(ts) AS token, unnest(range(len(ts))) AS n FROM ct),
cm AS (SELECT path, line, token, min(n) AS n, string_split(token, '.') AS ps FROM cu GROUP BY ALL),
ce AS (SELECT m.*, y.node, y.file_seq AS tf, y.sym_seq AS ta, f.file_seq FROM cm m JOIN fi f USING (path) JOIN sy y ON y.root = f.root AND y.name = m.ps[-1] AND y.parent = '' WHERE m.ps[-1] <> '' AND CASE
  WHEN len(ps) >= 2 THEN len(list_filter(ps[1:len(ps) - 1], lambda p: NOT (list_contains(string_split(y.file, '/'), p) OR contains(regexp_replace(regexp_extract(y.file, '[^/]*$'), '([^.])\\.[^.]+$', '\\1'), p)))) = 0
  ELSE length(y.name) >= 4 AND (contains(y.name, '_') OR regexp_matches(y.name, '[a-z][A-Z]') OR length(y.name) >= 10) END),
al AS (SELECT 0 AS o1, file_seq AS o2, 1 AS o3, sym_seq AS o4, 0 AS o5, 0 AS o6, 0 AS o7, 'file:' || file AS src, node AS dst, 'defines' AS kind, confidence, line, '' AS note FROM sy
  UNION ALL SELECT 0, f.file_seq, 2, im.pl, 0, 0, 0, 'file:' || im.file, 'file:' || im.resolved, 'imports', 'confirmed', im.line, im.short FROM im JOIN fi f ON f.path = im.file
  UNION ALL SELECT 0, f.file_seq, 2, im.pl, 0, 0, 1, 'file:' || im.file, 'file:' || im.resolved, 'tests', 'confirmed', im.line, '' FROM im JOIN fi f ON f.path = im.file WHERE f.kind = 'test'
  UNION ALL SELECT 0, file_seq, stage, pl, tf, ta, 0, src, dst, kind, confidence, line, '' FROM hi
  UNION ALL SELECT 0, file_seq, stage, pl, tf, ta, 1, 'file:' || file, dst, 'tests', confidence, line, '' FROM hi WHERE stage = 3 AND is_test
  UNION ALL SELECT 1, file_seq, 6, line * 2147483648 + n, tf, ta, 0, 'file:' || path, node, 'configures', 'inferred', line, token FROM ce),
ed AS (SELECT *, row_number() OVER (ORDER BY o1, o2, o3, o4, o5, o6, o7) AS edge_seq FROM (SELECT * FROM al WHERE src <> dst QUALIFY row_number() OVER (PARTITION BY src, dst, kind, line ORDER BY o1, o2, o3, o4, o5, o6, o7) = 1)),
st AS (SELECT dst AS node FROM ed WHERE kind IN ({_KINDS}) GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"""


def _hub(edges: DataFrame) -> str:
    """The node that most edges of uses lead to."""
    return edges.filter(F.col("kind").isin(*G.KINDS)).groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").first()["dst"]


_RANK = "CASE {} WHEN 'confirmed' THEN 0 WHEN 'inferred' THEN 1 ELSE 2 END"
_NAMED = "CASE {} WHEN 0 THEN 'confirmed' WHEN 1 THEN 'inferred' ELSE 'unknown' END"


def _levels(name: str, start: str, depth: int, upstream: bool, kinds: str = _KINDS) -> str:
    """CTEs of a walk: {name}0 to {name}{depth}, and {name} with all levels but the start."""
    near, far = ("dst", "src") if upstream else ("src", "dst")
    sql, seen = f"{name}0 AS (SELECT node, 0 AS depth, row_number() OVER (ORDER BY node)::BIGINT AS rank, 0 AS c FROM {start})", f"SELECT node FROM {name}0"
    for i in range(1, depth + 1):
        old = f"{name}{i - 1}"
        sql += f", {name}{i} AS (SELECT node, {i} AS depth, row_number() OVER (ORDER BY m) AS rank, c FROM (SELECT e.{far} AS node, min(struct_pack(p := w.rank, e := e.edge_seq)) AS m, arg_min(greatest(w.c, {_RANK.format('e.confidence')}), struct_pack(p := w.rank, e := e.edge_seq)) AS c FROM ed e JOIN {old} w ON e.{near} = w.node WHERE e.kind IN ({kinds}) AND e.{far} NOT IN ({seen}) GROUP BY e.{far}))"
        seen += f" UNION ALL SELECT node FROM {name}{i}"
    return sql + f", {name} AS ({' UNION ALL '.join(f'FROM {name}{i}' for i in range(1, depth + 1))})"


@query(f"WITH {_EDGES} SELECT src, dst, kind, confidence, line, note FROM ed")
def gra01_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("src", "dst", "kind", "confidence", "line", "note")


@query()
def gra01_edge_counts(spark: SparkSession, d: str) -> DataFrame:
    facts, homes = P._extracted(spark, d), _homes(spark, d)
    texts = P._texts(spark, d, "kind").filter(F.col("kind").isin("config", "manifest"))
    edges = G.build_edges(homes, table(spark, d, "project_roots"), E.status(facts), E.rows_of(facts, "symbols", "sym_seq"), E.resolved_imports(facts, homes), E.rows_of(facts, "uses", "use_seq"), E.rows_of(facts, "bases", "base_seq"), texts)
    return edges.groupBy("kind", "confidence").agg(F.count("*").alias("edges"))


@query(f"WITH {_EDGES}, {_levels('w', 'st', 3, True)} SELECT node, depth, rank, {_NAMED.format('c')} AS confidence FROM w")
def gra04_bfs(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    return G.walk(edges, _hub(edges), 3, True, G.KINDS).select("node", "depth", "rank", "confidence")


@query(f"WITH {_EDGES} SELECT 'incoming' AS direction, kind, src AS other, confidence, line FROM ed WHERE dst IN (FROM st) UNION ALL SELECT 'outgoing', kind, dst, confidence, line FROM ed WHERE src IN (FROM st)")
def gra02_03_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    return G.neighbourhood(edges, _hub(edges))


_WEAK = _NAMED.format(f"max({_RANK.format('confidence')})")
_IMPACT = f"""{_EDGES}, ho AS (SELECT 'file:' || split_part(substr(node, 5), '::', 1) AS node FROM st), {_levels('w', 'st', 2, True)}, {_levels('f', 'ho', 2, True, "'imports'")},
di AS (SELECT src AS node, {_WEAK} AS confidence FROM ed WHERE dst IN (FROM st) AND kind IN ({_KINDS}) GROUP BY src),
se AS (SELECT 'direct-caller' AS section, node, 1 AS depth, confidence FROM di
  UNION ALL SELECT 'indirect-caller', node, depth, {_NAMED.format('c')} FROM w WHERE depth > 1 AND node NOT IN (SELECT node FROM di)
  UNION ALL SELECT 'callee', dst, 1, {_WEAK} FROM ed WHERE src IN (FROM st) AND kind IN ({_KINDS}) GROUP BY dst
  UNION ALL SELECT 'dependency', dst, 1, {_WEAK} FROM ed WHERE src IN (FROM ho) AND kind = 'imports' GROUP BY dst
  UNION ALL SELECT 'dependent-file', node, depth, {_NAMED.format('c')} FROM f
  UNION ALL SELECT 'related-type', node, 1, {_WEAK} FROM (SELECT src AS node, confidence FROM ed WHERE dst IN (FROM st) AND kind IN ('extends', 'implements') UNION ALL SELECT dst, confidence FROM ed WHERE src IN (FROM st) AND kind IN ('extends', 'implements')) GROUP BY node
  UNION ALL SELECT CASE kind WHEN 'tests' THEN 'test' ELSE 'config' END, 'file:' || split_part(regexp_replace(src, '^[^:]*:', ''), '::', 1), 1, {_WEAK} FROM ed WHERE (dst IN (FROM st) OR dst IN (FROM ho)) AND kind IN ('tests', 'configures') GROUP BY 1, 2)"""


@query(f"WITH {_IMPACT} SELECT * FROM se")
def gra06_impact(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    return G.impact(edges, [_hub(edges)], 2).select("section", "node", "depth", "confidence")


@query(f"""WITH {_IMPACT}, sf AS (SELECT section, split_part(regexp_replace(node, '^[^:]*:', ''), '::', 1) AS f, confidence FROM se),
af AS (SELECT DISTINCT f FROM sf WHERE section IN ('direct-caller', 'indirect-caller', 'dependent-file') UNION SELECT substr(node, 6) FROM ho), di2 AS (SELECT count(DISTINCT CASE WHEN contains(f, '/') THEN split_part(f, '/', 1) ELSE '.' END) AS n FROM af)
SELECT 'boundary' AS finding, count(*) AS amount, 'inferred' AS confidence FROM af UNION ALL SELECT 'directories', n, 'inferred' FROM di2 WHERE n > 1
UNION ALL SELECT * FROM (SELECT 'direct-sites', count(*) FILTER (NOT coalesce(fi.kind = 'test', false)) AS n, {_WEAK} FROM sf LEFT JOIN fi ON fi.path = sf.f WHERE section = 'direct-caller') WHERE n > 0
UNION ALL SELECT * FROM (SELECT 'indirect-callers', count(*) AS n, {_WEAK} FROM sf WHERE section = 'indirect-caller') WHERE n > 0
UNION ALL SELECT CASE WHEN count(*) > 0 THEN 'tests' ELSE 'untested' END, count(*), 'inferred' FROM sf WHERE section = 'test'
UNION ALL SELECT * FROM (SELECT 'config', count(*) AS n, 'inferred' FROM sf WHERE section = 'config') WHERE n > 0
UNION ALL SELECT 'overall', count(*), CASE WHEN count(*) > 0 THEN {_WEAK} ELSE 'inferred' END FROM sf WHERE section IN ('direct-caller', 'dependent-file', 'callee', 'test')""")
def gra06_consequences(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    hub = _hub(edges)
    return G.consequences(G.impact(edges, [hub], 2), P._files(spark, d, "kind"), [hub])


_TRACE = f"""{_EDGES}, s2 AS (SELECT src AS node FROM ed WHERE kind IN ({_KINDS}) AND starts_with(src, 'sym:') GROUP BY src ORDER BY count(*) DESC, src LIMIT 1), {_levels('w', 's2', 3, False)}, {_levels('u', 's2', 3, True)},
kd AS (SELECT node, min(kind) AS kind FROM sy GROUP BY node),
ca2 AS (SELECT w.node, w.depth, w.c, row_number() OVER (ORDER BY w.depth, CASE WHEN kd.kind IN ('function', 'method', 'route') THEN 0 WHEN kd.kind IN ('class', 'interface', 'type', 'enum') THEN 1 WHEN kd.kind IN ('constant', 'variable') THEN 2 ELSE 3 END,
  split_part(regexp_replace(w.node, '^[^:]*:', ''), '::', 1) = (SELECT split_part(substr(node, 5), '::', 1) FROM s2), w.node) AS cause_rank FROM w LEFT JOIN kd USING (node)),
tr AS (SELECT 'downstream' AS direction, node, depth, {_NAMED.format('c')} AS confidence, cause_rank FROM ca2 UNION ALL SELECT 'upstream', node, depth, {_NAMED.format('c')}, NULL FROM u)"""


def _traced(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    busy = edges.filter(F.col("kind").isin(*G.KINDS) & F.col("src").startswith("sym:")).groupBy("src").agg(F.count("*").alias("n"))
    return G.trace(edges, P._symbols(spark, d), busy.orderBy(F.desc("n"), "src").first()["src"])


@query(f"WITH {_TRACE} SELECT * FROM tr")
def gra07_trace(spark: SparkSession, d: str) -> DataFrame:
    return _traced(spark, d).select("direction", "node", "depth", "confidence", "cause_rank")


@query(f"WITH {_TRACE} SELECT cause_rank::INT AS step, node FROM tr WHERE cause_rank <= 3 UNION ALL (SELECT 4, node FROM tr WHERE direction = 'upstream' ORDER BY depth, node LIMIT 1)")
def gra07_next_steps(spark: SparkSession, d: str) -> DataFrame:
    return G.next_steps(_traced(spark, d))


# ---------------------------------------------------------------- lookups over the facts


_NAME = "token"


@query(f"""WITH {_FACTS}, de AS (SELECT DISTINCT file, line FROM sy WHERE name = '{_NAME}' OR qualname = '{_NAME}' OR ends_with(qualname, '.{_NAME}')),
us AS (SELECT DISTINCT 'use' AS section, file, line FROM ca WHERE name = '{_NAME}' AND (file, line) NOT IN (SELECT (file, line) FROM de) UNION SELECT DISTINCT 'import', file, line FROM im WHERE short = '{_NAME}'),
tx AS (SELECT DISTINCT path AS file, line FROM (SELECT path, unnest({P._LINES}) AS row, unnest(range(1, len({P._LINES}) + 1)) AS line FROM {P._F}) WHERE regexp_matches(row, '(^|[^\\w$]){_NAME}($|[^\\w$])'))
SELECT * FROM us UNION ALL SELECT 'text', file, line FROM tx WHERE NOT EXISTS (FROM us WHERE us.file = tx.file AND us.line = tx.line) AND NOT EXISTS (FROM de WHERE de.file = tx.file AND de.line = tx.line)""")
def join10_references(spark: SparkSession, d: str) -> DataFrame:
    lines = R.identifier_lines(P._texts(spark, d), _NAME)
    return reports.references(_calls(spark, d), _imports(spark, d), lines, P._symbols(spark, d), _NAME)


@query(f"""WITH {_FACTS} SELECT f.path, m.resolved AS target, list_sort(list(DISTINCT m.short)) AS names, count(*) AS imports FROM fi f JOIN im m ON m.file = f.path GROUP BY ALL
UNION ALL SELECT f.path, NULL, list_sort(list(DISTINCT m.base)), count(*) FROM fi f JOIN ({P.ORACLES["join01_module_of_base"]}) m ON m.file = f.path WHERE m.resolved IS NULL GROUP BY f.path""")
def cmd03_deps(spark: SparkSession, d: str) -> DataFrame:
    outside = P.join01_module_of_base(spark, d).filter("resolved is null").select("file", "resolved", F.col("base").alias("name"))
    inside = _imports(spark, d).select("file", "resolved", F.col("bindings")[0]["name"].alias("name"))
    return reports.dependencies(inside.unionByName(outside).join(P._files(spark, d).withColumnRenamed("path", "file"), "file"))


@query(f"""WITH {_FACTS} SELECT f.path AS file, y.sym_seq, y.kind, concat_ws('', y.line, ': ', y.qualname, CASE WHEN coalesce(s.signature, '') <> '' THEN ' ' || s.signature END) AS summary FROM sy y JOIN fi f ON f.path = y.file JOIN (SELECT DISTINCT ON (sym_seq) * FROM symbols) s USING (sym_seq)""")
def cmd05_symbols_in(spark: SparkSession, d: str) -> DataFrame:
    return reports.symbols_in(P._symbols(spark, d).join(P._files(spark, d).withColumnRenamed("path", "file"), "file", "left_semi"))


_WHOLE = "'(^|[^\\w$])' || (SELECT name FROM tn) || '($|[^\\w$])'"


@query(f"""WITH {_FACTS}, tn AS (SELECT min(name) AS name FROM (SELECT y.name FROM sy y JOIN fi f ON f.path = y.file WHERE regexp_matches(y.name, '^[A-Za-z_]+$') GROUP BY y.name HAVING bool_and(coalesce(f.kind = 'test', false)))),
ow AS (SELECT min(sy.file) AS path FROM sy, tn WHERE sy.name = tn.name OR sy.qualname = tn.name OR ends_with(sy.qualname, '.' || tn.name)),
pj AS (SELECT coalesce(min(fi.project), '.') AS project FROM ow JOIN fi ON fi.path = ow.path), te AS (SELECT path FROM fi WHERE kind = 'test' AND project IN (FROM pj))
SELECT path, count(*) AS mentions FROM (SELECT path, unnest({P._LINES}) AS row FROM {P._F}) WHERE path IN (FROM te) AND regexp_matches(row, {_WHOLE}) GROUP BY path""")
def join11_tests_for(spark: SparkSession, d: str) -> DataFrame:
    """The tests of the first name that only test files define."""
    homes, symbols = _homes(spark, d), P._symbols(spark, d)
    test = homes.select(F.col("path").alias("file"), F.coalesce(F.col("kind") == "test", F.lit(False)).alias("test"))
    own = symbols.filter(F.col("name").rlike("^[A-Za-z_]+$") & F.col("qualname").isNotNull()).join(test, "file").groupBy("name").agg(F.min("test").alias("test"))
    name = own.filter("test").agg(F.min("name").alias("name")).first()["name"]
    return reports.tests_for_symbol(homes, symbols, P._texts(spark, d), name or "")


@query(f"""WITH {_FACTS}, tg AS (SELECT resolved AS target FROM im GROUP BY resolved ORDER BY count(*) DESC, resolved LIMIT 1)
SELECT im.file AS path, count(*) AS mentions FROM im JOIN tg ON tg.target = im.resolved JOIN fi f ON f.path = im.file JOIN fi g ON g.path = tg.target WHERE f.project = g.project GROUP BY im.file""")
def join11_importers(spark: SparkSession, d: str) -> DataFrame:
    imports = _imports(spark, d)
    target = imports.groupBy("resolved").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "resolved").first()["resolved"]
    return reports.importers_in_project(_homes(spark, d), imports, target)


@query(f"WITH {_FACTS}, cv AS (SELECT DISTINCT im.resolved FROM im JOIN fi f ON f.path = im.file WHERE f.kind = 'test') SELECT path FROM fi WHERE kind IN ('source', 'script') AND path NOT IN (FROM cv)")
def join17_uncovered(spark: SparkSession, d: str) -> DataFrame:
    files = P._files(spark, d, "kind")
    return C.uncovered(files.withColumn("status", F.lit("M")), _imports(spark, d), files)


@query(f"""WITH {_FACTS}, tp AS (SELECT DISTINCT y.file, f.project, y.kind, y.name, y.qualname, s.exported FROM sy y JOIN fi f ON f.path = y.file JOIN (SELECT DISTINCT ON (sym_seq) * FROM symbols) s USING (sym_seq) WHERE f.kind IN ('source', 'script') AND y.parent = '')
SELECT a.file, a.project, a.kind, a.name, a.qualname, count(DISTINCT b.file) AS clashes FROM tp a JOIN tp b ON a.project = b.project AND a.kind = b.kind AND a.name = b.name AND a.file <> b.file WHERE a.exported GROUP BY ALL""")
def join13_name_collisions(spark: SparkSession, d: str) -> DataFrame:
    homes = _homes(spark, d).select(F.col("path").alias("file"), "project", F.col("kind").alias("file_kind"))
    symbols = P._symbols(spark, d).select("file", "kind", "name", "qualname", "parent", "exported").join(homes, "file")
    return C.name_collisions(symbols, symbols)


@query(f"""WITH RECURSIVE {_FACTS}, li AS (SELECT DISTINCT im.file AS a, im.resolved AS b FROM im JOIN fi f ON f.path = im.file JOIN fi g ON g.path = im.resolved WHERE f.kind IN ('source', 'test', 'script') AND g.kind IN ('source', 'test', 'script') AND im.file <> im.resolved),
l2 AS (SELECT a, b FROM li UNION SELECT b, a FROM li), re AS (SELECT a AS node, a AS other FROM l2 UNION SELECT re.node, l2.b FROM re JOIN l2 ON l2.a = re.other),
co AS (SELECT f.path, coalesce(m.c, f.path) AS c FROM fi f LEFT JOIN (SELECT node, min(other) AS c FROM re GROUP BY node) m ON m.node = f.path WHERE f.kind IN ('source', 'test', 'script')),
be AS (SELECT c FROM co GROUP BY c ORDER BY count(*) DESC, c LIMIT 1) SELECT path FROM co WHERE c NOT IN (FROM be)""")
def join14_unrelated(spark: SparkSession, d: str) -> DataFrame:
    changes = P._files(spark, d, "kind").select("path", "kind", F.lit("M").alias("status"), F.array().cast("array<string>").alias("new_symbols"))
    return C.unrelated(changes, _imports(spark, d))

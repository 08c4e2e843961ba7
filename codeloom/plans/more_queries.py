"""Queries of notes, changes, bodies and states over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators import changes as C
from codeloom.operators import graph as G
from codeloom.operators import relational as R
from codeloom.operators import similarity as S
from codeloom.operators import state as ST
from codeloom.plans import graph_queries as GQ
from codeloom.plans import reference as P
from codeloom.plans import reports
from codeloom.plans.registry import registrar
from codeloom.runtime import table
from codeloom.sources import bodies as B

QUERIES: dict[str, object] = {}
ORACLES: dict[str, str] = {}
query = registrar(QUERIES, ORACLES)

# ---------------------------------------------------------------- notes

#: Documents as notes: what a note says, is and hangs on is taken from their columns.
_TODAY = "2025-06-01"
_NOTES = """notes AS (SELECT 'M-' || CASE WHEN doc_id > 9999 THEN doc_id::VARCHAR ELSE lpad(doc_id::VARCHAR, 4, '0') END AS id, CASE source WHEN 'commit' THEN 'fact' WHEN 'issue' THEN 'unresolved' WHEN 'adr' THEN 'decision' WHEN 'readme' THEN 'convention' ELSE source END AS category, text AS statement,
 CASE lang WHEN 'en' THEN 'confirmed' WHEN 'fr' THEN 'temporary' WHEN 'de' THEN 'inferred' WHEN 'es' THEN 'superseded' ELSE lang END AS status, strftime(created_at, '%Y-%m-%d') AS created, strftime(received_at, '%Y-%m-%d') AS updated,
 CASE WHEN source IN ('log', 'review', 'commit') THEN strftime(received_at, '%Y-%m-%d') END AS expires, CASE WHEN root IS NOT NULL THEN [root] ELSE []::VARCHAR[] END AS evidence, root || '/' || source AS key,
 CASE WHEN source = 'changelog' THEN 'M-' || (doc_id + 1000000) END AS supersedes, CASE WHEN lang = 'es' AND source = 'issue' THEN 'M-' || doc_id END AS superseded_by, root FROM documents)"""


def _notes(spark: SparkSession, d: str) -> DataFrame:
    case = lambda c, pairs: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), F.col(c)), F.col(c))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    some = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    number = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select(
        F.concat(F.lit("M-"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0"))).alias("id"),
        case("source", {"commit": "fact", "issue": "unresolved", "adr": "decision", "readme": "convention"}).alias("category"),
        F.col("text").alias("statement"),
        case("lang", {"en": "confirmed", "fr": "temporary", "de": "inferred", "es": "superseded"}).alias("status"),
        day("created_at").alias("created"),
        day("received_at").alias("updated"),
        F.when(F.col("source").isin("log", "review", "commit"), day("received_at")).alias("expires"),
        some("root").alias("evidence"),
        F.concat("root", F.lit("/"), "source").alias("key"),
        F.when(F.col("source") == "changelog", F.concat(F.lit("M-"), (F.col("doc_id") + 1_000_000).cast("string"))).alias("supersedes"),
        F.when((F.col("lang") == "es") & (F.col("source") == "issue"), F.concat(F.lit("M-"), number)).alias("superseded_by"),
        some("root").alias("paths"),
        F.array("source").alias("tags"),
        F.array().cast("array<string>").alias("symbols"),
    )


_quoted = lambda words: ", ".join(f"'{w}'" for w in words)
_CURRENT = f"(status IN ('confirmed', 'evidenced', 'inferred', 'temporary', 'unresolved') AND NOT coalesce(expires <> '' AND expires < '{_TODAY}', false))"


def _note_errors() -> str:
    gone = lambda c: f"coalesce({c}, '') = ''"
    rules = [(gone(c), f"missing {c}") for c in ("id", "category", "statement", "status", "created", "updated")]
    rules += [
        ("NOT regexp_matches(id, '^M-[0-9]{4,}$')", "id must look like M-0001"), (f"NOT coalesce(category IN ({_quoted(reports.CATEGORIES)}), false)", "unknown category"), (f"NOT coalesce(status IN ({_quoted(reports.STATUSES)}), false)", "unknown status"),
        ("length(statement) > 300", "statement longer than 300 characters"), ("contains(statement, chr(10))", "statement must be a single line"), ("status IN ('confirmed', 'evidenced') AND len(evidence) = 0", "status needs evidence"),
        (f"status = 'temporary' AND {gone('expires')}", "temporary items need an expires date"), (f"status = 'superseded' AND {gone('superseded_by')}", "superseded items need superseded_by"),
    ]
    return "list_filter([" + ", ".join(f"CASE WHEN {broken} THEN '{message}' END" for broken, message in rules) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {_NOTES}, e AS (SELECT id, {_note_errors()} AS errors FROM notes) SELECT * FROM e WHERE len(errors) > 0")
def val01_note_errors(spark: SparkSession, d: str) -> DataFrame:
    return _notes(spark, d).select("id", R.rule_errors(reports.note_rules()).alias("errors")).filter(F.size("errors") > 0)


@query(f"""WITH {_NOTES}, cu AS (SELECT * FROM notes WHERE {_CURRENT}), tw AS (SELECT key FROM cu WHERE coalesce(key, '') <> '' GROUP BY key HAVING count(DISTINCT id) > 1)
SELECT id, unnest({_note_errors()}) AS problem FROM notes UNION ALL SELECT id, 'dangling supersedes' FROM notes WHERE supersedes <> '' AND supersedes NOT IN (SELECT id FROM notes) UNION ALL SELECT id, 'dangling superseded_by' FROM notes WHERE superseded_by <> '' AND superseded_by NOT IN (SELECT id FROM notes)
UNION ALL SELECT id, 'expired' FROM notes WHERE status = 'temporary' AND expires <> '' AND expires < '{_TODAY}' UNION ALL SELECT id, 'conflict' FROM cu WHERE key IN (FROM tw) UNION ALL SELECT id, 'open' FROM cu WHERE status = 'unresolved' OR category = 'unresolved' UNION ALL SELECT id, 'weak fact' FROM notes WHERE status = 'inferred' AND category IN ('fact', 'convention')""")
def val02_note_problems(spark: SparkSession, d: str) -> DataFrame:
    return reports.note_problems(_notes(spark, d), _TODAY)


_TEXT_WORDS = "string_split_regex(lower(regexp_replace(regexp_replace(statement, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^A-Za-z0-9]+')"


@query(f"""WITH {_NOTES}, s AS (SELECT id, updated, CASE WHEN root = 'apps/ledgerline' THEN 6 WHEN starts_with(root, 'apps/ledgerline/') THEN 4 ELSE 0 END + CASE WHEN len(list_filter({_TEXT_WORDS}, lambda w: starts_with(w, 'retry'))) > 0 THEN 1 ELSE 0 END + CASE WHEN len(list_filter({_TEXT_WORDS}, lambda w: starts_with(w, 'cache'))) > 0 THEN 1 ELSE 0 END AS score FROM notes WHERE {_CURRENT})
SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, updated DESC NULLS LAST, id LIMIT 20""")
def win03_note_scores(spark: SparkSession, d: str) -> DataFrame:
    return reports.note_scores(_notes(spark, d), _TODAY, text="retry cache", path="apps/ledgerline", limit=20).select("id", "score")


@query(f"WITH {_NOTES} SELECT id, status FROM notes WHERE {_CURRENT}")
def fil06_current_notes(spark: SparkSession, d: str) -> DataFrame:
    return _notes(spark, d).filter(R.is_current(F.col("status"), F.col("expires"), _TODAY)).select("id", "status")


@query("""WITH one AS (SELECT text, min(doc_id) AS old FROM documents WHERE text IS NOT NULL GROUP BY text), c AS (SELECT d.doc_id, d.lang, d.root, d.received_at, o.old FROM documents d JOIN one o USING (text)),
b AS (SELECT old, min(doc_id) AS new, arg_min(received_at, doc_id) AS at FROM c WHERE doc_id <> old GROUP BY old)
SELECT c.doc_id AS id, CASE WHEN b.new IS NULL THEN 'confirmed' ELSE 'superseded' END AS status, coalesce(b.at, c.received_at) AS updated, c.root, c.lang, b.new AS superseded_by FROM c LEFT JOIN b ON b.old = c.old WHERE c.doc_id = c.old
UNION ALL SELECT c.doc_id, 'confirmed', c.received_at, coalesce(nullif(c.root, ''), o.root, c.root), coalesce(nullif(c.lang, ''), o.lang, c.lang), NULL FROM c JOIN documents o ON o.doc_id = c.old WHERE c.doc_id <> c.old""")
def str10_succession(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null")
    first = docs.groupBy("text").agg(F.min("doc_id").alias("old"))
    rows = docs.join(first, "text").select(F.col("doc_id").alias("id"), F.lit("confirmed").alias("status"), F.col("received_at").alias("updated"), "root", "lang", F.col("old").alias("supersedes"))
    return ST.superseded_items(rows.filter("id = supersedes").drop("supersedes"), rows.filter("id <> supersedes"), inherited=("root", "lang"))


@query("""WITH s AS (SELECT DISTINCT path, seen_at, sha1 FROM file_state WHERE path IS NOT NULL AND sha1 IS NOT NULL)
SELECT g.path, g.seen_at, g.sha1, min(l.seen_at) AS settled_at FROM s g LEFT JOIN s l ON l.path = g.path AND l.seen_at > g.seen_at AND l.sha1 <> g.sha1 GROUP BY ALL""")
def str08_settled(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "file_state").select("path", "seen_at", "sha1").dropna(subset=["path", "sha1"]).distinct()
    return ST.settled_gates(seen, seen, "path", "seen_at", "sha1")


# ---------------------------------------------------------------- changes

#: Files as a change: what happened to one is told by its language, how much by its lines.
_FC = f"""fc AS (SELECT path, kind, CASE language WHEN 'javascript' THEN 'A' WHEN 'typescript' THEN 'R' WHEN 'json' THEN 'D' ELSE 'M' END AS status, coalesce(lines, 0) AS added, coalesce(lines, 0) // 3 AS removed, coalesce(lines, 0) // 4 AS whitespace_only,
 (SELECT coalesce(list(DISTINCT name), []) FROM {P._SY} s WHERE s.file = f.path AND coalesce(s.parent, '') = '') AS new_symbols FROM {P._F} f)"""


def _file_changes(spark: SparkSession, d: str) -> DataFrame:
    names = P._symbols(spark, d).filter(F.coalesce("parent", F.lit("")) == "").groupBy(F.col("file").alias("path")).agg(F.collect_set("name").alias("names"))
    status = F.when(F.col("language") == "javascript", "A").when(F.col("language") == "typescript", "R").when(F.col("language") == "json", "D").otherwise("M")
    lines = F.coalesce("lines", F.lit(0))
    part = lambda n: F.expr(f"coalesce(lines, 0) div {n}").cast("int")
    rows = P._files(spark, d, "kind", "language", "lines").join(names, "path", "left")
    return rows.select("path", "kind", status.alias("status"), lines.alias("added"), part(3).alias("removed"), part(4).alias("whitespace_only"), F.coalesce("names", F.array().cast("array<string>")).alias("new_symbols"))


_TOTALS = "SELECT count(*) AS files, count(*) FILTER (status = 'A') AS new_files, count(*) FILTER (status = 'D') AS deleted_files, count(*) FILTER (status = 'R') AS renamed_files, sum(added) AS added, sum(removed) AS removed, sum(added) - sum(removed) AS net, count(DISTINCT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END) AS folders, sum(whitespace_only) AS whitespace FROM fc"


@query(f"WITH {_FC} {_TOTALS}")
def agg10_change_totals(spark: SparkSession, d: str) -> DataFrame:
    return C.totals(_file_changes(spark, d))


_APART = GQ.ORACLES["join14_unrelated"]
_CLASH = GQ.ORACLES["join13_name_collisions"]


@query(f"""WITH {_FC}, t AS ({_TOTALS}), li AS (SELECT DISTINCT m.file AS a, m.resolved AS b FROM ({P.ORACLES["join01_module_of_base"]}) m JOIN fc p ON p.path = m.file JOIN fc q ON q.path = m.resolved WHERE p.kind IN ('source', 'test', 'script') AND q.kind IN ('source', 'test', 'script') AND p.status <> 'D' AND q.status <> 'D' AND m.file <> m.resolved)
SELECT 'elevated' AS level, path || ' is a new file holding a single small symbol' AS reason FROM fc WHERE status = 'A' AND kind IN ('source', 'script') AND len(new_symbols) = 1 AND added <= 40
UNION ALL SELECT 'elevated', qualname || ' duplicates an existing ' || kind || ' name' FROM ({_CLASH})
UNION ALL SELECT 'elevated', 'growth: ' || CASE WHEN removed > 0 THEN 'additive-heavy' ELSE 'only-additions' END FROM t WHERE added - removed >= 150 AND (removed > 0 AND added >= 3.0 * removed OR removed = 0 AND new_files = 0)
UNION ALL SELECT 'elevated', 'formatting-only churn' FROM t WHERE added + removed > 0 AND whitespace >= 0.2 * greatest(added, 1) AND whitespace >= 5
UNION ALL SELECT 'elevated', 'code changed in ' || n || ' top-level directories' FROM (SELECT count(DISTINCT split_part(path, '/', 1)) AS n FROM fc WHERE kind IN ('source', 'script') AND contains(path, '/')) WHERE n >= 4
UNION ALL SELECT 'elevated', n || ' file(s) unrelated to the main change' FROM (WITH RECURSIVE l2 AS (SELECT a, b FROM li UNION SELECT b, a FROM li), re AS (SELECT a AS node, a AS other FROM l2 UNION SELECT re.node, l2.b FROM re JOIN l2 ON l2.a = re.other),
 co AS (SELECT fc.path, coalesce(m.c, fc.path) AS c FROM fc LEFT JOIN (SELECT node, min(other) AS c FROM re GROUP BY node) m ON m.node = fc.path WHERE kind IN ('source', 'test', 'script') AND status <> 'D'), be AS (SELECT c FROM co GROUP BY c ORDER BY count(*) DESC, c LIMIT 1) SELECT count(*) AS n FROM co WHERE c NOT IN (FROM be)) WHERE n > 0""")
def dif04_reasons(spark: SparkSession, d: str) -> DataFrame:
    return C.reasons(_file_changes(spark, d), GQ._imports(spark, d), GQ.join13_name_collisions(spark, d))


@query(f"SELECT level, reasons FROM (SELECT CASE WHEN count(*) > 0 THEN 'elevated' ELSE 'low' END AS level, count(*) AS reasons FROM ({ORACLES['dif04_reasons']}))")
def dif03_change_level(spark: SparkSession, d: str) -> DataFrame:
    return C.level(dif04_reasons(spark, d))


@query(f"WITH {_FC}, pr AS ({P.ORACLES['join04_project_of_file']}), p AS (SELECT list_sort(list(DISTINCT pr.project)) AS p FROM fc JOIN pr USING (path) WHERE fc.kind IN ('source', 'script') AND fc.status <> 'D') SELECT CASE WHEN list_contains(p, '.') THEN [] ELSE coalesce(p, []) END AS projects FROM p")
def dif08_project_scope(spark: SparkSession, d: str) -> DataFrame:
    return C.project_scope(_file_changes(spark, d).join(P.join04_project_of_file(spark, d), "path"))


@query(f"WITH f AS {P._F} SELECT path, lines AS added, lines // 3 AS removed, greatest(0, lines - lines // 2) AS whitespace FROM f WHERE lines IS NOT NULL AND NOT contains(path, '{{')")
def src11_dif02_numstat(spark: SparkSession, d: str) -> DataFrame:
    """Every file as a line of a numstat, renamed in its folder, read back."""
    rows = P._files(spark, d, "lines").filter("lines is not null and not contains(path, '{')")
    moved = F.concat(F.regexp_replace("path", "[^/]*$", ""), F.lit("{old.py => "), X.name_of(F.col("path")), F.lit("}"))
    line = F.concat_ws("\t", F.col("lines").cast("string"), F.expr("cast(lines div 3 as string)"), moved)
    read = rows.select(C.numstat(line).alias("n"), F.expr("cast(lines div 2 as int)").alias("w"))
    return read.select("n.path", "n.added", "n.removed", C.whitespace_only(F.col("n.added"), F.col("w")).alias("whitespace"))


@query(f"SELECT file AS path, line, count(*) AS hunks FROM (SELECT file, unnest(range(line, end_line + 1)) AS line FROM {P._SY} WHERE end_line >= line AND file IS NOT NULL) GROUP BY ALL")
def src12_added_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol as the hunk of a diff that adds its lines."""
    rows = P._symbols(spark, d).filter("end_line >= line and file is not null")
    head = F.struct((F.col("sym_seq").cast("long") * 2).alias("seq"), F.concat(F.lit("+++ b/"), "file").alias("row"))
    hunk = F.struct((F.col("sym_seq").cast("long") * 2 + 1).alias("seq"), F.concat(F.lit("@@ -0,0 +"), F.col("line").cast("string"), F.lit(","), (F.col("end_line") - F.col("line") + 1).cast("string"), F.lit(" @@")).alias("row"))
    diff = rows.select(F.col("sym_seq").alias("diff_id"), F.explode(F.array(head, hunk)).alias("x")).select("diff_id", "x.seq", "x.row")
    return C.added_lines(diff).groupBy("path", "line").agg(F.count("*").alias("hunks"))


_CUT = "(SELECT max(received_at) FROM documents) - INTERVAL 400 DAY"


@query(f"""WITH g AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents WHERE received_at <= {_CUT} AND text IS NOT NULL), m AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents WHERE received_at > {_CUT} AND text IS NOT NULL)
SELECT g.doc_id AS old_key, m.doc_id AS new_key FROM g JOIN m USING (text, n)""")
def dif01_renames(spark: SparkSession, d: str) -> DataFrame:
    """Documents received late that hold the content of one received before: the same file under a new name."""
    docs = table(spark, d, "documents").select("doc_id", "received_at", F.sha2("text", 256).alias("digest"))
    cut = docs.agg((F.max("received_at") - F.expr("INTERVAL 400 DAYS")).alias("_cut"))
    rows = docs.join(F.broadcast(cut), F.lit(True))
    old, new = rows.filter(F.col("received_at") <= F.col("_cut")).select("doc_id", "digest"), rows.filter(F.col("received_at") > F.col("_cut")).select("doc_id", "digest")
    return R.renames(R.drift(old, new, "doc_id", "digest"), old, new, "doc_id", "digest")


@query(f"""WITH s AS {P._SY}, f AS {P._F} SELECT path FROM f WHERE contains(lower(path), 'apps/ledgerline') OR contains(lower(path), 'schema') OR EXISTS (FROM s WHERE s.file = f.path AND (contains(lower(s.name), 'apps/ledgerline') OR contains(lower(s.name), 'schema')))""")
def fil05_in_scope(spark: SparkSession, d: str) -> DataFrame:
    names = P._symbols(spark, d).groupBy(F.col("file").alias("path")).agg(F.collect_set("name").alias("names"))
    rows = P._files(spark, d).join(names, "path", "left")
    return rows.filter(R.in_scope(F.col("path"), F.col("names"), ["apps\\Ledgerline", "schema"])).select("path")


# ---------------------------------------------------------------- bodies and reports


_BODIES = f"""sb AS (SELECT s.sym_seq, s.file, s.qualname, array_to_string(({P._LINES.replace("text", "f.text")})[s.line + 1:greatest(s.end_line, s.line)], chr(10)) AS body, s.kind FROM {P._SY} s JOIN {P._F} f ON f.path = s.file WHERE s.line IS NOT NULL AND s.end_line IS NOT NULL AND f.text IS NOT NULL)"""


def _distinct_texts(spark: SparkSession, d: str) -> DataFrame:
    return P._texts(spark, d)


@query(f"WITH {_BODIES} SELECT sym_seq, file, qualname, length(body) AS characters, md5(body) AS digest FROM sb")
def src07_function_bodies(spark: SparkSession, d: str) -> DataFrame:
    rows = B.function_bodies(P._symbols(spark, d), _distinct_texts(spark, d)).dropDuplicates(["sym_seq"])
    return rows.select("sym_seq", "file", "qualname", F.length("body").alias("characters"), F.md5("body").alias("digest"))


@query(f"WITH {_BODIES}, {P._token_sets('(SELECT * FROM sb WHERE kind IN (' + _quoted(['function', 'method']) + '))', 'body', 'sym_seq')} SELECT * FROM c WHERE tokens >= 25")
def dif12_collected_bodies(spark: SparkSession, d: str) -> DataFrame:
    rows = B.collected_bodies(P._symbols(spark, d), _distinct_texts(spark, d)).dropDuplicates(["sym_seq"])
    return rows.select("sym_seq", "tokens", F.size("exact").alias("exact"), F.size("normalized").alias("normalised"))


@query(f"SELECT kind, count(*) AS findings FROM ({P._SIM}) GROUP BY kind")
def agg07_finding_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.finding_counts(S.similar_pairs(table(spark, d, "bodies")))


@query(f"SELECT a, b, kind FROM ({P._SIM}) ORDER BY exact DESC, structural DESC, a, b LIMIT 40")
def win09_pair_order(spark: SparkSession, d: str) -> DataFrame:
    return S.best_pairs(S.similar_pairs(table(spark, d, "bodies")), 40).select("a", "b", "kind")


@query(f"SELECT file, CASE max(CASE WHEN exported THEN CASE confidence WHEN 'confirmed' THEN 0 WHEN 'inferred' THEN 1 WHEN 'unknown' THEN 2 END END) WHEN 1 THEN 'inferred' WHEN 2 THEN 'unknown' ELSE 'confirmed' END AS verdict FROM {P._SY} GROUP BY file")
def agg13_worst_required(spark: SparkSession, d: str) -> DataFrame:
    return reports.run_verdict(P._symbols(spark, d), "file", "exported", "confidence", X.CONFIDENCES)


@query(f"SELECT DISTINCT s.file AS path FROM {P._SY} s WHERE s.kind <> 'variable' AND s.file IN (SELECT path FROM files) AND regexp_matches(s.file, '^([\\w.-]+/)+[\\w.-]+\\.[A-Za-z0-9]{{1,8}}$')")
def fil08_surfaced_files(spark: SparkSession, d: str) -> DataFrame:
    """Symbols as findings that name their place; those of variables as what shows no file."""
    kind = F.when(F.col("kind") == "variable", "next").otherwise("definition")
    found = P._symbols(spark, d).select(kind.alias("kind"), F.concat(F.lit("see ("), "file", F.lit(":"), F.col("line").cast("string"), F.lit(")")).alias("text"))
    return reports.surfaced_files(found, P._files(spark, d), "text", "kind")


_CAPS = "CASE section " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in reports.BRIEF_CAPS.items()) + " END"


@query(f"""SELECT section, rank, node AS item, confidence FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY depth, node) AS rank FROM ({GQ.ORACLES["gra06_impact"]})) WHERE rank <= {_CAPS}
UNION ALL SELECT 'consequence', 1, finding || ' ' || amount, confidence FROM ({GQ.ORACLES["gra06_consequences"]})
UNION ALL SELECT 'decision', 1, decision, 'inferred' FROM ({P.ORACLES["win02_reuse_decision"]})""")
def cmd06_brief(spark: SparkSession, d: str) -> DataFrame:
    edges = GQ._edges(spark, d)
    hub = GQ._hub(edges)
    sections = G.impact(edges, [hub], 2)
    return reports.brief(sections, G.consequences(sections, P._files(spark, d, "kind"), [hub]), P.win02_reuse_decision(spark, d))

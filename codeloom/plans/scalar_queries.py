"""Queries of single functions over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators import relational as R
from codeloom.operators import state as ST
from codeloom.plans import more_queries as M
from codeloom.plans import reference as P
from codeloom.plans import reports
from codeloom.plans.registry import registrar
from codeloom.runtime import table
from codeloom.sources import repository as S

QUERIES: dict[str, object] = {}
ORACLES: dict[str, str] = {}
query = registrar(QUERIES, ORACLES)


@query("SELECT doc_id, unnest(['lang', 'source', 'root']) AS key, unnest([coalesce(lang, ''), coalesce(source, ''), coalesce(root, '')]) AS value FROM documents")
def ext17_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its columns as a front matter, read back."""
    field = lambda c: F.concat(F.lit(f"{c}: "), F.coalesce(c, F.lit("")), F.lit("\n"))
    text = F.concat(F.lit("---\n"), field("lang"), field("source"), field("root"), F.lit("  nested: no\n---\n"), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.explode(X.frontmatter(text)).alias("key", "value"))


@query("""WITH b AS (SELECT DISTINCT ON (sym_seq) sym_seq, list_distinct(exact) AS e, list_distinct(normalized) AS n FROM bodies), s AS (SELECT sym_seq, len(e) AS e, len(n) AS n, len(list_intersect(e, n)) AS i FROM b)
SELECT sym_seq, round(i / (e + n - i), 6) AS jaccard, round(i / least(e, n), 6) AS contained FROM s WHERE e > 0 AND n > 0""")
def fun09_10_set_similarity(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "bodies").dropDuplicates(["sym_seq"]).filter("size(exact) > 0 and size(normalized) > 0")
    e, n = F.array_distinct("exact"), F.array_distinct("normalized")
    return rows.select("sym_seq", F.round(X.jaccard(e, n), 6).alias("jaccard"), F.round(X.containment(e, n), 6).alias("contained"))


@query(f"SELECT path, '/base/' || path AS joined, NULL::VARCHAR AS outside, 'file:' || path AS node, path AS label FROM {P._F} WHERE path IS NOT NULL")
def fun12_15_paths_and_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Paths with the other system's slashes, joined below a root; a path that leaves it has none."""
    rows = P._files(spark, d).dropna()
    odd = F.concat(F.lit(".\\"), F.replace("path", F.lit("/"), F.lit("\\")))
    node = X.file_node(X.normal_path(odd))
    return rows.select("path", X.safe_join(F.lit("/base/"), odd).alias("joined"), X.safe_join(F.lit("/base"), F.concat(F.lit("../"), "path")).alias("outside"), node.alias("node"), X.node_file(X.symbol_node(X.node_label(node), F.lit("a.b"))).alias("label"))


@query("SELECT event_id, regexp_full_match(event_type, 'view|cli.k') AS matched, true AS every, false AS broken FROM events")
def fun18_matchers(spark: SparkSession, d: str) -> DataFrame:
    tool = F.col("event_type")
    return table(spark, d, "events").select("event_id", X.matcher_matches("view|cli.k", tool).alias("matched"), X.matcher_matches("*", tool).alias("every"), X.matcher_matches("(", tool).alias("broken"))


_COUNT = "CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END"


@query(f"SELECT doc_id, CASE WHEN root IS NULL THEN 'new-file' ELSE 'rewrite' END AS shape, {_COUNT} AS lines FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(0))")
def fun20_edit_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a call that writes it whole."""
    docs = table(spark, d, "documents").filter(F.col("text").isNotNull() & ~F.col("text").contains("\0"))
    args = F.to_json(F.struct(F.col("text").alias("CodeContent")))
    return docs.select("doc_id", X.edit_shape(F.lit("write_to_file"), args, F.col("root").isNotNull()).alias("e")).select("doc_id", "e.shape", "e.lines")


@query(f"SELECT path, CASE WHEN starts_with(lower(path), 'python') THEN 'python' ELSE regexp_extract(path, '[^/]*$') END || ' -m tool' || CASE WHEN starts_with(lower(regexp_extract(path, '[^/]*$')), 'python') THEN ' -q' ELSE '' END AS label, sha1(path) AS digest, 'missing' AS gone FROM {P._F}")
def fun21_23_labels_and_digests(spark: SparkSession, d: str) -> DataFrame:
    argv = F.array("path", F.lit("-m"), F.lit("tool"), F.lit("-q"))
    return P._files(spark, d).select("path", X.step_label(argv).alias("label"), X.digest_or_missing(F.col("path")).alias("digest"), X.digest_or_missing(F.lit(None).cast("string")).alias("gone"))


@query("SELECT sha1(string_agg(path || chr(9) || mtime_ns, chr(10) ORDER BY path || chr(9) || mtime_ns)) AS signature FROM (SELECT path, max(mtime_ns) AS mtime_ns FROM file_state WHERE path IS NOT NULL AND mtime_ns IS NOT NULL GROUP BY path)")
def fun24_tree_signature(spark: SparkSession, d: str) -> DataFrame:
    newest = table(spark, d, "file_state").dropna(subset=["path", "mtime_ns"]).groupBy("path").agg(F.max("mtime_ns").alias("mtime_ns"))
    return S.tree_signature(newest)


@query(f"SELECT sym_seq, file || ':' || line || ' ' || kind || ' ' || qualname || CASE WHEN coalesce(signature, '') <> '' THEN ' ' || signature ELSE '' END AS symbol, file || '::' || qualname || ' defines ' || file || ' (' || confidence || CASE WHEN line IS NOT NULL THEN ', line ' || line ELSE '' END || ')' AS edge FROM {P._SY}")
def fun28_summaries(spark: SparkSession, d: str) -> DataFrame:
    edge = X.edge_line(X.symbol_node(F.col("file"), F.col("qualname")), F.lit("defines"), X.file_node(F.col("file")), F.col("confidence"), F.col("line"))
    return P._symbols(spark, d).select("sym_seq", X.symbol_line(F.col("file"), F.col("line"), F.col("kind"), F.col("qualname"), F.col("signature")).alias("symbol"), edge.alias("edge"))


_SECRETS = "('.env'), ('.ENV.local'), ('a/id_rsa'), ('b/credentials.json'), ('x.pem'), ('token.json'), ('my.env'), ('rsa.pub'), ('a.tokens')"


@query(f"SELECT path FROM (SELECT path FROM {P._F} UNION ALL SELECT * FROM (VALUES {_SECRETS})) t(path) WHERE regexp_matches(lower(regexp_extract(path, '[^/]*$')), '^\\.env($|\\.)|\\.(pem|key|p12|pfx|token)$|^id_(rsa|ed25519)|^((oauth_)?cr[a-z_]*|oauth_creds|tokens?)\\.json$') AND regexp_extract(path, '[^/]*$') NOT IN ('creds.json')")
def fun29_secret_names(spark: SparkSession, d: str) -> DataFrame:
    import re

    more = spark.createDataFrame([(p,) for p in re.findall(r"'([^']*)'", _SECRETS)], "path string")
    rows = P._files(spark, d).unionByName(more)
    return rows.filter(X.secret_name(F.col("path")))


@query("""WITH o AS (SELECT doc_id, [source, 'a'] AS done, lang FROM documents WHERE root IS NOT NULL), n AS (SELECT doc_id, ['a', 'b', source] AS done, CASE WHEN source = 'issue' THEN source END AS lang FROM documents WHERE lang IS NOT NULL)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, list_sort(list_distinct(coalesce(o.done, []) || coalesce(n.done, []))) AS done, coalesce(n.lang, o.lang) AS lang FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def src15_set05_handoff(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    old = docs.filter("root is not null").select("doc_id", F.array("source", F.lit("a")).alias("done"), "lang")
    new = docs.filter("lang is not null").select("doc_id", F.array(F.lit("a"), F.lit("b"), F.col("source")).alias("done"), F.when(F.col("source") == "issue", F.col("source")).alias("lang"))
    return S.merged_handoff(old, new, "doc_id", ["done"], ["lang"]).select("doc_id", F.array_sort(F.array_compact("done")).alias("done"), "lang")


@query(f"SELECT row_number() OVER (ORDER BY qualname, file, sym_seq) AS seq, '- [warn, ' || confidence || '] ' || kind || ': ' || qualname || ' in ' || file || ' #' || sym_seq || chr(10) || '  - ' || file AS value FROM {P._SY} WHERE confidence IN ('confirmed', 'inferred', 'unknown') AND file IS NOT NULL AND qualname IS NOT NULL AND kind IS NOT NULL")
def src17_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol as a finding, in markdown."""
    rows = P._symbols(spark, d).filter(F.col("confidence").isin(*X.CONFIDENCES)).dropna(subset=["file", "qualname", "kind"])
    summary = F.concat("qualname", F.lit(" in "), "file", F.lit(" #"), F.col("sym_seq").cast("string"))
    made = reports.findings(rows, 1, F.col("kind"), summary, "warn", F.col("confidence"), F.array("file"), F.struct("qualname", "file", "sym_seq"))
    return reports.as_markdown(made).select("seq", "value")


@query("""WITH s AS (SELECT DISTINCT file, lower(language) AS language, coalesce(error, '') AS error FROM extraction_status WHERE language IS NOT NULL)
SELECT language || ': ' || count(*) || ' file(s) without an extractor' AS what FROM s WHERE language NOT IN ('python') GROUP BY language UNION ALL SELECT * FROM (SELECT file || ': parse error' AS what FROM (SELECT DISTINCT file FROM s WHERE error <> '') ORDER BY file LIMIT 10)""")
def agg03_unavailable(spark: SparkSession, d: str) -> DataFrame:
    status = table(spark, d, "extraction_status").filter("language is not null").select("file", F.lower("language").alias("language"), F.coalesce("error", F.lit("")).alias("error")).distinct()
    return reports.unavailable(status, ["python"])


@query("""WITH c AS (SELECT event_id, event_type <> 'view' AS w, user_id % 5 > 0 AS inside, event_type <> 'signup' AS code, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS open, CASE WHEN value > 50 THEN 'new-file' ELSE 'edit' END AS shape, user_id % 6 AS lines, CASE user_id % 3 WHEN 0 THEN 'target' WHEN 1 THEN 'task' END AS ev, CASE WHEN user_id % 2 = 0 THEN 'reuse' END AS cmd, user_id % 4 AS pending FROM events),
e AS (SELECT *, CASE WHEN shape = 'edit' AND lines BETWEEN 1 AND 3 THEN 'allow' WHEN shape = 'new-file' THEN CASE WHEN cmd = 'reuse' THEN 'allow' ELSE 'deny' END WHEN ev = 'target' THEN 'allow' WHEN ev = 'task' THEN 'ask' ELSE 'deny' END AS v FROM c)
SELECT event_id, CASE WHEN NOT w OR NOT inside OR NOT code THEN 'allow' WHEN open > 0 OR v = 'deny' THEN 'deny' WHEN pending > 0 THEN 'ask' ELSE v END AS decision FROM e""")
def str02_edit_decisions(spark: SparkSession, d: str) -> DataFrame:
    user, kind = F.col("user_id"), F.col("event_type")
    calls = table(spark, d, "events").select(
        "event_id", (kind != "view").alias("is_write"), (user % 5 > 0).alias("inside"), (kind != "signup").alias("is_code"), F.when(kind == "error", 1).otherwise(0).alias("open_questions"), F.when(F.col("value") > 50, "new-file").otherwise("edit").alias("shape"), (user % 6).alias("lines"),
        F.when(user % 3 == 0, "target").when(user % 3 == 1, "task").alias("evidence"), F.when(user % 2 == 0, "reuse").alias("evidence_command"), (user % 4).alias("pending"),
    )
    return ST.edit_decision(calls).select("event_id", "decision")


_PARTS = f"""WITH p AS (SELECT 'brief' AS part, rank AS o, item FROM ({M.ORACLES["cmd06_brief"]}) WHERE section <> 'workspace-state'
UNION ALL SELECT 'memory', row_number() OVER (ORDER BY score DESC, id), id FROM ({M.ORACLES["win03_note_scores"]}) UNION ALL SELECT 'rules', 1, path FROM (SELECT DISTINCT path FROM files WHERE kind = 'docs'))"""
_CAP = "CASE part " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in reports.CONTEXT_CAPS.items()) + " END"


@query(f"{_PARTS} SELECT part, rank, item FROM (SELECT part, item, row_number() OVER (PARTITION BY part ORDER BY o, item) AS rank FROM p) WHERE rank <= {_CAP}")
def cmd07_context(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    notes = M.win03_note_scores(spark, d).select(F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"), F.col("id").alias("item"))  # at most twenty rows
    rules = P._files(spark, d, "kind").filter("kind = 'docs'").select(F.lit(1).alias("rank"), F.col("path").alias("item"))
    brief = M.cmd06_brief(spark, d).filter("section <> 'workspace-state'").select("rank", "item")
    return reports.context({"brief": brief, "memory": notes, "rules": rules})


@query(f"WITH s AS {P._SY} SELECT sym_seq, len(list_filter(['core', 'schema', 'token'], lambda w: contains(lower(coalesce(name, '')), w))) > 0 AS named FROM s WHERE kind IN ('function', 'method')")
def fil03_named_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = P._symbols(spark, d).filter(F.col("kind").isin("function", "method"))
    found = F.lit(False)
    for word in ("core", "schema", "token"):
        found = found | F.lower(F.coalesce("name", F.lit(""))).contains(word)
    return rows.select("sym_seq", found.alias("named"))


@query(f"WITH {M._NOTES}, g AS (SELECT key, count(DISTINCT id) AS items FROM notes WHERE {M._CURRENT} AND key <> '' GROUP BY key) SELECT key, items FROM g WHERE items > 1")
def agg09_note_conflicts(spark: SparkSession, d: str) -> DataFrame:
    notes = M._notes(spark, d)
    return R.conflicts(notes.filter(R.is_current(F.col("status"), F.col("expires"), M._TODAY) & (F.col("key") != "")), ["key"], "id")


@query("""SELECT doc_id, len(p) AS named FROM (SELECT doc_id, list_distinct(regexp_extract_all(coalesce(text, ''), '(?:^|[^\\w./-])((?:[\\w.-]+/)+[\\w.-]+\\.[A-Za-z0-9]{1,8})', 1)) AS p FROM documents)
WHERE len(p) = 0 OR len(list_filter(p, lambda x: starts_with(x, 'src/'))) > 0""")
def src18_scoped(spark: SparkSession, d: str) -> DataFrame:
    """Documents that name no file, or one of a folder."""
    rows = reports.scoped(table(spark, d, "documents"), "text", "src")
    return rows.select("doc_id", F.size(X.mentioned_paths(F.coalesce("text", F.lit("")))).alias("named"))


@query("""WITH s AS (SELECT DISTINCT run_id, path, sha1, mtime_ns FROM file_state WHERE path IS NOT NULL AND sha1 IS NOT NULL), n AS (SELECT path, arg_max(sha1, struct_pack(m := mtime_ns, s := sha1)) AS sha1 FROM s WHERE mtime_ns IS NOT NULL GROUP BY path)
SELECT s.run_id, s.path, s.sha1, s.mtime_ns, coalesce(s.sha1 = n.sha1, false) AS fresh FROM s LEFT JOIN n USING (path)""")
def str09_fresh_records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "file_state").select("run_id", "path", "sha1", "mtime_ns").dropna(subset=["path", "sha1"]).distinct()
    newest = rows.filter("mtime_ns is not null").groupBy("path").agg(F.max_by("sha1", F.struct("mtime_ns", "sha1")).alias("sha1"))
    return ST.fresh_records(rows, newest, "path", "sha1")

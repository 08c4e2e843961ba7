"""Queries of the code-intelligence operators over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators import changes as C
from codeloom.operators import components as G8
from codeloom.operators import incremental as I
from codeloom.operators import relational as R
from codeloom.operators import similarity as S
from codeloom.operators import state as ST
from codeloom.runtime import checkpoint, table
from codeloom.plans.registry import registrar
from codeloom.sources import extract as E

QUERIES: dict[str, object] = {}
ORACLES: dict[str, str] = {}


query = registrar(QUERIES, ORACLES)


def _files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row a path of columns without the text: repeated rows count once."""
    return table(spark, d, "files").select("path", *columns).dropDuplicates(["path"])


def _texts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Every row with its text, repeats too: they are removed from what comes of it, so that no text is shuffled."""
    return table(spark, d, "files").select("path", *columns, "text")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Files of a language with an extractor, by their path; the language that the table states is often wrong."""
    return _texts(spark, d, "file_seq").withColumn("language", X.language_of(F.col("path"))).filter(F.col("language").isin(*E.EXTRACTORS))


_F = "(SELECT DISTINCT ON (path) * FROM files)"
_SY = "(SELECT DISTINCT ON (sym_seq) * FROM symbols)"


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbols").dropDuplicates(["sym_seq"])


# ---------------------------------------------------------------- scalar functions and filters


def _case_classify() -> str:
    low, quoted = "lower(regexp_extract(path, '[^/]*$'))", lambda xs: ", ".join(f"'{x}'" for x in xs)
    parts = "list_transform(string_split(path, '/')[:-2], lambda x: lower(x))"
    head = "array_to_string(string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10))[:5], chr(10))"
    marks = " OR ".join(f"contains({head}, '{m}')" for m in X.GENERATED_MARKERS)
    ends = " OR ".join(f"ends_with({low}, '{s}')" for s in X.GENERATED_SUFFIXES)
    lang = "CASE " + " ".join(f"WHEN {low} = '{n}' THEN '{v}'" for n, v in X.LANGUAGE_NAMES.items()) + " " + " ".join(f"WHEN lower(regexp_extract(regexp_extract(path, '[^/]*$'), '[^.](\\.[^.]+)$', 1)) IN ({quoted(s.split())}) THEN '{v}'" for v, s in X.LANGUAGE_SUFFIXES.items()) + " ELSE '' END"
    dirs = lambda xs: f"list_has_any({parts}, [{quoted(xs)}])"
    src = f"lang IN ({quoted(X.SOURCE_LANGUAGES)})"
    rules = [
        (f"{low} IN ({quoted(X.MANIFEST_NAMES)}) OR regexp_matches({low}, '(\\.csproj|\\.sln|\\.gemspec)$|^requirements.*\\.txt$')", "manifest", "manifest filename"),
        (dirs(X.GENERATED_DIRS), "generated", "generated directory"), (ends, "generated", "generated suffix"), (f"is_text AND ({marks})", "generated", "generated marker in header"),
        (f"{src} AND {dirs(X.TEST_DIRS)}", "test", "test directory"), (f"{src} AND regexp_matches(regexp_extract(path, '[^/]*$'), '{X.TEST_NAMES}')", "test", "test filename"),
        (f"lang IN ({quoted(X.SCRIPT_LANGUAGES)})", "script", "script language"), (f"{src} AND {dirs(X.SCRIPT_DIRS)}", "script", "script directory"), (src, "source", ""),
        (f"lang IN ({quoted(X.CONFIG_LANGUAGES)})", "config", ""), (f"lang IN ({quoted(X.DOC_LANGUAGES)})", "docs", ""), ("lang = 'csv'", "data", ""),
    ]
    pick = lambda i: "CASE " + " ".join(f"WHEN {r[0]} THEN '{r[i]}'" for r in rules) + (" ELSE 'other' END" if i == 1 else " ELSE '' END")
    return f"SELECT path, lang AS language, {pick(1)} AS kind, {pick(2)} AS reason FROM (SELECT *, {lang} AS lang FROM {_F})"


@query(_case_classify())
def fun01_02_classify(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d, "is_text").withColumn("_l", X.language_of(F.col("path")))
    kind = X.classify(F.col("path"), F.col("_l"), X.header_of(F.coalesce("text", F.lit(""))), F.col("is_text"))
    return rows.select("path", F.col("_l").alias("language"), kind.alias("k")).select("path", "language", "k.kind", "k.reason").dropDuplicates(["path"])


_STOPS = ", ".join(f"'{w}'" for w in X.STOP_TERMS)
_TERMS = f"""
w AS (SELECT sym_seq, unnest(string_split_regex(lower(regexp_replace(regexp_replace(qualname, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^A-Za-z0-9]+')) AS w FROM {_SY}),
t AS (SELECT sym_seq, w FROM w WHERE length(w) > 1 AND w NOT IN ({_STOPS})),
st AS (SELECT sym_seq, w FROM t UNION SELECT sym_seq, left(w, 5) FROM t WHERE length(w) > 5
  UNION SELECT sym_seq, left(w, length(w) - 3) FROM t WHERE ends_with(w, 'ing') AND length(w) >= 6
  UNION SELECT sym_seq, left(w, length(w) - 2) FROM t WHERE (ends_with(w, 'ed') OR ends_with(w, 'er') OR ends_with(w, 'es')) AND length(w) >= 5
  UNION SELECT sym_seq, left(w, length(w) - 1) FROM t WHERE ends_with(w, 's') AND length(w) >= 4),
k AS (SELECT DISTINCT sym_seq, left(w, 5) AS term FROM st)"""


@query(f"WITH {_TERMS} SELECT term, count(*) AS df FROM k GROUP BY term")
def fun03_04_term_df(spark: SparkSession, d: str) -> DataFrame:
    return R.key_frequencies(_symbols(spark, d), "sym_seq", X.terms(F.col("qualname")))


@query("SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '(?:^|[^\\w./-])((?:[\\w.-]+/)+[\\w.-]+\\.[A-Za-z0-9]{1,8})', 1))) AS path FROM documents")
def fun11_mentioned_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(X.mentioned_paths(F.col("text"))).alias("path"))


@query(f"SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS folder, count(*) AS files, sum(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END) AS lines FROM {_F} GROUP BY 1")
def fun14_19_folder_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d).select("path", X.line_count(F.col("text")).alias("n")).dropDuplicates(["path"])
    return rows.groupBy(X.top_dir(F.col("path")).alias("folder")).agg(F.count("*").alias("files"), F.sum("n").alias("lines"))


@query("SELECT file, CASE max(CASE confidence WHEN 'confirmed' THEN 0 WHEN 'inferred' THEN 1 WHEN 'unknown' THEN 2 END) WHEN 0 THEN 'confirmed' WHEN 1 THEN 'inferred' WHEN 2 THEN 'unknown' ELSE 'confirmed' END AS weakest FROM symbols GROUP BY file")
def fun16_weakest_confidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbols").groupBy("file").agg(X.worst(F.col("confidence"), X.CONFIDENCES).alias("weakest"))


_SOURCE = "regexp_matches(lower(path), '[^./]\\.(py|pyi|js|mjs|cjs|jsx|ts|tsx|mts|cts)$')"
_TOKEN = X.TOKEN.replace("*+", "*").replace("'", "''")
_WORDS = ", ".join(f"'{w}'" for w in X.CODE_WORDS)
_LINES = "string_split(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n$', ''), chr(10))"


def _token_sets(rows: str, text: str, *keep: str) -> str:
    """CTEs t, n and c: the tokens of a text column, the same normalised, and how many there are and how many runs of four."""
    kept = ", ".join(keep)
    runs = lambda c: f"CASE WHEN len({c}) >= 4 THEN len(list_distinct(list_transform(range(1, len({c}) - 2), lambda i: {c}[i:i + 3]))) ELSE 0 END"
    lines = _LINES.replace("text", f"coalesce({text}, '')")
    return f"""t AS (SELECT {kept}, flatten(list_transform(list_filter({lines}, lambda x: NOT regexp_matches(x, '^\\s*(#|//|\\*|/\\*|$)')), lambda x: regexp_extract_all(x, '{_TOKEN}'))) AS t FROM {rows}),
n AS (SELECT *, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z_$]') AND x NOT IN ({_WORDS}) THEN '_' ELSE x END) AS u FROM t),
c AS (SELECT {kept}, len(t) AS tokens, {runs("t")} AS exact, {runs("u")} AS normalised FROM n)"""


@query(f"WITH {_token_sets(f'(SELECT * FROM {_F} WHERE {_SOURCE})', 'text', 'path')} SELECT * FROM c")
def fun06_08_shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    tokens = X.code_tokens(F.coalesce("text", F.lit("")))
    rows = _sources(spark, d).select("path", tokens.alias("t"))
    return rows.select("path", F.size("t").alias("tokens"), F.size(X.shingles(F.col("t"))).alias("exact"), F.size(X.shingles(X.normalised(F.col("t")))).alias("normalised")).dropDuplicates(["path"])


@query()
def fun25_26_markers(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("path", F.explode(X.marker_lines(F.col("path"), F.coalesce("text", F.lit("")))).alias("m")).select("path", "m.line", "m.text").dropDuplicates(["path", "line"])


@query()
def fun27_model_claims(spark: SparkSession, d: str) -> DataFrame:
    claims = X.model_claims(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", claims.alias("c")).select("doc_id", "c.present", F.size("c.steps").alias("steps"), "c.verdict", "c.prose_pass")


_SQL_SECRET = "-----BEGIN [A-Z ]*PRIVATE KEY-----|\\bAIza[0-9A-Za-z_-]{30,}|\\bsk-[A-Za-z0-9]{20,}|\\bghp_[A-Za-z0-9]{30,}"


@query(f"SELECT path FROM {_F} WHERE regexp_matches(text, '{_SQL_SECRET}')")
def fun29_secret_files(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).filter(X.holds_secret(F.col("text"))).select("path").distinct()


@query(f"SELECT language, count(*) AS lines, count(DISTINCT path) AS files FROM (SELECT path, language, unnest(string_split_regex(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n$', ''), '\\n')) AS row FROM {_F}) WHERE regexp_matches(row, '(^|[^\\w$])token($|[^\\w$])') GROUP BY language")
def fil01_identifier_lines(spark: SparkSession, d: str) -> DataFrame:
    return R.identifier_lines(_texts(spark, d, "language"), "token", keep=("language",)).dropDuplicates(["path", "line"]).groupBy("language").agg(F.count("*").alias("lines"), F.count_distinct("path").alias("files"))


@query(f"WITH s AS {_SY}, n AS (SELECT * FROM s WHERE name = 'token' OR qualname = 'token' OR ends_with(qualname, '.token')) SELECT sym_seq, file, line, 1 AS tier FROM n UNION ALL SELECT sym_seq, file, line, 2 FROM s WHERE lower(name) = 'token' AND NOT EXISTS (FROM n)")
def fil02_definition(spark: SparkSession, d: str) -> DataFrame:
    return R.definition(_symbols(spark, d), "token").select("sym_seq", "file", "line", "tier")


@query(f"SELECT 2 AS tier, file, qualname FROM {_SY} WHERE lower(name) = 'token' AND NOT EXISTS (SELECT 1 FROM symbols WHERE name = 'Token' OR qualname = 'Token' OR ends_with(qualname, '.Token')) UNION ALL SELECT 1, file, qualname FROM {_SY} WHERE name = 'Token' OR qualname = 'Token' OR ends_with(qualname, '.Token')")
def fil07_resolve_target(spark: SparkSession, d: str) -> DataFrame:
    return R.resolve_target(_files(spark, d), _symbols(spark, d), "Token")


@query(f"SELECT DISTINCT name FROM {_SY} WHERE length(name) >= 4 AND (contains(name, '_') OR regexp_matches(name, '[a-z][A-Z]') OR length(name) >= 10)")
def fil10_distinctive_names(spark: SparkSession, d: str) -> DataFrame:
    return _symbols(spark, d).filter(R.distinctive(F.col("name"))).select("name").distinct()


# ---------------------------------------------------------------- joins


@query(f"""
WITH b AS (SELECT DISTINCT file, base FROM bases WHERE contains(base, '.') AND file IS NOT NULL),
c AS (SELECT file, base, replace(regexp_replace(base, '\\.[^.]*$', ''), '.', '/') AS stem, list_transform(range(0, len(string_split(file, '/'))), lambda n: array_to_string(string_split(file, '/')[1:n], '/')) AS ups FROM b),
e AS (SELECT file, base, stem, unnest(ups) AS up, unnest(range(len(ups))) AS pos FROM c),
p AS (SELECT file, base, pos * 2 AS pos, CASE WHEN up = '' THEN stem ELSE up || '/' || stem END || '.py' AS cand FROM e UNION ALL SELECT file, base, pos * 2 + 1, CASE WHEN up = '' THEN stem ELSE up || '/' || stem END || '/__init__.py' FROM e)
SELECT b.file, b.base, m.resolved FROM b LEFT JOIN (SELECT file, base, arg_min(cand, pos) AS resolved FROM p WHERE cand IN (SELECT path FROM files) GROUP BY file, base) m USING (file, base)""")
def join01_module_of_base(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "bases").select("file", "base").dropna().filter(F.col("base").contains(".")).distinct().withColumn("_id", F.concat_ws("\n", "file", "base"))
    rows = rows.withColumn("_c", R.module_candidates(F.col("file"), F.regexp_replace("base", r"\.[^.]*$", ""), F.lit(0)))
    return R.first_match(rows, "_c", _files(spark, d).select(F.col("path").alias("_p")), "_p", "resolved").select("file", "base", "resolved")


@query(f"SELECT f.path, coalesce((SELECT arg_max(root, length(root)) FROM project_roots r WHERE starts_with(f.path, r.root || '/') AND length(r.root) > 1), '.') AS project FROM {_F} f")
def join04_project_of_file(spark: SparkSession, d: str) -> DataFrame:
    return R.longest_prefix(_files(spark, d), "path", table(spark, d, "project_roots"), "root", "project")


@query("""
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 2 ELSE 1 END AS l FROM events WHERE event_type IN ('view', 'click')),
m AS (SELECT p.event_id, v.l, v.event_id AS e, row_number() OVER (PARTITION BY p.event_id ORDER BY v.l DESC, v.ts DESC, v.event_id DESC) AS n FROM p JOIN v ON v.user_id = p.user_id AND v.ts <= p.ts AND epoch_us(p.ts) - epoch_us(v.ts) <= 2700000000)
SELECT p.event_id, m.l AS evidence, m.e AS evidence_event_id FROM p LEFT JOIN m ON m.event_id = p.event_id AND m.n = 1""")
def join15_evidence_window(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    past = events.filter(F.col("event_type").isin("view", "click")).withColumn("l", F.when(F.col("event_type") == "view", 2).otherwise(1))
    buys = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return R.evidence_in_window(buys, past, "user_id", "ts", 45 * 60, "l", ["event_id"]).select("event_id", "evidence", "evidence_event_id")


_SNAP = """sn AS (SELECT run_id, path, arg_max(sha1, mtime_ns) AS sha1 FROM (SELECT run_id, path, mtime_ns, max(sha1) AS sha1 FROM file_state WHERE sha1 IS NOT NULL AND path IS NOT NULL GROUP BY ALL) GROUP BY ALL),
ok AS (SELECT run_id, lag(run_id) OVER (ORDER BY run_id) AS before FROM (SELECT DISTINCT run_id FROM index_runs WHERE status = 'ok')),
ol AS (SELECT ok.run_id || ':' || path AS key, sha1 FROM sn JOIN ok ON ok.before = sn.run_id), nw AS (SELECT ok.run_id || ':' || path AS key, sha1 FROM sn JOIN ok ON ok.run_id = sn.run_id WHERE ok.before IS NOT NULL)"""


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(key, sha1) before and after each good run, keyed by run and path: every pair of runs at once."""
    state = table(spark, d, "file_state").filter("sha1 is not null and path is not null")
    seen = I.standing(state, ["run_id", "path"], ["sha1"], "mtime_ns")
    pairs = I.good_runs(table(spark, d, "index_runs"))
    of = lambda column: seen.join(pairs.withColumn("run_id", F.col(column)), "run_id").select(F.concat_ws(":", F.col("run").cast("string"), "path").alias("key"), "sha1")
    return of("before"), of("run")


@query(f"WITH {_SNAP} SELECT coalesce(ol.key, nw.key) AS key, CASE WHEN ol.key IS NULL THEN 'added' WHEN nw.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM ol FULL JOIN nw ON ol.key = nw.key WHERE ol.sha1 IS DISTINCT FROM nw.sha1")
def join19_snapshot_drift(spark: SparkSession, d: str) -> DataFrame:
    return R.drift(*_snapshots(spark, d), "key", "sha1")


@query(f"WITH {_SNAP} SELECT key, 'new' AS change FROM nw WHERE key NOT IN (SELECT key FROM ol) UNION ALL SELECT key, 'removed' FROM ol WHERE key NOT IN (SELECT key FROM nw)")
def set01_delta(spark: SparkSession, d: str) -> DataFrame:
    return R.symbol_delta(*_snapshots(spark, d), ["key"]).select("key", "change")


@query("SELECT DISTINCT b.file, b.qualname, b.base FROM bases b WHERE b.base IS NOT NULL AND b.base <> '' AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.name = b.base)")
def join20_dangling_bases(spark: SparkSession, d: str) -> DataFrame:
    return R.dangling(table(spark, d, "bases").select("file", "qualname", "base").distinct(), "base", table(spark, d, "symbols"), "name").select("file", "qualname", "base")


_SIM = """
WITH b AS (SELECT DISTINCT ON (sym_seq) * FROM bodies),
x AS (SELECT sym_seq, unnest(exact) AS v FROM b), n AS (SELECT sym_seq, unnest(normalized) AS v FROM b),
xo AS (SELECT p.sym_seq AS a, q.sym_seq AS b, count(*) AS x FROM x p JOIN x q ON p.v = q.v AND p.sym_seq < q.sym_seq GROUP BY ALL),
no AS (SELECT p.sym_seq AS a, q.sym_seq AS b, count(*) AS s FROM n p JOIN n q ON p.v = q.v AND p.sym_seq < q.sym_seq GROUP BY ALL HAVING count(*) >= 3),
j AS (SELECT no.a, no.b, no.s, coalesce(xo.x, 0) AS x, len(p.exact) + len(q.exact) - coalesce(xo.x, 0) AS xu, len(p.normalized) + len(q.normalized) - no.s AS su, least(len(p.exact), len(q.exact)) AS m, least(p.tokens, q.tokens) AS t,
  p.file = q.file AND (starts_with(p.qualname, q.qualname || '.') OR starts_with(q.qualname, p.qualname || '.')) AS nested
  FROM no LEFT JOIN xo USING (a, b) JOIN b p ON p.sym_seq = no.a JOIN b q ON q.sym_seq = no.b)
SELECT a, b, CASE WHEN x > 0 AND x * 10 >= xu * 7 THEN 'duplicate' WHEN s * 10 >= su * 8 THEN 'structural' WHEN t >= 40 AND NOT nested AND x > 0 AND x * 4 >= m * 3 THEN 'modified-copy' END AS kind,
  round(x / xu, 6) AS exact, round(s / su, 6) AS structural, round(x / m, 6) AS contained FROM j WHERE kind IS NOT NULL"""


@query(_SIM)
def join12_similar_bodies(spark: SparkSession, d: str) -> DataFrame:
    return S.similar_pairs(table(spark, d, "bodies"))


@query(f"""
WITH RECURSIVE pr AS (SELECT a, b FROM ({_SIM}) WHERE kind = 'duplicate'), li AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr),
re AS (SELECT a AS node, a AS other FROM li UNION SELECT re.node, li.b FROM re JOIN li ON li.a = re.other) SELECT node, min(other) AS component FROM re GROUP BY node""")
def gra08_duplicate_components(spark: SparkSession, d: str) -> DataFrame:
    return G8.components(S.similar_pairs(table(spark, d, "bodies")).filter("kind = 'duplicate'"))


# ---------------------------------------------------------------- aggregates


@query(f"WITH f AS (SELECT coalesce(kind, '') AS kind, coalesce(language, '') AS language, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS folder, lines FROM {_F}) SELECT 'kind' AS dimension, kind AS value, count(*) AS files, coalesce(sum(lines), 0) AS lines FROM f GROUP BY kind UNION ALL SELECT 'language', language, count(*), coalesce(sum(lines), 0) FROM f GROUP BY language UNION ALL SELECT 'folder', folder, count(*), coalesce(sum(lines), 0) FROM f GROUP BY folder")
def agg01_inventory_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.inventory_summary(_files(spark, d, "kind", "language", "lines"))


@query(f"SELECT language, count(*) AS files FROM {_F} WHERE is_text AND kind IN ('source', 'test', 'script') AND language <> '' AND language NOT IN ('python', 'javascript', 'typescript') GROUP BY language")
def agg02_unsupported(spark: SparkSession, d: str) -> DataFrame:
    return R.unsupported(_files(spark, d, "kind", "language", "is_text"), list(E.EXTRACTORS), F.col("is_text") & F.col("kind").isin("source", "test", "script"))


@query(f"SELECT root, kind, name, count(DISTINCT file) AS files, count(DISTINCT nullif(signature, '')) AS values, CASE WHEN kind = 'constant' AND count(DISTINCT nullif(signature, '')) = 1 THEN 'same value' WHEN kind = 'constant' THEN 'different values' ELSE 'parallel definitions' END AS verdict FROM {_SY} WHERE kind IN ('function', 'class', 'constant', 'type', 'interface', 'enum') AND exported GROUP BY root, kind, name HAVING count(DISTINCT file) > 1")
def agg05_same_name(spark: SparkSession, d: str) -> DataFrame:
    return R.same_name(_symbols(spark, d), "root")


@query(f"SELECT root, left(signature, 80) AS value, count(DISTINCT name) AS names, min(name) AS first_name FROM {_SY} WHERE kind = 'constant' AND length(left(signature, 80)) >= 8 GROUP BY ALL HAVING count(DISTINCT name) > 1")
def agg06_same_value(spark: SparkSession, d: str) -> DataFrame:
    return R.same_value(_symbols(spark, d), "root")


@query("SELECT base, file, list_sort(list(DISTINCT qualname)) AS names, 'confirmed' AS confidence FROM bases WHERE base IS NOT NULL GROUP BY base, file")
def agg08_dependents(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "bases").filter("base is not null").withColumn("confidence", F.lit("confirmed"))
    return R.grouped_dependents(links, "base", "file", "qualname", "confidence")


@query("SELECT run_id, path, count(DISTINCT sha1) AS items FROM file_state GROUP BY run_id, path HAVING count(DISTINCT sha1) > 1")
def agg09_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return R.conflicts(table(spark, d, "file_state"), ["run_id", "path"], "sha1")


# ---------------------------------------------------------------- ranking


_ASK = "validate user account handler"


def _related_sql() -> str:
    import re

    def stems(text: str) -> set[str]:
        words = {w for w in re.split(r"[^a-z0-9]+", text.lower()) if len(w) > 1 and w not in X.STOP_TERMS}
        more = {w[: -len(s)] for w in words for s in ("ing", "ed", "er", "es", "s") if w.endswith(s) and len(w) - len(s) >= 3}
        return words | more | {w[:5] for w in words}

    raw = stems(_ASK)
    wide = raw.union(*[set(g) for g in X.SYNONYMS if raw & set(g)])
    raw_keys, keys = {w[:5] for w in raw}, {w[:5] for w in wide}
    asked = ", ".join(f"('{k}', {k in raw_keys})" for k in sorted(keys))

    def keyed(name: str, column: str) -> str:
        split = f"string_split_regex(lower(regexp_replace(regexp_replace({column}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^A-Za-z0-9]+')"
        return f"""{name}_w AS (SELECT sym_seq, w FROM (SELECT sym_seq, unnest({split}) AS w FROM s) WHERE length(w) > 1 AND w NOT IN ({_STOPS})),
{name} AS (SELECT DISTINCT sym_seq, left(w, 5) AS term FROM (SELECT * FROM {name}_w UNION SELECT sym_seq, left(w, length(w) - 3) FROM {name}_w WHERE ends_with(w, 'ing') AND length(w) >= 6
 UNION SELECT sym_seq, left(w, length(w) - 2) FROM {name}_w WHERE (ends_with(w, 'ed') OR ends_with(w, 'er') OR ends_with(w, 'es')) AND length(w) >= 5
 UNION SELECT sym_seq, left(w, length(w) - 1) FROM {name}_w WHERE ends_with(w, 's') AND length(w) >= 4))"""

    stem = "regexp_replace(regexp_extract(file, '[^/]*$'), '([^.])\\.[^.]+$', '\\1') || ' ' || coalesce(string_split(file, '/')[-2], '')"
    return f"""
WITH s AS {_SY}, {keyed("nk", "qualname")}, {keyed("dk", "coalesce(doc, '')")}, {keyed("fk", stem)},
q(term, asked) AS (VALUES {asked}), tot AS (SELECT count(*) AS n FROM s), df AS (SELECT term, count(*) AS df FROM nk GROUP BY term),
wt AS (SELECT q.term, q.asked, greatest(0.2, ln((n + 1) / (coalesce(df, 0) + 1)) / ln(n + 1)) AS w FROM q LEFT JOIN df USING (term), tot),
h AS (SELECT sym_seq, 'n' AS part, CASE WHEN asked THEN 3.0 ELSE 2.0 END * w AS g FROM nk JOIN wt USING (term) UNION ALL SELECT sym_seq, 'd', w FROM dk JOIN wt USING (term) UNION ALL SELECT sym_seq, 'f', 0.5 * w FROM fk JOIN wt USING (term)),
g AS (SELECT sym_seq, sum(g) AS g, count(*) FILTER (part = 'n') AS hits, count(*) FILTER (part <> 'f') AS strong FROM h GROUP BY sym_seq HAVING strong > 0),
nn AS (SELECT sym_seq, count(*) AS n FROM nk GROUP BY sym_seq),
tests AS (SELECT DISTINCT path FROM files WHERE kind = 'test')
SELECT sym_seq, file, line, kind, qualname, round((g + coalesce(2.0 * hits / nn.n, 0) + CASE WHEN kind IN ('function', 'method', 'class') THEN 0.5 ELSE 0 END) * CASE WHEN file IN (FROM tests) THEN 0.4 ELSE 1 END, 6) AS score
FROM g JOIN s USING (sym_seq) LEFT JOIN nn USING (sym_seq) WHERE kind <> 'variable' OR exported ORDER BY score DESC, file, line, sym_seq LIMIT 10"""


@query(_related_sql())
def win01_related(spark: SparkSession, d: str) -> DataFrame:
    tests = table(spark, d, "files").filter("kind = 'test'").select("path")
    return R.related(_symbols(spark, d), _ASK, 10, tests)


@query(f"""
WITH b AS ({_related_sql().replace("LIMIT 10", "LIMIT 8")}), t AS (SELECT count(*) FILTER (score >= 4.5) AS strong, count(*) FILTER (score >= 2.5) AS candidates FROM b),
x AS (SELECT count(*) AS exact_hits FROM {_SY} WHERE name = 'validate_account' OR qualname = 'validate_account' OR ends_with(qualname, '.validate_account'))
SELECT CASE WHEN exact_hits > 0 THEN 'reuse' WHEN strong > 0 THEN 'extend' WHEN candidates > 0 THEN 'refactor-or-create' ELSE 'create' END AS decision, exact_hits, strong, candidates FROM t, x""")
def win02_reuse_decision(spark: SparkSession, d: str) -> DataFrame:
    return R.reuse_decision(_symbols(spark, d), _ASK, ["validate_account"])


@query(f"SELECT kind, name, file, rank FROM (SELECT kind, name, file, row_number() OVER (PARTITION BY kind ORDER BY end_line - line DESC NULLS LAST, sym_seq) AS rank FROM {_SY}) WHERE rank <= CASE kind WHEN 'class' THEN 3 WHEN 'function' THEN 8 ELSE 2 END")
def win06_per_kind_caps(spark: SparkSession, d: str) -> DataFrame:
    caps = {"class": 3, "function": 8}
    order = [F.desc_nulls_last(F.col("end_line") - F.col("line")), F.col("sym_seq")]
    return R.capped(_symbols(spark, d), ["kind"], order, caps, 2).select("kind", "name", "file", "rank")


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 45 MINUTE")
def win08_recent(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return R.recent(events, "ts", 45 * 60).select("event_id", "ts")


@query("SELECT 'M-' || CASE WHEN max(doc_id) + 1 > 9999 THEN cast(max(doc_id) + 1 AS VARCHAR) ELSE lpad(cast(max(doc_id) + 1 AS VARCHAR), 4, '0') END AS next_id FROM documents")
def win10_next_id(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "documents").select(F.concat(F.lit("M-"), F.col("doc_id").cast("string")).alias("id"))
    return R.next_id(items, "id")


# ---------------------------------------------------------------- sets, changes, validation


@query("""SELECT month, added, removed, CASE WHEN added - removed >= 150 AND removed > 0 AND added >= 3.0 * removed THEN 'additive-heavy' WHEN added - removed >= 150 AND removed = 0 THEN 'only-additions' END AS growth,
 (added + removed > 0 AND small >= 0.2 * greatest(added, 1) AND small >= 5) AS churn FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) FILTER (o_orderstatus <> 'F') AS added, count(*) FILTER (o_orderstatus = 'F') AS removed, count(*) FILTER (o_totalprice < 20000) AS small FROM orders GROUP BY 1)""")
def dif05_06_growth(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    rows = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(n(F.col("o_orderstatus") != "F").alias("added"), n(F.col("o_orderstatus") == "F").alias("removed"), n(F.col("o_totalprice") < 20000).alias("small"))
    return rows.select("month", "added", "removed", C.growth_shape(F.col("added"), F.col("removed"), F.lit(0)).alias("growth"), C.is_churn(F.col("added"), F.col("removed"), F.col("small")).alias("churn"))


# ---------------------------------------------------------------- extraction


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    """The facts of every source file, once a file; read once for all that follows."""
    return checkpoint(E.extract(_sources(spark, d).filter(F.col("text").isNotNull())).dropDuplicates(["file"]))


@query()
def ext01_symbols(spark: SparkSession, d: str) -> DataFrame:
    return E.rows_of(_extracted(spark, d), "symbols", "sym_seq")


@query()
def ext07_uses(spark: SparkSession, d: str) -> DataFrame:
    return E.rows_of(_extracted(spark, d), "uses", "use_seq").groupBy("use_kind", "language").agg(F.count("*").alias("uses"))


@query()
def join02_imports(spark: SparkSession, d: str) -> DataFrame:
    return E.resolved_imports(_extracted(spark, d), _files(spark, d)).select("file", "module", "line", "resolved", "confidence", "is_relative")


# ---------------------------------------------------------------- state


_EV = "(SELECT *, CASE event_type WHEN 'view' THEN 'low' WHEN 'click' THEN 'low' WHEN 'signup' THEN 'elevated' WHEN 'purchase' THEN 'elevated' ELSE 'high' END AS level FROM events)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("event_type").isin("view", "click"), "low").when(F.col("event_type").isin("signup", "purchase"), "elevated").otherwise("high")
    return table(spark, d, "events").withColumn("level", level)


@query("SELECT user_id, arg_min(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM events GROUP BY user_id")
def str03_once(spark: SparkSession, d: str) -> DataFrame:
    return ST.once(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@query("SELECT event_id, least(count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id), 2) AS count FROM events")
def str04_cap(spark: SparkSession, d: str) -> DataFrame:
    return ST.capped_count(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 2).select("event_id", "count")


@query(f"""WITH r AS (SELECT *, CASE level WHEN 'low' THEN 0 WHEN 'elevated' THEN 1 ELSE 2 END AS r FROM {_EV}), l AS (SELECT *, coalesce(lag(r) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS b FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, level ORDER BY ts, event_id) AS n FROM l WHERE r > b) SELECT event_id, user_id, level, CASE b WHEN 0 THEN 'low' WHEN 1 THEN 'elevated' ELSE 'high' END AS from_level FROM n WHERE n = 1""")
def str05_transition(spark: SparkSession, d: str) -> DataFrame:
    return ST.transitions(_events(spark, d), "user_id", ["ts", "event_id"], "level", X.LEVELS).select("event_id", "user_id", "level", "from_level")


@query("""
WITH e AS (SELECT user_id, ts, event_id, event_type, 'e' || (event_id % 7) AS t FROM events),
a AS (SELECT user_id, t, min(struct_pack(ts := ts, e := event_id)) AS since FROM e WHERE event_type = 'click' GROUP BY ALL),
q AS (SELECT user_id, t, min(struct_pack(ts := ts, e := event_id)) AS since FROM e WHERE event_type = 'error' GROUP BY ALL),
a2 AS (SELECT *, EXISTS (FROM e WHERE e.user_id = a.user_id AND e.event_type = 'signup' AND e.t = a.t AND struct_pack(ts := e.ts, e := e.event_id) >= a.since) AS done FROM a),
q2 AS (SELECT *, EXISTS (FROM e WHERE e.user_id = q.user_id AND e.event_type = 'purchase' AND e.t = q.t AND struct_pack(ts := e.ts, e := e.event_id) >= q.since) AS done FROM q),
u AS (SELECT DISTINCT user_id FROM events), ac AS (SELECT user_id, count(*) AS n, count(*) FILTER (NOT done) AS open FROM a2 GROUP BY user_id), qc AS (SELECT user_id, count(*) AS n, count(*) FILTER (NOT done) AS open FROM q2 GROUP BY user_id)
SELECT user_id, coalesce(ac.n, 0) AS assumptions, coalesce(qc.n, 0) AS questions, CASE WHEN coalesce(qc.open, 0) > 0 THEN 'blocked' WHEN coalesce(ac.open, 0) > 0 THEN 'awaiting-confirmation' ELSE 'clear' END AS state FROM u LEFT JOIN ac USING (user_id) LEFT JOIN qc USING (user_id)""")
def str07_decision_state(spark: SparkSession, d: str) -> DataFrame:
    text, is_ = F.concat(F.lit("e"), (F.col("event_id") % 7).cast("string")), lambda k: F.col("event_type") == k
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", F.when(is_("click"), text).alias("assumption"), F.lit(True).alias("material"), F.when(is_("error"), text).alias("question"), F.when(is_("purchase"), text).alias("resolve"), F.lit("").alias("answer"), F.when(is_("signup"), text).alias("confirm"))
    return ST.task_state(rows, "user_id", ["ts", "event_id"]).select("user_id", F.size("assumptions").alias("assumptions"), F.size("questions").alias("questions"), "state")

"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import credentials, function_docs, generated, leakage, near_duplicates, repetition, syntax, tokenization
from codeloom.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.not_hand_written(table(spark, sf_dir, "files")).select("path").distinct()


def p2_hand_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.hand_written(table(spark, sf_dir, "files")).select("path", "root", "language", "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.credentials(table(spark, sf_dir, "files"))


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.redacted(table(spark, sf_dir, "files").select("file_seq", "path", "text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.broken_paths(table(spark, sf_dir, "files"))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.fault_rates(table(spark, sf_dir, "files"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return function_docs.function_pairs(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "files")).select("sym_seq")


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return function_docs.function_pairs(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "files"), code=True)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_duplicates.similar_pairs(table(spark, sf_dir, "bodies"), "sym_seq", "exact")
    return pairs.select(F.col("a").alias("sym_a"), F.col("b").alias("sym_b"))


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(table(spark, sf_dir, "bodies"), "sym_seq", "exact")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenization.encode_corpus(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetitive(table(spark, sf_dir, "documents"))


def p10_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "p2_found": p2_found,
    "p2_hand_written": p2_hand_written,
    "p3_found": p3_found,
    "p3_redacted": p3_redacted,
    "p4_found": p4_found,
    "p4_rates": p4_rates,
    "p5_found": p5_found,
    "p5_pairs": p5_pairs,
    "p7_found": p7_found,
    "p7_groups": p7_groups,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_spans": p9_spans,
    "p10_found": p10_found,
    "p10_measures": p10_measures,
}

_CLEAN = "lower(regexp_replace(text, '[\\x{200B}\\x{200C}\\x{200D}\\x{AD}\\x{FEFF}]', '', 'g'))"
_WORDS = f"regexp_extract_all({_CLEAN}, '[\\p{{L}}\\p{{N}}]+')"
_RUNS = "unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')))"

_STOPS = ", ".join(f"'{w}'" for w in repetition.STOP_WORDS)
_PAIRS = """
WITH RECURSIVE b AS (SELECT DISTINCT ON (sym_seq) sym_seq, list_distinct(exact) AS e FROM bodies), x AS (SELECT sym_seq, unnest(e) AS v FROM b),
o AS (SELECT p.sym_seq AS sym_a, q.sym_seq AS sym_b, count(*) AS n FROM x p JOIN x q ON p.v = q.v AND p.sym_seq < q.sym_seq GROUP BY ALL),
pairs AS (SELECT sym_a, sym_b FROM o JOIN b p ON p.sym_seq = sym_a JOIN b q ON q.sym_seq = sym_b WHERE n * 10 >= (len(p.e) + len(q.e) - n) * 7)"""


def _broken(name: str, how: str, bound: float, least: int) -> str:
    return f"CASE WHEN words >= {least} AND {name} {how} {bound!r}::DOUBLE THEN '{name}' END"


ORACLES: dict[str, str] = {
    "p7_found": """
WITH b AS (SELECT DISTINCT ON (sym_seq) sym_seq, list_distinct(exact) AS e FROM bodies), x AS (SELECT sym_seq, unnest(e) AS v FROM b),
o AS (SELECT p.sym_seq AS sym_a, q.sym_seq AS sym_b, count(*) AS n FROM x p JOIN x q ON p.v = q.v AND p.sym_seq < q.sym_seq GROUP BY ALL)
SELECT sym_a, sym_b FROM o JOIN b p ON p.sym_seq = sym_a JOIN b q ON q.sym_seq = sym_b WHERE n * 10 >= (len(p.e) + len(q.e) - n) * 7""",
    "p7_groups": _PAIRS
    + """, li AS (SELECT sym_a AS a, sym_b AS b FROM pairs UNION ALL SELECT sym_b, sym_a FROM pairs), re AS (SELECT a AS node, a AS other FROM li UNION SELECT re.node, li.b FROM re JOIN li ON li.a = re.other)
SELECT b.sym_seq, coalesce((SELECT min(other) FROM re WHERE node = b.sym_seq), b.sym_seq) AS component, (SELECT count(*) FROM li WHERE a = b.sym_seq) AS links FROM b""",
    "p9_spans": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, {_RUNS} AS g FROM d WHERE len(w) >= 13), h AS (SELECT DISTINCT item_id, {_RUNS} AS g FROM i WHERE len(w) >= 13),
c AS (SELECT DISTINCT doc_id, item_id, unnest(range(p, p + 13)) AS q FROM g JOIN h USING (g)), s AS (SELECT *, q - row_number() OVER (PARTITION BY doc_id, item_id ORDER BY q) AS island FROM c),
l AS (SELECT doc_id, item_id, island, count(*) AS n FROM s GROUP BY ALL)
SELECT doc_id, item_id, max(n) AS longest, sum(n) AS leaked_words, any_value(len(w)) AS words FROM l JOIN d USING (doc_id) GROUP BY doc_id, item_id""",
    "p10_measures": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all({_CLEAN}, '\\p{{L}}+'), []) AS w FROM documents), n AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8),
g AS (SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS first FROM n), c AS (SELECT doc_id, count(DISTINCT i + k) AS c FROM g, range(0, 8) t(k) WHERE i > first GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS words, CASE WHEN len(w) > 0 THEN coalesce(c, 0) / len(w) ELSE 0.0 END AS repeated_share, CASE WHEN len(w) > 0 THEN length(array_to_string(w, '')) / len(w) ELSE 0.0 END AS mean_word_length,
 CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: x IN ({_STOPS}))) / len(w) ELSE 0.0 END AS stop_word_share, CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\s\\x0B]', '', 'g')) / length(text) ELSE 0.0 END AS symbol_share,
 list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: trim(x)), lambda x: x <> '') AS l FROM d LEFT JOIN c USING (doc_id)),
r AS (SELECT * EXCLUDE (l), CASE WHEN len(l) > 0 THEN (len(l) - len(list_distinct(l))) / len(l) ELSE 0.0 END AS duplicate_line_share FROM m)
SELECT *, list_filter([{", ".join(_broken(*rule) for rule in repetition.THRESHOLDS)}], lambda x: x IS NOT NULL) AS broken FROM r""",
    "p9_found": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
g AS (SELECT DISTINCT doc_id, {_RUNS} AS g FROM d WHERE len(w) >= 13), h AS (SELECT DISTINCT item_id, {_RUNS} AS g FROM i WHERE len(w) >= 13)
SELECT DISTINCT doc_id, item_id FROM g JOIN h USING (g)""",
    "p10_found": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_CLEAN}, '\\p{{L}}+') AS w FROM documents), n AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS first FROM n),
c AS (SELECT doc_id, count(DISTINCT i + k) AS c FROM g, range(0, 8) t(k) WHERE i > first GROUP BY doc_id)
SELECT doc_id FROM d JOIN c USING (doc_id) WHERE len(w) >= 50 AND c * 3 >= len(w)""",
}

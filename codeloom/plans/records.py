"""Queries p1_ and p6_: hierarchies, and records changed since the last good run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import hierarchy, incremental
from codeloom.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = hierarchy.numbered(*hierarchy.symbol_links(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "bases")))
    # Ids are in the order of the names; of two nodes on a cycle both pairs are one row.
    pairs = hierarchy.id_pairs(forest).select(F.greatest("id", "above").alias("id"), F.least("id", "above").alias("above")).distinct()
    return hierarchy.named(pairs, forest.names).select(F.col("tree").alias("link"), F.col("above").alias("node_a"), F.col("node").alias("node_b"))


def p1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = hierarchy.symbol_links(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "bases"))
    return hierarchy.hierarchy(nodes, edges).select(F.col("tree").alias("link"), "node", "root", "depth", "path", "ancestors", "descendants", "on_cycle")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.changed_since_last_good(table(spark, sf_dir, "file_state"), table(spark, sf_dir, "index_runs"), "run_id", "path", ["sha1", "index_version"], "sha1", "mtime_ns", clock="seen_at")


QUERIES = {"p1_found": p1_found, "p1_nodes": p1_nodes, "p6_found": p6_found}

_LINKS = """
WITH RECURSIVE s AS (SELECT DISTINCT file, qualname, kind, parent, file || '::' || qualname AS node FROM symbols WHERE file IS NOT NULL AND qualname IS NOT NULL),
c AS (SELECT DISTINCT file, qualname, node, replace(regexp_replace(file, '\\.[^./]*$', ''), '/', '.') || '.' || qualname AS dotted FROM s WHERE kind = 'class'),
b AS (SELECT DISTINCT file, base, file || '::' || qualname AS node FROM bases WHERE file IS NOT NULL AND qualname IS NOT NULL AND base IS NOT NULL),
e AS (
  SELECT DISTINCT 'parent' AS link, x.node, y.node AS up FROM s x JOIN (SELECT DISTINCT node FROM s) y ON x.file || '::' || x.parent = y.node WHERE x.parent <> ''
  UNION SELECT 'base', b.node, near.node FROM b JOIN c own ON own.node = b.node JOIN c near ON near.file = b.file AND near.qualname = b.base
  UNION SELECT 'base', b.node, far.node FROM b JOIN c own ON own.node = b.node LEFT JOIN c near ON near.file = b.file AND near.qualname = b.base JOIN c far ON far.dotted = b.base WHERE near.node IS NULL),
r AS (SELECT link, node, up FROM e UNION SELECT r.link, r.node, e.up FROM r JOIN e ON e.link = r.link AND e.node = r.up)
"""

ORACLES = {
    "p1_nodes": _LINKS
    + """, nd AS (SELECT DISTINCT 'parent' AS link, node FROM s UNION ALL SELECT DISTINCT 'base', node FROM c),
fp AS (SELECT link, node, min(up) AS up FROM e WHERE node <> up GROUP BY ALL), fr AS (SELECT link, node, up FROM fp UNION SELECT fr.link, fr.node, fp.up FROM fr JOIN fp ON fp.link = fr.link AND fp.node = fr.up),
cut AS (SELECT link, node FROM fr GROUP BY ALL HAVING bool_or(node = up) AND node = min(up)), f AS (SELECT * FROM fp WHERE (link, node) NOT IN (SELECT (link, node) FROM cut)),
t AS (SELECT link, node, node AS root, 0::BIGINT AS depth, node AS path FROM nd WHERE (link, node) NOT IN (SELECT (link, node) FROM f) UNION ALL SELECT f.link, f.node, t.root, t.depth + 1, t.path || ' > ' || f.node FROM t JOIN f ON f.link = t.link AND f.up = t.node),
au AS (SELECT link, node, count(*) AS n, bool_or(node = up) AS c FROM r GROUP BY ALL), du AS (SELECT link, up AS node, count(*) AS n FROM r GROUP BY ALL)
SELECT t.*, coalesce(au.n, 0) AS ancestors, coalesce(du.n, 0) AS descendants, coalesce(au.c, false) AS on_cycle FROM t LEFT JOIN au USING (link, node) LEFT JOIN du USING (link, node)""",
    "p1_found": _LINKS + "SELECT DISTINCT link, least(node, up) AS node_a, greatest(node, up) AS node_b FROM r",
    "p6_found": """
WITH ok AS (SELECT run_id, lag(run_id) OVER (ORDER BY run_id) AS before FROM (SELECT DISTINCT run_id FROM index_runs WHERE status = 'ok')),
v AS (SELECT run_id, path, sha1, index_version FROM (SELECT *, row_number() OVER (PARTITION BY run_id, path ORDER BY mtime_ns DESC NULLS LAST, sha1 DESC, index_version DESC NULLS LAST) AS k FROM file_state WHERE sha1 IS NOT NULL AND path IS NOT NULL) WHERE k = 1)
SELECT DISTINCT n.run_id, n.path FROM v n JOIN ok ON ok.run_id = n.run_id AND ok.before IS NOT NULL
LEFT JOIN v o ON o.run_id = ok.before AND o.path = n.path AND o.sha1 = n.sha1 AND o.index_version IS NOT DISTINCT FROM n.index_version
WHERE o.path IS NULL""",
}

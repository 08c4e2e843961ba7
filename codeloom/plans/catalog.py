"""All registered queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

from codeloom.plans import graph_queries, more_queries, records, reference, scalar_queries

FLAGSHIP = "fun01_02_classify"
MODULES = (records, reference, graph_queries, more_queries, scalar_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}

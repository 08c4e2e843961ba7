"""Run a registered query over a folder of tables: ``python -m codeloom QUERY FOLDER``; without one, list them.

Rows come out as JSON lines. The exit code is 1 if a row is a finding of severity error, 2 for an unknown query.
"""

from __future__ import annotations

import argparse
import sys

from codeloom.plans import catalog
from codeloom.runtime import local_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="codeloom", description=__doc__)
    parser.add_argument("query", nargs="?")
    parser.add_argument("folder", nargs="?", default=".")
    parser.add_argument("--cpus", type=int, default=8)
    given = parser.parse_args(argv)
    if given.query is None:
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    if given.query not in catalog.QUERIES:
        print(f"no query {given.query!r}", file=sys.stderr)
        return 2
    rows = catalog.QUERIES[given.query](local_session(given.cpus), given.folder)
    bad = False
    for line in rows.toJSON().toLocalIterator():
        print(line)
        bad = bad or '"severity":"error"' in line
    return int(bad)


if __name__ == "__main__":
    sys.exit(main())

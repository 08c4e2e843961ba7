"""How queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable


def registrar(queries: dict[str, Callable], oracles: dict[str, str]) -> Callable:
    """A decorator that puts a query under its name into one table, and its SQL, if there is one, into another."""

    def query(sql: str | None = None) -> Callable:
        def register(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return register

    return query

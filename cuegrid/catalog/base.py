"""Registry of the queries over the corpus tables and of the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
_SQL: dict[str, tuple[str, tuple[str, ...]]] = {}

#: Named SQL building blocks: name -> (names it needs, body).
_BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def block(name: str, body: str, *needs: str) -> None:
    """Name a common table expression that oracles can ask for."""
    _BLOCKS[name] = (needs, body)


def sql_with(body: str, *needs: str) -> str:
    """`body` preceded by the blocks it needs, in dependency order."""
    done: list[str] = []

    def add(name: str) -> None:
        for other in _BLOCKS[name][0]:
            add(other)
        if name not in done:
            done.append(name)

    for name in needs:
        add(name)
    if not done:
        return body
    parts = ",\n".join(f"{name} AS ({_BLOCKS[name][1]})" for name in done)
    return f"WITH {parts}\n{body}"


def query(name: str, sql: str | None = None, *needs: str):
    """Register a query; with `sql`, also its oracle (over the blocks in `needs`)."""

    def register(make: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = make
        if sql is not None:
            _SQL[name] = (sql, needs)
        return make

    return register


def oracles() -> dict[str, str]:
    return {name: sql_with(sql, *needs) for name, (sql, needs) in _SQL.items()}

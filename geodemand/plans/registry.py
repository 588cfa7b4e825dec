"""Registry of queries and, where SQL can say it, the equivalent statement over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    """A named subquery the statements may start from."""
    _CTES[name] = (needs, body)


def sql_with(body: str, *names: str) -> str:
    """Statement with the named subqueries, and all they need, in front."""
    done: list[str] = []

    def add(n: str) -> None:
        if n in done:
            return
        needs, _ = _CTES[n]
        for m in needs:
            add(m)
        done.append(n)

    for n in names:
        add(n)
    if body.lstrip().startswith(","):
        body = body.lstrip()
    if not done:
        return body
    head = ",\n".join(f"{n} AS ({_CTES[n][1]})" for n in done)
    return f"WITH {head}{body}" if body.startswith(",") else f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql_with(sql, *needs)
        return fn

    return wrap

"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_SQL[name] = sql
        return fn

    return wrap

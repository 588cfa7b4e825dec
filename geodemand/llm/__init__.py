"""Operators for preparing training data, and the queries that run them."""

from geodemand.llm import queries  # noqa: F401
from geodemand.llm.registry import LLM_QUERIES, LLM_SQL  # noqa: F401

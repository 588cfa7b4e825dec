"""Registered queries, grouped by the question they answer."""

from geodemand.plans import base_sql, panel_role, drill, place_role, space, scoring, insight, market, panel_plan, text, segment, stream, facts, io_trips  # noqa: F401
from geodemand.plans.registry import QUERIES, SQL  # noqa: F401

"""Bounded histories: last turns of a session, distinct facts, idle and surplus sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodemand.operators.ranking import top_n

# Turns in a prompt and on file, facts, sessions, days before a session expires.
PROMPT_TURNS, STORED_TURNS, MAX_FACTS, MAX_SESSIONS, TTL_DAYS = 24, 60, 25, 200, 14


def last_turns(turns: DataFrame, session: str, order: str, n: int = PROMPT_TURNS) -> DataFrame:
    """The n latest turns of each session; a long session is cut in every task before the shuffle."""
    return top_n(turns, [session], [F.desc(order)], n)


def distinct_facts(facts: DataFrame, session: str, order: str, text: str, n: int = MAX_FACTS) -> DataFrame:
    """First of each fact (case and blanks aside), of which the n latest are kept."""
    norm = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    first = facts.groupBy(session, norm.alias("_norm")).agg(
        F.min(order).alias(order), F.min_by(F.trim(text), order).alias(text)
    )
    return top_n(first.drop("_norm"), [session], [F.desc(order)], n)


def live_sessions(events: DataFrame, session: str, ts: str, now, days: int = TTL_DAYS, capacity: int = MAX_SESSIONS) -> DataFrame:
    """Sessions seen within the last days, the most recent ones up to the capacity."""
    seen = events.groupBy(session).agg(F.max(ts).alias("last_seen"))
    return (
        seen.where(F.col("last_seen") >= F.expr(f"timestampadd(DAY, -{int(days)}, timestamp_ntz'{now}')"))
        .orderBy(F.desc("last_seen"), session)
        .limit(capacity)
    )

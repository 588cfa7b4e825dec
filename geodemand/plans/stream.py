"""Streaming queries over the event table."""

from pyspark.sql import functions as F

from geodemand.plans.registry import query
from geodemand.streaming import events as E


@query(
    "stream_event_rollup",
    """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""",
)
def stream_event_rollup(spark, sf):
    r = E.run_once(E.read_events(spark, sf), E.daily_rollup(), "rollup")
    return r.withColumn("value", F.round("value", 4))


@query(
    "stream_idle_sessions",
    """WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS silent FROM events),
       s AS (SELECT user_id, ts, count(*) FILTER (silent > INTERVAL 12 HOURS) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS no FROM e)
       SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 12 HOURS AS expired, count(*) AS n FROM s GROUP BY user_id, no""",
)
def stream_idle_sessions(spark, sf):
    return E.run_once(E.read_events(spark, sf), E.idle_sessions(), "idle")

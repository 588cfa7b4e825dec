"""The monthly district panel: target and regressors from orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from geodemand.plans.registry import cte
from geodemand.session import stage
from geodemand.sources import roles

REGRESSORS = ["x1", "x2", "x3", "x4"]

cte(
    "panel",
    """SELECT district_id, CAST(month AS DATE) AS month,
       CAST(sum(tot) AS DOUBLE) / 100e0 AS y,
       CAST(sum(d) AS DOUBLE) / 100e0 / sum(k) AS x1, CAST(sum(q) AS DOUBLE) / sum(k) AS x2,
       CAST(sum(u) AS DOUBLE) / count(*) AS x3, CAST(sum(tx) AS DOUBLE) / 100e0 / sum(k) AS x4, count(*) AS n_orders
     FROM (SELECT p.district_id, date_trunc('month', o_orderdate) AS month,
        CAST(round(o_totalprice * 100) AS BIGINT) AS tot,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS u, d, q, tx, k
        FROM orders JOIN place p ON place_id = o_custkey
        JOIN (SELECT l_orderkey, sum(CAST(round(l_discount * 100) AS BIGINT)) AS d,
          sum(CAST(l_quantity AS BIGINT)) AS q, sum(CAST(round(l_tax * 100) AS BIGINT)) AS tx, count(*) AS k
          FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
     GROUP BY 1, 2""",
    "place",
)


def _build(spark, sf):
    li = roles.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("d"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("q"),
        F.sum(F.round(F.col("l_tax") * 100).cast("bigint")).alias("tx"),
        F.count(F.lit(1)).alias("k"),
    )
    o = roles.table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("place_id"),
        F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("tot"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("u"),
    )
    # Per place and month first: a place with a third of the orders shrinks to its months before
    # it meets the place dimension.
    sums = ("tot", "u", "d", "q", "tx", "k")
    per_place = (
        o.join(li, o.o_orderkey == li.l_orderkey)
        .groupBy("place_id", "month")
        .agg(*[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("n_orders"))
    )
    d = roles.places(spark, sf).select("place_id", "district_id")
    g = per_place.join(d, "place_id").groupBy("district_id", "month").agg(
        *[F.sum(c).alias(c) for c in (*sums, "n_orders")]
    )
    k = F.col("k")
    return g.select(
        "district_id",
        "month",
        (F.col("tot").cast("double") / 100.0).alias("y"),
        (F.col("d").cast("double") / 100.0 / k).alias("x1"),
        (F.col("q").cast("double") / k).alias("x2"),
        (F.col("u").cast("double") / F.col("n_orders")).alias("x3"),
        (F.col("tx").cast("double") / 100.0 / k).alias("x4"),
        "n_orders",
    )


def panel(spark, sf):
    return stage(spark, "panel", roles.paths(sf, "orders", "lineitem", "customer", "nation"), lambda: _build(spark, sf))

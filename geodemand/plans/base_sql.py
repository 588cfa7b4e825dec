"""Subqueries that derive the same roles in SQL as geodemand.sources.roles does in Spark."""

from geodemand.plans.registry import cte

cte(
    "place",
    """SELECT c_custkey AS place_id, c_name AS place,
       CAST(c_nationkey AS VARCHAR) || ':' || c_mktsegment AS block_id,
       c_nationkey AS district_id, c_mktsegment AS segment, c_acctbal AS acctbal,
       n_regionkey AS state_id,
       CAST(70 AS DOUBLE) + CAST((c_custkey * 7919) % 2000 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon,
       CAST(10 AS DOUBLE) + CAST((c_custkey * 104729) % 2500 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat
     FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
cte(
    "facility",
    """SELECT s_suppkey AS facility_id, s_nationkey AS district_id, n_regionkey AS state_id,
       CAST(70 AS DOUBLE) + CAST((s_suppkey * 6007) % 2000 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon,
       CAST(10 AS DOUBLE) + CAST((s_suppkey * 15485863) % 2500 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat
     FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
cte(
    "parts",
    """SELECT p_partkey, p_brand || ':' || p_type AS sku_id, p_brand AS player, p_type AS category,
       CASE WHEN p_size <= 12 THEN 'b1' WHEN p_size <= 25 THEN 'b2' WHEN p_size <= 38 THEN 'b3'
            ELSE 'b4' END AS band, p_retailprice
     FROM part""",
)
cte(
    "product",
    """SELECT sku_id, player, category, avg(p_retailprice) AS price, count(*) AS n_parts,
       avg(CASE WHEN band = 'b1' THEN 1e0 ELSE 0e0 END) AS b1,
       avg(CASE WHEN band = 'b2' THEN 1e0 ELSE 0e0 END) AS b2,
       avg(CASE WHEN band = 'b3' THEN 1e0 ELSE 0e0 END) AS b3,
       avg(CASE WHEN band = 'b4' THEN 1e0 ELSE 0e0 END) AS b4
     FROM parts GROUP BY ALL""",
    "parts",
)
cte(
    "mix",
    """SELECT o_custkey AS place_id, sku_id, player, category, band,
       sum(l_quantity) AS units,
       CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT)) AS BIGINT) AS v,
       sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0e0 END) AS returned,
       count(*) AS lines
     FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN parts ON l_partkey = p_partkey
     GROUP BY ALL""",
    "parts",
)
cte(
    "fact",
    """SELECT place_id, sku_id, player, category, sum(units) AS units,
       CAST((CAST(sum(v) AS BIGINT) + 50) // 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS value,
       CAST(sum(lines) AS BIGINT) AS lines, sum(returned) AS owned,
       sum(units) - sum(returned) AS headroom
     FROM mix GROUP BY place_id, sku_id, player, category""",
    "mix",
)
cte(
    "star",
    """SELECT f.*, p.place, p.block_id, p.district_id, p.state_id
     FROM fact f JOIN place p USING (place_id)""",
    "fact",
    "place",
)

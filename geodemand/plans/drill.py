"""Drill-down, ranking inside nodes, shares and summaries over the place x product fact."""

from __future__ import annotations

from pyspark.sql import functions as F

from geodemand.functions.scalars import equals_all, floored_ratio, right_closed_bin
from geodemand.operators import rollup as R
from geodemand.operators.levels import children, top_item_by_sum, unreconciled
from geodemand.operators.ranking import quantiles, top_n
from geodemand.plans import levels as LV
from geodemand.plans.registry import cte, query
from geodemand.session import stage
from geodemand.sources import roles

SUMS = ["units", "value", "owned", "headroom"]
ITEM = ["sku_id", "category"]


def r2(c):
    return F.round(c, 2)


def _shown():
    """What a drill shows of every node."""
    return [
        F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "top_sku_id", "top_category",
        *[r2(m).alias(m) for m in ("units", "value", "headroom")], F.round(floored_ratio("headroom", "units"), 6).alias("attach_gap"),
    ]


@query(
    "drill_region_nation",
    """, n AS (SELECT district_id, state_id, sum(units) AS units, sum(value) AS value,
          sum(owned) AS owned, sum(headroom) AS headroom FROM star GROUP BY 1, 2),
       t AS (SELECT district_id, sku_id, category FROM star
             QUALIFY row_number() OVER (PARTITION BY district_id ORDER BY units DESC, sku_id) = 1),
       g AS (SELECT district_id, avg(lon) AS lon, avg(lat) AS lat FROM place GROUP BY 1)
    SELECT n.district_id AS id, n_name AS name, r_name AS parent, round(lon, 6) AS lon, round(lat, 6) AS lat,
      round(n.units, 2) AS units, round(n.value, 2) AS value, round(n.headroom, 2) AS headroom,
      round(n.headroom / greatest(n.units, 1e-9), 6) AS attach_gap,
      t.sku_id AS top_sku_id, t.category AS top_category,
      round(n.units / sum(n.units) OVER (PARTITION BY n.state_id), 6) AS share_of_parent
    FROM n JOIN t USING (district_id) JOIN g USING (district_id)
      JOIN nation ON n_nationkey = n.district_id JOIN region ON r_regionkey = n.state_id""",
    needs=("star",),
)
def drill_region_nation(spark, sf):
    nodes = LV.nodes(spark, sf)
    parent = children(nodes, "state").select(F.col("id").alias("parent"), F.col("units").alias("_p"))
    return children(nodes, "district").join(parent, "parent").select(
        F.col("id").cast("int").alias("id"),
        "name",
        F.col("parent_name").alias("parent"),
        *_shown(),
        F.round(F.col("units") / F.col("_p"), 6).alias("share_of_parent"),
    ).orderBy(F.desc("units"), "id")


_BLOCK_SQL = """,
   n AS (SELECT block_id, district_id, sum(units) AS units, sum(value) AS value,
          sum(owned) AS owned, sum(headroom) AS headroom FROM star {where} GROUP BY 1, 2),
   t AS (SELECT block_id, sku_id, category FROM star
         QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY units DESC, sku_id) = 1)"""


@query(
    "drill_nation_block",
    _BLOCK_SQL.format(where="WHERE district_id = 7")
    + """, g AS (SELECT block_id, avg(lon) AS lon, avg(lat) AS lat FROM place GROUP BY 1)
    SELECT block_id AS id, district_id AS parent, round(lon, 6) AS lon, round(lat, 6) AS lat,
      sku_id AS top_sku_id, category AS top_category, round(units, 2) AS units,
      round(value, 2) AS value, round(headroom, 2) AS headroom,
      round(headroom / greatest(units, 1e-9), 6) AS attach_gap
    FROM n JOIN t USING (block_id) JOIN g USING (block_id)""",
    needs=("star",),
)
def drill_nation_block(spark, sf):
    n = children(LV.nodes(spark, sf), "block", 7)
    return n.select("id", F.col("parent").cast("int").alias("parent"), *_shown()).orderBy(F.desc("units"), "id")


@query(
    "drill_block_customer",
    """, n AS (SELECT place_id, place, block_id, sum(units) AS units, sum(value) AS value,
            sum(headroom) AS headroom FROM star WHERE block_id = '7:BUILDING' GROUP BY 1, 2, 3),
       t AS (SELECT place_id, sku_id, category FROM star
             QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY units DESC, sku_id) = 1)
    SELECT place_id AS id, place AS name, block_id AS parent, round(lon, 6) AS lon, round(lat, 6) AS lat,
      sku_id AS top_sku_id, category AS top_category, round(units, 2) AS units,
      round(value, 2) AS value, round(headroom, 2) AS headroom,
      round(headroom / greatest(units, 1e-9), 6) AS attach_gap, segment AS archetype
    FROM n JOIN t USING (place_id) JOIN (SELECT place_id, lon, lat, segment FROM place) USING (place_id)
    ORDER BY units DESC, id""",
    needs=("star",),
)
def drill_block_customer(spark, sf):
    n = children(LV.nodes(spark, sf), "place", "7:BUILDING")
    return n.select(F.col("id").cast("bigint").alias("id"), "name", "parent", *_shown(), F.col("segment").alias("archetype")).orderBy(F.desc("units"), "id")


@query(
    "level_rollup_reconciled",
    """SELECT state_id, district_id, block_id,
         CAST(grouping(state_id, district_id, block_id) AS BIGINT) AS grouping,
         round(sum(units), 2) AS units, round(sum(value), 2) AS value, round(sum(owned), 2) AS owned,
         round(sum(headroom), 2) AS headroom, count(*) AS n_rows
       FROM star GROUP BY ROLLUP (state_id, district_id, block_id)""",
    needs=("star",),
)
def level_rollup_reconciled(spark, sf):
    n = LV.nodes(spark, sf).where(F.col("level") != "place")
    ids = ["state_id", "district_id", "block_id"]
    code = F.when(F.col("level") == "block", 0).when(F.col("level") == "district", 1).otherwise(3).cast("bigint")
    total = children(n, "state").agg(*[F.sum(m).alias(m) for m in (*SUMS, "n_rows")])
    none = [F.lit(None).cast(n.schema[c].dataType).alias(c) for c in ids]
    t = n.select(*ids, code.alias("grouping"), *SUMS, "n_rows").unionByName(total.select(*none, F.lit(7).cast("bigint").alias("grouping"), *SUMS, "n_rows"))
    return t.select(*ids, "grouping", *[r2(m).alias(m) for m in SUMS], "n_rows")


@query(
    "levels_unreconciled",
    """SELECT CAST(level AS VARCHAR) AS level, CAST(id AS VARCHAR) AS id, CAST(units AS DOUBLE) AS units
       FROM (SELECT 'place' AS level, 0 AS id, 0e0 AS units) WHERE units > 0""",
)
def levels_unreconciled(spark, sf):
    """Nodes of either level table that differ from the sum of their children: none."""
    off = [unreconciled(t, LV.HIERARCHY, [*SUMS, "n_rows"]).select("level", "id", "units") for t in (LV.nodes(spark, sf), LV.items(spark, sf))]
    return off[0].unionByName(off[1])


@query(
    "top_item_by_sum",
    """SELECT district_id, sku_id AS top_sku_id, category AS top_category, round(units, 2) AS units FROM
         (SELECT district_id, sku_id, category, sum(units) AS units FROM star GROUP BY 1, 2, 3)
       QUALIFY row_number() OVER (PARTITION BY district_id ORDER BY units DESC, sku_id) = 1""",
    needs=("star",),
)
def top_item_of_districts_by_sum(spark, sf):
    d = children(LV.items_above(spark, sf), "district")
    best = top_item_by_sum(d, "units", ITEM)
    t = best.join(d, (best["id"] == d["id"]) & (best["top_sku_id"] == d["sku_id"]))
    return t.select(best["id"].cast("int").alias("district_id"), "top_sku_id", "top_category", r2("units").alias("units"))


@query(
    "level_item_rollup",
    """SELECT district_id, sku_id, category, round(sum(units), 2) AS units, round(sum(value), 2) AS value,
         round(sum(owned), 2) AS owned, round(sum(headroom), 2) AS headroom,
         round(avg(headroom / greatest(units, 1e-9)), 6) AS propensity, count(*) AS n_rows
       FROM star GROUP BY 1, 2, 3""",
    needs=("star",),
)
def level_item_rollup(spark, sf):
    return children(LV.items_above(spark, sf), "district").select(
        "district_id",
        "sku_id",
        "category",
        *[r2(m).alias(m) for m in SUMS],
        F.round(F.col("ratio_sum") / F.col("n_rows"), 6).alias("propensity"),
        "n_rows",
    )


@query(
    "sku_rank_in_node",
    """SELECT s.sku_id, s.player AS name, s.category, round(p.price, 4) AS price, round(sum(units), 2) AS units,
         round(sum(value), 2) AS value, round(sum(owned), 2) AS owned, round(sum(headroom), 2) AS headroom,
         round(avg(headroom / units), 6) AS propensity
       FROM star s JOIN product p ON p.sku_id = s.sku_id
       WHERE s.district_id = 7 AND s.category = 'PROMO'
       GROUP BY ALL ORDER BY units DESC, s.sku_id LIMIT 20""".replace("GROUP BY ALL", "GROUP BY s.sku_id, s.player, s.category, p.price"),
    needs=("star", "product"),
)
def sku_rank_in_node(spark, sf):
    g = LV.items_above(spark, sf).where(equals_all({"level": "district", "id": "7", "category": "PROMO"}))
    g = g.select("sku_id", F.col("player").alias("name"), "category", *SUMS, (F.col("ratio_sum") / F.col("n_rows")).alias("propensity"))
    p = roles.products(spark, sf).select("sku_id", F.round("price", 4).alias("price"))
    return (
        g.join(p, "sku_id")
        .select("sku_id", "name", "category", "price", *[r2(m).alias(m) for m in SUMS], F.round("propensity", 6).alias("propensity"))
        .orderBy(F.desc("units"), "sku_id")
        .limit(20)
    )


@query(
    "top_products_scoped",
    """SELECT s.sku_id, s.category, round(sum(units)) AS units_per_year, round(sum(headroom)) AS unserved, round(sum(value) / 1e7, 4) AS value_crore
       FROM star s WHERE s.state_id = 2 GROUP BY 1, 2 ORDER BY units_per_year DESC, s.sku_id LIMIT 10""",
    needs=("star",),
)
def top_products_scoped(spark, sf):
    g = LV.items_above(spark, sf).where(equals_all({"level": "state", "id": "2", "category": None}))
    return g.select("sku_id", "category", *_amounts()).orderBy(F.desc("units_per_year"), "sku_id").limit(10)


@query(
    "place_rank_scoped",
    """SELECT n_name AS name, r_name AS state, round(sum(units)) AS units_per_year,
         round(sum(headroom)) AS unserved, round(sum(value) / 1e7, 4) AS value_crore
       FROM star JOIN nation ON n_nationkey = district_id JOIN region ON r_regionkey = state_id
       WHERE category = 'ECONOMY' GROUP BY 1, 2 ORDER BY units_per_year DESC, name LIMIT 10""",
    needs=("star",),
)
def place_rank_scoped(spark, sf):
    return _ranked(spark, sf, "district", {"category": "ECONOMY", "state_id": None}, 10).select("name", F.col("parent_name").alias("state"), *_RANKED)


_RANKED = ("units_per_year", "unserved", "value_crore")


def _amounts():
    return [F.round("units").alias("units_per_year"), F.round("headroom").alias("unserved"), F.round(F.col("value") / 1e7, 4).alias("value_crore")]


def _ranked(spark, sf, level, scope, limit):
    """The first nodes of a level by units, of one product, category, state or district where asked.

    Rows of the level are added up per node only; no other level is opened, and no fact.
    """
    scoped = children(LV.items(spark, sf), level).where(equals_all(scope))
    g = scoped.groupBy("id").agg(*[F.sum(m).alias(m) for m in ("units", "value", "headroom")])
    names = children(LV.nodes(spark, sf), level).select("id", "name", "parent_name")
    top = g.select("id", *_amounts()).join(names, "id")
    return top.orderBy(F.desc("units_per_year"), "name").limit(limit)


_RANK_SQL = """SELECT '{level}' AS level, CAST({id} AS VARCHAR) AS id, CAST({name} AS VARCHAR) AS name, round(sum(units)) AS units_per_year,
         round(sum(headroom)) AS unserved, round(sum(value) / 1e7, 4) AS value_crore
       FROM star JOIN nation ON n_nationkey = district_id JOIN region ON r_regionkey = star.state_id
       WHERE category = 'ECONOMY' {scope} GROUP BY ALL ORDER BY units_per_year DESC, name LIMIT 5"""
_RANKS = {"state": ("star.state_id", "r_name", ""), "district": ("district_id", "n_name", "AND star.state_id = 1"), "block": ("block_id", "block_id", "AND district_id = 7"), "place": ("place_id", "place", "AND star.state_id = 1")}


@query(
    "rank_at_every_level",
    "SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(_RANK_SQL.format(level=k, id=i, name=n, scope=w) for k, (i, n, w) in _RANKS.items()) + ")",
    needs=("star",),
)
def rank_at_every_level(spark, sf):
    scopes = {"state": {}, "district": {"state_id": 1}, "block": {"district_id": 7}, "place": {"state_id": 1}}
    parts = [
        _ranked(spark, sf, level, {"category": "ECONOMY", **scope}, 5).select(F.lit(level).alias("level"), "id", "name", *_RANKED)
        for level, scope in scopes.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "top_sku_per_place",
    """SELECT place_id, rn AS rank, sku_id, round(units, 2) AS units FROM (
         SELECT place_id, sku_id, units, CAST(row_number() OVER (PARTITION BY place_id ORDER BY units DESC, sku_id) AS INT) AS rn
         FROM fact) WHERE rn <= 3""",
    needs=("fact",),
)
def top_sku_per_place(spark, sf):
    t = top_n(roles.fact(spark, sf), ["place_id"], [F.desc("units"), F.col("sku_id")], 3)
    return t.select("place_id", F.col("rn").alias("rank"), "sku_id", r2("units").alias("units"))


@query(
    "share_of_total_top5",
    """, n AS (SELECT district_id, sum(units) AS units FROM star GROUP BY 1),
       t AS (SELECT * FROM n ORDER BY units DESC, district_id LIMIT 5)
     SELECT count(*) AS n_nodes, round(sum(units), 2) AS top_units,
       round(sum(units) / (SELECT sum(units) FROM n) * 100, 6) AS top_share_pct FROM t""",
    needs=("star",),
)
def share_of_total_top5(spark, sf):
    n = children(LV.nodes(spark, sf), "district")
    return R.concentration(n, "district_id", "units").select(
        "n_nodes", r2("top_units").alias("top_units"), F.round("top_share_pct", 6).alias("top_share_pct")
    )


@query(
    "segment_over_index",
    """, c AS (SELECT sku_id, sum(units) AS u FROM star WHERE segment = 'BUILDING' GROUP BY 1),
       n AS (SELECT sku_id, sum(units) AS u FROM star GROUP BY 1)
     SELECT c.sku_id, p.player AS name, p.category, round(c.u, 2) AS units,
       round((c.u / (SELECT sum(u) FROM c)) / nullif(n.u / (SELECT sum(u) FROM n), 0), 8) AS index_vs_all
     FROM c JOIN n USING (sku_id) JOIN product p USING (sku_id)
     ORDER BY index_vs_all DESC, c.sku_id LIMIT 12""".replace("FROM star WHERE segment", "FROM star JOIN (SELECT place_id, segment FROM place) USING (place_id) WHERE segment"),
    needs=("star", "product"),
)
def segment_over_index(spark, sf):
    blocks = children(LV.items_above(spark, sf), "block")
    t = R.over_index(blocks, F.substring_index("id", ":", -1) == "BUILDING", "sku_id", "units")
    p = roles.products(spark, sf).select("sku_id", F.col("player").alias("name"), "category")
    return (
        t.join(p, "sku_id")
        .select("sku_id", "name", "category", r2("seg_units").alias("units"), F.round("index_vs_all", 8).alias("index_vs_all"))
        .orderBy(F.desc("index_vs_all"), "sku_id")
        .limit(12)
    )


@query(
    "class_breaks",
    """, n AS (SELECT state_id, district_id, block_id, sum(headroom) AS units FROM star GROUP BY 1, 2, 3),
      v AS (SELECT state_id, units, row_number() OVER (PARTITION BY state_id ORDER BY units) - 1 AS i,
              count(*) OVER (PARTITION BY state_id) AS k FROM n WHERE units > 0),
      l AS (SELECT state_id, min(units) AS lo, max(units) AS hi, max(k) AS k,
        max(CASE WHEN i = least(k - 1, CAST(floor(0.15e0 * k) AS BIGINT)) THEN units END) AS s1,
        max(CASE WHEN i = least(k - 1, CAST(floor(0.35e0 * k) AS BIGINT)) THEN units END) AS s2,
        max(CASE WHEN i = least(k - 1, CAST(floor(0.55e0 * k) AS BIGINT)) THEN units END) AS s3,
        max(CASE WHEN i = least(k - 1, CAST(floor(0.72e0 * k) AS BIGINT)) THEN units END) AS s4,
        max(CASE WHEN i = least(k - 1, CAST(floor(0.86e0 * k) AS BIGINT)) THEN units END) AS s5,
        max(CASE WHEN i = least(k - 1, CAST(floor(0.95e0 * k) AS BIGINT)) THEN units END) AS s6
        FROM v GROUP BY 1)
     SELECT n.state_id, block_id, round(units, 2) AS units,
       CAST(CASE WHEN units IS NULL OR units <= 0 THEN -1
         WHEN k < 8 OR (hi - lo) / hi < 0.4e0 THEN least(6, floor(units / hi * 7))
         ELSE (units > s1)::INT + (units > s2)::INT + (units > s3)::INT + (units > s4)::INT
            + (units > s5)::INT + (units > s6)::INT END AS INT) AS color_class
     FROM n LEFT JOIN l ON n.state_id = l.state_id""",
    needs=("star",),
)
def class_breaks(spark, sf):
    n = children(LV.nodes(spark, sf), "block").select("state_id", "district_id", "block_id", F.col("headroom").alias("units"))
    return R.class_breaks(n, ["state_id"], "units").select(
        "state_id", "block_id", r2("units").alias("units"), "color_class"
    )


@query(
    "name_contains_filter",
    "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%WIDG%'",
)
def name_contains_filter(spark, sf):
    return roles.table(spark, sf, "part").where(F.col("p_name").ilike("%WIDG%")).select("p_partkey", "p_name")


@query(
    "semi_members",
    """SELECT place_id, round(sum(units), 2) AS units FROM fact
       WHERE place_id IN (SELECT place_id FROM place WHERE block_id = '7:BUILDING') GROUP BY 1""",
    needs=("fact", "place"),
)
def semi_members(spark, sf):
    members = roles.places(spark, sf).where(F.col("block_id") == "7:BUILDING").select("place_id")
    f = roles.fact(spark, sf).join(members, "place_id", "left_semi")
    return f.groupBy("place_id").agg(r2(F.sum("units")).alias("units"))


@query(
    "bin_right_closed",
    """SELECT place_id, category, round(owned / units, 6) AS ratio,
         CASE WHEN owned / units > -0.01 AND owned / units <= 0.25 THEN 'rainfed'
              WHEN owned / units > 0.25 AND owned / units <= 0.6 THEN 'partial'
              WHEN owned / units > 0.6 AND owned / units <= 1.01 THEN 'assured' END AS class
       FROM (SELECT place_id, category, sum(owned) AS owned, sum(units) AS units FROM fact GROUP BY 1, 2)""",
    needs=("fact",),
)
def bin_right_closed(spark, sf):
    g = roles.fact(spark, sf).groupBy("place_id", "category").agg(
        F.sum("owned").alias("owned"), F.sum("units").alias("units")
    )
    g = g.withColumn("ratio", F.col("owned") / F.col("units"))
    return g.select(
        "place_id",
        "category",
        F.round("ratio", 6).alias("ratio"),
        right_closed_bin("ratio", [-0.01, 0.25, 0.6, 1.01], ["rainfed", "partial", "assured"]).alias("class"),
    )


@query(
    "top3_values_text",
    """, c AS (SELECT district_id, category, count(*) AS n FROM star GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY district_id ORDER BY n DESC, category) AS rn FROM c)
      SELECT district_id, string_agg(category, ', ' ORDER BY rn) AS top_categories FROM r WHERE rn <= 3 GROUP BY 1""",
    needs=("star",),
)
def top3_values_text(spark, sf):
    return R.top_values_text(roles.place_fact(spark, sf), ["district_id"], "category", 3, "top_categories")


@query(
    "quantiles_by_group",
    """SELECT category, round(quantile_cont(units, 0.1), 6) AS p10, round(quantile_cont(units, 0.25), 6) AS p25,
         round(quantile_cont(units, 0.5), 6) AS p50, round(quantile_cont(units, 0.75), 6) AS p75,
         round(quantile_cont(units, 0.9), 6) AS p90 FROM fact GROUP BY 1""",
    needs=("fact",),
)
def quantiles_by_group(spark, sf):
    q = quantiles(
        roles.fact(spark, sf), "units", ["category"], {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    )
    return q.select("category", *[F.round(c, 6).alias(c) for c in q.columns[1:]])


cte("class_units", "SELECT place_id, category, sum(units) AS units FROM fact GROUP BY 1, 2", "fact")


@query(
    "entropy_by_place",
    """, s AS (SELECT place_id, units / sum(units) OVER (PARTITION BY place_id) AS p FROM class_units)
      SELECT place_id, round(-sum(p * ln(p + 1e-12)) / ln(6), 6) AS entropy
      FROM s GROUP BY 1""",
    needs=("class_units",),
)
def entropy_by_place(spark, sf):
    g = roles.fact(spark, sf).groupBy("place_id", "category").agg(F.sum("units").alias("units"))
    e = R.split_entropy(g, ["place_id"], "units", len(roles.TYPES))
    return e.select("place_id", F.round("entropy", 6).alias("entropy"))


# Middle size in hectares of each holding class.
CLASS_MIDDLES = (0.5, 1.5, 3.0, 7.0)


@query(
    "gini_by_nation",
    """, b AS (SELECT district_id,
        sum(CASE WHEN band = 'b1' THEN m.units ELSE 0 END) / sum(m.units) AS b1,
        sum(CASE WHEN band = 'b2' THEN m.units ELSE 0 END) / sum(m.units) AS b2,
        sum(CASE WHEN band = 'b3' THEN m.units ELSE 0 END) / sum(m.units) AS b3,
        sum(CASE WHEN band = 'b4' THEN m.units ELSE 0 END) / sum(m.units) AS b4
        FROM mix m JOIN place USING (place_id) GROUP BY 1),
      a AS (SELECT *, b1 * 0.5e0 AS a1, b2 * 1.5e0 AS a2, b3 * 3e0 AS a3, b4 * 7e0 AS a4 FROM b),
      c AS (SELECT *, a1 / (a1 + a2 + a3 + a4) AS c1, (a1 + a2) / (a1 + a2 + a3 + a4) AS c2,
              (a1 + a2 + a3) / (a1 + a2 + a3 + a4) AS c3, 1e0 AS c4 FROM a)
      SELECT district_id, round(greatest(0.05e0, least(0.95e0,
        1 - ((c1 + c2) * b2 + (c2 + c3) * b3 + (c3 + c4) * b4))), 6) AS gini FROM c""",
    needs=("mix", "place"),
)
def gini_by_nation(spark, sf):
    d = roles.places(spark, sf).select("place_id", "district_id")
    g = roles.mix(spark, sf).join(d, "place_id").groupBy("district_id").agg(
        *[
            (F.sum(F.when(F.col("band") == b, F.col("units")).otherwise(0.0)) / F.sum("units")).alias(b)
            for b in roles.SIZE_BANDS
        ]
    )
    return g.select("district_id", F.round(R.gini(list(roles.SIZE_BANDS), list(CLASS_MIDDLES)), 6).alias("gini"))


@query(
    "hhi_by_type",
    """, s AS (SELECT category, player, sum(units) AS u FROM fact GROUP BY 1, 2),
      p AS (SELECT category, u / sum(u) OVER (PARTITION BY category) AS share FROM s)
      SELECT category, round(sum(share * share), 8) AS hhi FROM p GROUP BY 1""",
    needs=("fact",),
)
def hhi_by_type(spark, sf):
    s = children(LV.items_above(spark, sf), "state").groupBy("category", "player").agg(F.sum("units").alias("u"))
    g = s.groupBy("category").agg((F.sum(F.col("u") * F.col("u")) / F.pow(F.sum("u"), F.lit(2.0))).alias("hhi"))
    return g.select("category", F.round("hhi", 8).alias("hhi"))


@query(
    "allocate_to_children",
    """, w AS (SELECT place_id, district_id, sum(units) AS w FROM star GROUP BY 1, 2),
      t AS (SELECT o.district_id, CAST(sum(cents) AS DOUBLE) / 100e0 AS target FROM
            (SELECT p.district_id, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders JOIN place p ON place_id = o_custkey) o GROUP BY 1)
      SELECT place_id, w.district_id, round(w * target / sum(w) OVER (PARTITION BY w.district_id), 4) AS allocated
      FROM w JOIN t USING (district_id)""",
    needs=("star",),
)
def allocate_to_children(spark, sf):
    w = children(LV.nodes(spark, sf), "place").select("place_id", "district_id", F.col("units").alias("w"))
    o = roles.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("place_id"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("c")
    )
    per_place = o.groupBy("place_id").agg(F.sum("c").alias("c"))
    d = roles.places(spark, sf).select("place_id", "district_id")
    t = per_place.join(d, "place_id").groupBy("district_id").agg(
        (F.sum("c").cast("double") / 100.0).alias("target")
    )
    out = R.allocate(w.join(t, "district_id"), "district_id", "w", "target", "allocated")
    return out.select("place_id", "district_id", F.round("allocated", 4).alias("allocated"))


@query(
    "share_and_std_by_group",
    """, o AS (SELECT p.district_id, o_totalprice / 1000 AS v FROM orders JOIN place p ON place_id = o_custkey)
      SELECT district_id, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
        round(avg(CASE WHEN v < 100 THEN 1e0 ELSE 0e0 END), 8) AS low_share FROM o GROUP BY 1""",
    needs=("place",),
)
def share_and_std_by_group(spark, sf):
    d = roles.places(spark, sf).select("place_id", "district_id")
    o = roles.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("place_id"), (F.col("o_totalprice") / 1000).alias("v")
    )
    g = o.join(d, "place_id").groupBy("district_id").agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.avg((F.col("v") < 100).cast("double")).alias("s")
    )
    return g.select(
        "district_id", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("s", 8).alias("low_share")
    )


@query(
    "unpivot_metrics",
    """, g AS (SELECT district_id, sum(units) AS units, sum(value) AS value, sum(owned) AS owned FROM star GROUP BY 1)
      SELECT district_id, metric, round(v, 2) AS v FROM g UNPIVOT (v FOR metric IN (units, value, owned))""",
    needs=("star",),
)
def unpivot_metrics(spark, sf):
    g = children(LV.nodes(spark, sf), "district").select("district_id", "units", "value", "owned")
    return g.unpivot("district_id", ["units", "value", "owned"], "metric", "v").select(
        "district_id", "metric", r2("v").alias("v")
    )


@query(
    "pivot_category_units",
    """SELECT district_id, round(sum(units) FILTER (category = 'ECONOMY'), 2) AS economy,
         round(sum(units) FILTER (category = 'LARGE'), 2) AS large, round(sum(units) FILTER (category = 'PROMO'), 2) AS promo
       FROM star GROUP BY 1""",
    needs=("star",),
)
def pivot_category_units(spark, sf):
    g = children(LV.items_above(spark, sf), "district").groupBy("district_id").pivot("category", ["ECONOMY", "LARGE", "PROMO"]).agg(F.sum("units"))
    return g.select("district_id", *[r2(c).alias(c.lower()) for c in ("ECONOMY", "LARGE", "PROMO")])


@query(
    "having_filter",
    """SELECT sku_id, round(sum(owned), 2) AS owned FROM fact GROUP BY 1 HAVING sum(owned) >= 1500""",
    needs=("fact",),
)
def having_filter(spark, sf):
    g = children(LV.items_above(spark, sf), "state").groupBy("sku_id").agg(F.sum("owned").alias("owned"))
    return g.where(F.col("owned") >= 1500).select("sku_id", r2("owned").alias("owned"))


@query(
    "class_counts",
    """SELECT 'place' AS entity, segment AS class, count(*) AS n FROM place GROUP BY 2
       UNION ALL SELECT 'fact', category, count(*) FROM fact GROUP BY 2
       UNION ALL SELECT 'facility', 'all', count(*) FROM facility""",
    needs=("place", "fact", "facility"),
)
def class_counts(spark, sf):
    p = roles.places(spark, sf).groupBy(F.lit("place").alias("entity"), F.col("segment").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    f = roles.fact(spark, sf).groupBy(F.lit("fact").alias("entity"), F.col("category").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    s = roles.facilities(spark, sf).agg(F.count(F.lit(1)).alias("n")).select(F.lit("facility").alias("entity"), F.lit("all").alias("class"), "n")
    return p.unionByName(f).unionByName(s)


# Peak months of each product category.
SEASONS = {
    "ECONOMY": [4, 5, 6, 10, 11],
    "LARGE": [5, 6, 10],
    "MEDIUM": [3, 4, 10, 11],
    "PROMO": [9, 10, 11],
    "SMALL": [1, 2, 6, 7],
    "STANDARD": [6, 7, 8],
}

cte(
    "season",
    """SELECT sku_id, category, month_of_year,
         p * g / avg(p * g) OVER (PARTITION BY sku_id) AS season_index, p AS prior_index, g AS gamma
       FROM (SELECT sku_id, category, month_of_year, w / avg(w) OVER (PARTITION BY sku_id) AS p, g FROM (
         SELECT sku_id, category, gm.m AS month_of_year, gm.g,
           CASE WHEN (category = 'ECONOMY' AND gm.m IN (4, 5, 6, 10, 11)) OR (category = 'LARGE' AND gm.m IN (5, 6, 10))
             OR (category = 'MEDIUM' AND gm.m IN (3, 4, 10, 11)) OR (category = 'PROMO' AND gm.m IN (9, 10, 11))
             OR (category = 'SMALL' AND gm.m IN (1, 2, 6, 7)) OR (category = 'STANDARD' AND gm.m IN (6, 7, 8))
             THEN 1e0 ELSE 0.3e0 END AS w
         FROM product, (SELECT m, exp(s - avg(s) OVER ()) AS g FROM
           (SELECT month(month) AS m, avg(seasonal) AS s FROM month_seasonal GROUP BY 1)) gm))""",
    "product",
    "month_seasonal",
)
cte(
    "month_seasonal",
    """SELECT district_id, month, ln(y) - avg(ln(y)) OVER (PARTITION BY district_id) AS seasonal FROM panel""",
    "panel",
)


def seasons(spark, sf):
    """Season index of every product and month, from the panel's month effect and the fixed windows."""
    from geodemand.operators.indices import season_index
    from geodemand.operators.panel import log_departure

    windows = F.create_map(*[x for c, m in SEASONS.items() for x in (F.lit(c), F.array(*[F.lit(i) for i in m]))])
    p = roles.products(spark, sf).select("sku_id", "category", windows[F.col("category")].alias("season"))
    from geodemand.plans.panel_role import panel

    build = lambda: season_index(log_departure(panel(spark, sf), "district_id", "y", "seasonal"), p, "month", "seasonal")
    return stage(spark, "seasons", roles.paths(sf, "lineitem", "orders", "customer", "part"), build)


@query(
    "season_index",
    """SELECT sku_id, month_of_year, round(season_index, 8) AS season_index, round(prior_index, 8) AS prior_index,
         round(gamma, 8) AS gamma FROM season""",
    needs=("season",),
)
def season_index_query(spark, sf):
    s = seasons(spark, sf)
    return s.select(
        "sku_id", "month_of_year", *[F.round(c, 8).alias(c) for c in ("season_index", "prior_index", "gamma")]
    )


@query(
    "season_scaled_drill",
    """, f AS (SELECT avg(season_index) AS k FROM season WHERE category = 'ECONOMY' AND month_of_year = 10),
       n AS (SELECT district_id, sum(units) AS units, sum(value) AS value, sum(headroom) AS headroom
             FROM star WHERE category = 'ECONOMY' GROUP BY 1),
       g AS (SELECT district_id, sum(headroom) / greatest(sum(units), 1e-9) AS attach_gap FROM star GROUP BY 1),
       t AS (SELECT district_id, sku_id FROM star
             QUALIFY row_number() OVER (PARTITION BY district_id ORDER BY units DESC, sku_id) = 1)
      SELECT district_id, round(units * k, 4) AS units, round(value * k, 2) AS value, round(headroom, 2) AS headroom,
        round(attach_gap, 6) AS attach_gap, sku_id AS top_sku_id
      FROM n JOIN g USING (district_id) JOIN t USING (district_id), f""",
    needs=("star", "season"),
)
def season_scaled_drill(spark, sf):
    nodes, items = (children(t, "district") for t in (LV.nodes(spark, sf), LV.items_above(spark, sf)))
    nodes = nodes.withColumn("attach_gap", floored_ratio("headroom", "units"))
    k = R.season_factor(seasons(spark, sf), 10, category="ECONOMY")
    out = R.rescoped(nodes, items, "district_id", {"sku_id": None, "category": "ECONOMY"}, k)
    return out.select(
        "district_id",
        F.round("units", 4).alias("units"),
        r2("value").alias("value"),
        r2("headroom").alias("headroom"),
        F.round("attach_gap", 6).alias("attach_gap"),
        "top_sku_id",
    )

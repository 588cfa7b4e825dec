"""Spatial queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from geodemand.operators import spatial as S
from geodemand.operators.levels import children
from geodemand.plans import levels as LV
from geodemand.plans import place_role as PR
from geodemand.plans.registry import query, sql_with  # noqa: F401
from geodemand.sources import roles

_D = """sqrt((a.lon * 95e0 - b.lon * 95e0) * (a.lon * 95e0 - b.lon * 95e0)
        + (a.lat * 111e0 - b.lat * 111e0) * (a.lat * 111e0 - b.lat * 111e0))"""


@query(
    "nearest_facility",
    f""", d AS (SELECT a.place_id, b.facility_id, {_D} AS km FROM place a JOIN facility b ON a.state_id = b.state_id),
      m AS (SELECT place_id, facility_id, km FROM d QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY km, facility_id) = 1)
      SELECT place.place_id, CASE WHEN km <= 65 THEN facility_id END AS facility_id,
        round(least(65e0, coalesce(km, 65e0)), 6) AS dealer_distance_km,
        round(exp(-least(65e0, coalesce(km, 65e0)) / 18e0), 6) AS accessibility
      FROM place LEFT JOIN m USING (place_id)""",
    needs=("place", "facility"),
)
def nearest_facility(spark, sf):
    n = PR.dealer_distance(spark, sf)
    return n.select(
        "place_id",
        F.col("near_id").alias("facility_id"),
        F.round("near_km", 6).alias("dealer_distance_km"),
        F.round(F.exp(-F.col("near_km") / 18.0), 6).alias("accessibility"),
    )


@query(
    "knn_spatial_lag",
    """SELECT place_id, round(attach_rate, 6) AS attach_rate, round(peer_attach_rate, 6) AS peer_attach_rate,
         round(attach_rate - peer_attach_rate, 6) AS adoption_gap FROM feature JOIN peer USING (place_id)""",
    needs=("peer",),
)
def knn_spatial_lag(spark, sf):
    p = PR.peers(spark, sf)
    return p.select(
        "place_id",
        F.round("attach_rate", 6).alias("attach_rate"),
        F.round("peer_attach_rate", 6).alias("peer_attach_rate"),
        F.round(F.col("attach_rate") - F.col("peer_attach_rate"), 6).alias("adoption_gap"),
    )


@query(
    "nearest_seed",
    f""", seed AS (SELECT block_id, district_id, lon, lat, place_id FROM place
             QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY place_id) = 1)
      SELECT place_id, district_id, seed_id, round(km, 6) AS km FROM (
        SELECT a.place_id, a.district_id, b.place_id AS seed_id, {_D} AS km
        FROM place a JOIN seed b ON a.district_id = b.district_id)
      QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY km, seed_id) = 1""",
    needs=("place",),
)
def nearest_seed(spark, sf):
    p = roles.places(spark, sf).select("place_id", "block_id", "district_id", "lon", "lat")
    seeds = p.groupBy("block_id").agg(F.min_by(F.struct("place_id", "district_id", "lon", "lat"), "place_id").alias("s")).select("s.*")
    n = S.nearest(p, "place_id", seeds, "place_id", ["district_id"])
    return n.select("place_id", "district_id", F.col("near_id").alias("seed_id"), F.round("near_km", 6).alias("km"))


def district_cells(spark, sf):
    """A four-cornered cell and a concave notch per district, corners on whole numbers."""
    k = F.col("n_nationkey")
    x0 = (70 + (k % 5) * 4).cast("double")
    y0 = (10 + F.floor(k / 5) * 5).cast("double")
    pt = lambda dx, dy: F.array(x0 + dx, y0 + dy)
    ring = F.array(pt(0, 0), pt(4, 1), pt(4, 5), pt(2, 3), pt(0, 5))
    return roles.table(spark, sf, "nation").select(k.alias("cell_id"), F.array(ring).alias("rings"))


_CELL = """, v AS (SELECT n_nationkey AS cell_id, i, CAST(70 + (n_nationkey % 5) * 4 + [0, 4, 4, 2, 0][i] AS DOUBLE) AS x,
             CAST(10 + (n_nationkey // 5) * 5 + [0, 1, 5, 3, 5][i] AS DOUBLE) AS y FROM nation, range(1, 6) t(i))"""


@query(
    "point_in_polygon",
    _CELL
    + """, e AS (SELECT a.cell_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b
             ON a.cell_id = b.cell_id AND b.i = a.i % 5 + 1 WHERE a.y <> b.y)
      SELECT place_id, cell_id FROM place JOIN e ON ((y1 > lat) <> (y2 > lat))
        AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
      GROUP BY 1, 2 HAVING count(*) % 2 = 1""",
    needs=("place",),
)
def point_in_polygon(spark, sf):
    p = roles.places(spark, sf).select("place_id", "lon", "lat")
    return S.in_polygon(p, district_cells(spark, sf), "cell_id").select("place_id", "cell_id")


@query(
    "polygon_area",
    _CELL.replace(", v AS", "WITH v AS")
    + """, s AS (SELECT a.cell_id, abs(sum(a.x * b.y - b.x * a.y)) / 2 AS area, min(a.x) AS x_min, max(a.x) AS x_max,
          min(a.y) AS y_min, max(a.y) AS y_max, avg(a.x) AS cx, avg(a.y) AS cy FROM v a JOIN v b
          ON a.cell_id = b.cell_id AND b.i = a.i % 5 + 1 GROUP BY 1)
      SELECT cell_id, round(area, 6) AS area, x_min, x_max, y_min, y_max, round(cx, 6) AS centre_x, round(cy, 6) AS centre_y
      FROM s WHERE area >= 5""",
)
def polygon_area(spark, sf):
    m = S.ring_measures(district_cells(spark, sf), "cell_id", min_area=5.0)
    return m.select(
        "cell_id", F.round("area", 6).alias("area"), "x_min", "x_max", "y_min", "y_max",
        F.round("centre_x", 6).alias("centre_x"), F.round("centre_y", 6).alias("centre_y"),
    )


def _labelled(spark, sf):
    """Places with a coarse territorial label, blurred so that smoothing has work to do."""
    p = roles.places(spark, sf)
    label = F.when(F.col("place_id") % 7 == 0, F.lit(9)).otherwise(
        (F.floor((F.col("lon") - 70) / 5) + 4 * F.floor((F.col("lat") - 10) / 7)).cast("int")
    )
    return p.select("place_id", "state_id", "lon", "lat", label.alias("label"))


_LABEL = """, l AS (SELECT place_id, state_id, lon, lat, CASE WHEN place_id % 7 = 0 THEN 9 ELSE
      CAST(floor((lon - 70) / 5) + 4 * floor((lat - 10) / 7) AS INT) END AS label FROM place)"""


@query(
    "spatial_coherence",
    _LABEL
    + f""", n AS (SELECT a.place_id, a.label AS la, b.label AS lb FROM l a JOIN l b ON a.state_id = b.state_id AND a.place_id <> b.place_id
        QUALIFY row_number() OVER (PARTITION BY a.place_id ORDER BY {_D}, b.place_id) <= 8)
      SELECT count(*) FILTER (la = lb) AS same, count(*) AS pairs, round(count(*) FILTER (la = lb) / count(*), 8) AS coherence FROM n""",
    needs=("place",),
)
def spatial_coherence(spark, sf):
    c = S.coherence(_labelled(spark, sf), "place_id", ["state_id"], "label")
    return c.select("same", "pairs", F.round("coherence", 8).alias("coherence"))


@query(
    "spatial_majority",
    _LABEL
    + f""", n AS (SELECT a.place_id, b.label AS lb FROM l a JOIN l b ON a.state_id = b.state_id AND a.place_id <> b.place_id
        QUALIFY row_number() OVER (PARTITION BY a.place_id ORDER BY {_D}, b.place_id) <= 10),
      v AS (SELECT place_id, lb FROM n UNION ALL SELECT place_id, label FROM l),
      c AS (SELECT place_id, lb, count(*) AS k, sum(count(*)) OVER (PARTITION BY place_id) AS t FROM v GROUP BY 1, 2),
      w AS (SELECT place_id, lb FROM c WHERE k > t / 2)
      SELECT l.place_id, label, coalesce(lb, label) AS label_smooth FROM l LEFT JOIN w USING (place_id)""",
    needs=("place",),
)
def spatial_majority(spark, sf):
    return S.majority(_labelled(spark, sf), "place_id", ["state_id"], "label").select("place_id", "label", "label_smooth")


LOOK = ["avg_holding_ha", "irrigation_reliability", "cropping_intensity", "tractor_density", "attach_rate",
        "farm_power_kw_ha", "income_per_ha", "high_value_share", "residue_per_ha", "dealer_accessibility"]


@query(
    "lookalike",
    ", s AS (SELECT " + ", ".join(f"avg({m}) AS m_{m}, stddev_pop({m}) AS s_{m}" for m in LOOK) + " FROM feature),"
    + " t AS (SELECT * FROM feature WHERE place_id = 11)"
    + " SELECT f.place_id, f.state_id, round(sqrt("
    + " + ".join(
        f"pow((f.{m} - t.{m}) / (CASE WHEN s_{m} < 1e-9 THEN 1 ELSE s_{m} END), 2)" for m in LOOK
    )
    + "), 6) AS distance FROM feature f, s, t WHERE f.place_id <> 11 ORDER BY distance, f.place_id LIMIT 25",
    needs=("feature",),
)
def lookalike(spark, sf):
    t = S.lookalike(PR.features(spark, sf), "place_id", LOOK, 11, 25)
    return t.select("place_id", "state_id", F.round("distance", 6).alias("distance"))


@query(
    "place_features",
    "SELECT place_id, soil_texture, dominant_crop, " + ", ".join(PR.NUMERIC) + " FROM feature",
    needs=("feature",),
)
def place_features(spark, sf):
    f = PR.features(spark, sf)
    return f.select("place_id", "soil_texture", "dominant_crop", *PR.NUMERIC)


@query(
    "node_geometry_values",
    _CELL
    + """, n AS (SELECT district_id, sum(units) AS units, sum(headroom) AS headroom,
          arg_max(sku_id, units) AS top FROM (SELECT * FROM star WHERE category = 'PROMO' ORDER BY sku_id) GROUP BY 1),
       t AS (SELECT district_id, sku_id FROM star WHERE category = 'PROMO'
             QUALIFY row_number() OVER (PARTITION BY district_id ORDER BY units DESC, sku_id) = 1)
      SELECT n_nationkey AS id, CAST(1 AS BIGINT) AS n_rings, CAST(5 AS BIGINT) AS n_vertices, round(units, 2) AS units,
        round(headroom, 2) AS headroom, sku_id AS top_sku FROM nation LEFT JOIN n ON district_id = n_nationkey
        LEFT JOIN t ON t.district_id = n_nationkey""",
    needs=("star",),
)
def node_geometry_values(spark, sf):
    from geodemand.operators.rollup import top_item

    promo = children(LV.items_above(spark, sf), "district").where(F.col("category") == "PROMO")
    g = promo.groupBy(F.col("district_id").alias("cell_id")).agg(
        F.sum("units").alias("units"), F.sum("headroom").alias("headroom"), top_item(["sku_id"], "largest").alias("t")
    )
    j = district_cells(spark, sf).join(g, "cell_id", "left")
    return j.select(
        F.col("cell_id").alias("id"),
        F.size("rings").cast("bigint").alias("n_rings"),
        F.size(F.flatten("rings")).cast("bigint").alias("n_vertices"),
        F.round("units", 2).alias("units"),
        F.round("headroom", 2).alias("headroom"),
        F.col("t.sku_id").alias("top_sku"),
    )

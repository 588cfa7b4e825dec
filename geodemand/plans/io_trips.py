"""Readers and sinks on the given tables: each query writes a table out and reads it back, or reads it by the library's reader."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from geodemand.functions.scalars import amount_text, signed_text
from geodemand.plans.registry import query
from geodemand.session import shared_dir
from geodemand.sources import roles, sinks
from geodemand.sources import tables as T


def _fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("read_checked_table", "SELECT s_suppkey, s_nationkey FROM supplier")
def read_checked_table(spark, sf):
    return T.read_table(spark, f"{sf}/supplier.parquet", "the export").select("s_suppkey", "s_nationkey")


@query("registered_views", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def registered_views(spark, sf):
    names = T.register_views(spark, {f"given_{n}": f"{sf}/{n}.parquet" for n in ("nation", "region", "absent")})
    assert names == ["given_nation", "given_region"]
    return spark.sql("SELECT n_name, r_name FROM given_nation JOIN given_region ON n_regionkey = r_regionkey")


@query("csv_dimension", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def csv_dimension(spark, sf):
    path = _fresh(spark, "customers-csv")
    d = roles.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    d.write.csv(path, header=True)
    return T.read_dimension_csv(spark, path, d.schema)


@query("primary_or_fallback", "SELECT o_orderkey, 'simulated' AS provenance, 'synthetic' AS mode FROM orders WHERE o_totalprice > 100000")
def primary_or_fallback(spark, sf):
    o = roles.table(spark, sf, "orders")
    out = T.primary_or_fallback(o.where(F.col("o_totalprice") < 0), o.where(F.col("o_totalprice") > 100000))
    return out.select("o_orderkey", "provenance", "mode")


@query("json_per_node", "SELECT c_nationkey AS node, c_custkey, c_acctbal FROM customer")
def json_per_node(spark, sf):
    path = _fresh(spark, "nodes-json")
    d = roles.table(spark, sf, "customer").select(F.col("c_nationkey").alias("node"), "c_custkey", "c_acctbal")
    sinks.write_nodes_json(d, path, ["node"])
    return spark.read.schema(d.schema).json(path)


@query(
    "amount_texts",
    """, v AS (SELECT place_id, sum(value) AS value, sum(units) AS units FROM fact GROUP BY 1)
       SELECT place_id, CASE WHEN units >= 100 THEN format('{:,}', CAST(round_even(units, 0) AS BIGINT)) ELSE printf('%.1f', units) END || ' u' AS amount,
         CASE WHEN units >= 200 THEN '+' || CAST(CAST(units AS BIGINT) - 200 AS VARCHAR) ELSE CAST(CAST(units AS BIGINT) - 200 AS VARCHAR) END AS against_200 FROM v""",
    needs=("fact",),
)
def amount_texts(spark, sf):
    v = roles.fact(spark, sf).groupBy("place_id").agg(F.sum("units").alias("units"))
    return v.select("place_id", amount_text("units", " u").alias("amount"), signed_text(F.col("units") - 200, 0).alias("against_200"))


@query("written_table", "SELECT n_nationkey, n_name, 'allocated' AS provenance FROM nation")
def written_table(spark, sf):
    path = _fresh(spark, "nations")
    n = roles.table(spark, sf, "nation").select("n_nationkey", "n_name", F.lit("allocated").alias("provenance"))
    return T.read_table(spark, sinks.write_table(n, path), "the export")


@query(
    "geojson_shapes",
    """SELECT lower(regexp_replace(r_name, '[^A-Za-z0-9]', '', 'g')) AS state_key, 'supplier' || facility_id AS district_key,
         CAST(1 + facility_id % 2 AS INT) AS n_rings, round(lon, 2) AS west, round(lat + 1 + facility_id % 2, 2) AS north, 'suppliers' AS source
       FROM facility JOIN region ON r_regionkey = state_id""",
    needs=("facility",),
)
def geojson_shapes(spark, sf):
    """A shape of one or two triangles around every facility, written as one file and read by many tasks."""
    f = roles.facilities(spark, sf).join(roles.states(spark, sf), "state_id")
    corner = lambda x, y: F.array(F.round(F.col("lon") + x, 2), F.round(F.col("lat") + y, 2))
    ring = lambda up: F.array(corner(0, up), corner(1, up), corner(1, up + 1), corner(0, up))
    two = F.col("facility_id") % 2 == 1
    coordinates = F.when(two, F.to_json(F.array(F.array(ring(0)), F.array(ring(1))))).otherwise(F.to_json(F.array(ring(0))))
    properties = F.to_json(F.struct(
        F.col("state").alias("ST_NM"), F.concat(F.lit("Supplier "), F.col("facility_id").cast("string")).alias("District"), F.lit('no "brace } here\\').alias("note"),
    ))
    feature = F.concat(
        F.lit('{"type": "Feature", "properties": '), properties, F.lit(', "geometry": {"type": "'), F.when(two, "MultiPolygon").otherwise("Polygon"),
        F.lit('", "coordinates": '), coordinates, F.lit("}}"),
    )
    first = f.agg(F.min("facility_id").alias("m")).scalar()
    lines = f.select(F.lit(1).alias("part"), "facility_id", F.concat(F.when(F.col("facility_id") > first, ",").otherwise(""), feature).alias("value"))
    ends = [(0, 0, '{"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}}, "features": ['), (2, 0, "]}")]
    lines = lines.unionByName(spark.createDataFrame(ends, "part int, facility_id bigint, value string"))
    path = _fresh(spark, "shapes")
    lines.coalesce(1).sortWithinPartitions("part", "facility_id").select("value").write.text(path)
    shapes = T.read_geojson(spark, path, ["st_nm"], ["district"], "suppliers")
    points = F.flatten("rings")
    return shapes.select(
        "state_key", "district_key", F.size("rings").alias("n_rings"), F.array_min(F.transform(points, lambda p: p[0])).alias("west"),
        F.array_max(F.transform(points, lambda p: p[1])).alias("north"), "source",
    )

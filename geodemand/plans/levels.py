"""The stored level tables of places, blocks, districts and states, and what they are built from."""

from __future__ import annotations

from pyspark.sql import functions as F

from geodemand.operators.levels import Hierarchy, item_levels, node_levels
from geodemand.session import stage
from geodemand.sources import roles

SUMS = ("units", "value", "owned", "headroom")
HIERARCHY = Hierarchy(
    levels=(("place", "place_id"), ("block", "block_id"), ("district", "district_id"), ("state", "state_id")),
    sums=SUMS, item=("sku_id", "player", "category"), by="units", ratio="propensity",
)
INPUTS = ("lineitem", "orders", "part", "customer", "nation", "region")
FOLDERS = ("level", "shard")


def _star(spark, sf):
    star = roles.place_fact(spark, sf).drop("place")
    return star.withColumn("propensity", F.col("headroom") / F.greatest(F.col("units"), F.lit(1e-9)))


def _attributes(spark, sf):
    """Name, name of the parent, centre and segment of every node."""
    p = roles.places(spark, sf)
    d = roles.districts(spark, sf).join(roles.states(spark, sf), "state_id")
    centre = [F.avg("lon").alias("lon"), F.avg("lat").alias("lat")]
    node = lambda level, id, name, parent, segment: [
        F.lit(level).alias("level"), F.col(id).cast("string").alias("id"), name.cast("string").alias("name"), parent.cast("string").alias("parent_name"),
        "lon", "lat", segment.cast("string").alias("segment"),
    ]
    none = F.lit(None)
    place = p.select(*node("place", "place_id", F.col("place"), F.col("block_id"), F.col("segment")))
    block = p.groupBy("block_id", "district_id", "segment").agg(*centre).join(d.select("district_id", "district"), "district_id")
    block = block.select(*node("block", "block_id", F.col("block_id"), F.col("district"), F.col("segment")))
    district = p.groupBy("district_id").agg(*centre).join(d, "district_id").select(*node("district", "district_id", F.col("district"), F.col("state"), none))
    state = p.groupBy("state_id").agg(*centre).join(roles.states(spark, sf), "state_id").select(*node("state", "state_id", F.col("state"), none, none))
    return place.unionByName(block).unionByName(district).unionByName(state)


def items(spark, sf):
    """One row per level, node and product."""
    return stage(spark, "items_by_level", roles.paths(sf, *INPUTS), lambda: item_levels(_star(spark, sf), HIERARCHY), partition_by=FOLDERS)


def items_above(spark, sf):
    """The rows of `items` above the places: a small table, and what most questions read."""
    build = lambda: item_levels(_star(spark, sf), HIERARCHY, finest=False)
    return stage(spark, "items_above_places", roles.paths(sf, *INPUTS), build, partition_by=FOLDERS)


def nodes(spark, sf):
    """One row per level and node."""
    build = lambda: node_levels(_star(spark, sf), HIERARCHY, _attributes(spark, sf))
    return stage(spark, "nodes_by_level", roles.paths(sf, *INPUTS), build, partition_by=FOLDERS)

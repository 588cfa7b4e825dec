"""Level tables: they reconcile, agree with a direct aggregation, and questions open the folders they need only."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from geodemand.operators import levels as L
from geodemand.plans import QUERIES
from geodemand.plans import levels as LV

H = L.Hierarchy(levels=(("shop", "shop_id"), ("town", "town_id"), ("land", "land_id")), sums=("sold", "left"), item=("item",), by="sold", ratio="r")


def star(spark, n=4000):
    """Town 3 holds a third of all shops; town ids and shop ids are the same numbers."""
    rows = []
    for i in range(n):
        shop = i % 211
        town = 3 if shop % 3 == 0 else shop % 17
        rows.append((shop, town, town % 4, f"item{i * 7 % 23}", float(i * 31 % 97), float(i % 5), i % 10 / 10))
    return spark.createDataFrame(rows, "shop_id int, town_id int, land_id int, item string, sold double, left double, r double")


def written(df, path):
    df.write.partitionBy("level", "shard").parquet(path)
    return df.sparkSession.read.parquet(path)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    s = star(spark)
    names = s.select(F.lit("town").alias("level"), F.col("town_id").cast("string").alias("id")).distinct().withColumn("name", F.concat(F.lit("town "), "id"))
    folder = tmp_path_factory.mktemp("levels")
    return s.toPandas(), written(L.item_levels(s, H), f"{folder}/items"), written(L.node_levels(s, H, names), f"{folder}/nodes")


def test_levels_agree_with_a_direct_sum(tables):
    rows, items, nodes = tables
    for level, column in H.levels:
        want = rows.groupby([column, "item"]).agg(sold=("sold", "sum"), left=("left", "sum"), n_rows=("sold", "size"), largest=("sold", "max"), mean=("r", "mean"))
        got = L.children(items, level).withColumn("mean", F.col("ratio_sum") / F.col("n_rows")).toPandas()
        got[column] = got["id"].astype(int)
        got = got.set_index([column, "item"])[list(want)].sort_index()
        pd.testing.assert_frame_equal(got, want.sort_index(), check_dtype=False, check_index_type=False)
        n = L.children(nodes, level).toPandas().assign(key=lambda x: x["id"].astype(int)).set_index("key").sort_index()
        total = rows.groupby(column).agg(sold=("sold", "sum"), shops=("shop_id", "nunique")).sort_index()
        assert n["sold"].tolist() == total["sold"].tolist() and n["n_finest"].tolist() == total["shops"].tolist()
        # The top item is that of the largest shop and item, not of the largest sum.
        fine = rows.groupby([c for _, c in H.levels] + ["item"], as_index=False)["sold"].sum().sort_values(["sold", "item"], ascending=[False, True])
        assert n["top_item"].to_dict() == fine.groupby(column).head(1).set_index(column)["item"].to_dict()


def test_levels_reconcile_and_tampering_shows(tables):
    _, items, nodes = tables
    for t in (items, nodes):
        assert L.unreconciled(t, H, ["sold", "left", "n_rows"]).count() == 0
        changed = t.withColumn("sold", F.col("sold") + F.when((F.col("level") == "town") & (F.col("id") == "3"), 1.0).otherwise(0.0))
        off = {(r.level, r.id) for r in L.unreconciled(changed, H, ["sold"]).collect()}
        assert off == {("town", "3"), ("land", "3")}


def test_top_item_by_sum(tables):
    rows, items, _ = tables
    got = {r.id: r.top_item for r in L.top_item_by_sum(L.children(items, "town"), "sold", ["item"]).collect()}
    sums = rows.groupby(["town_id", "item"], as_index=False)["sold"].sum().sort_values(["sold", "item"], ascending=[False, True])
    assert got == {str(r.town_id): r.item for r in sums.groupby("town_id").head(1).itertuples()}


def test_ancestors_and_names(tables):
    _, items, nodes = tables
    town = L.node(nodes, "town", 3, 3).first()
    assert (town.name, town.land_id, town.shop_id, town.parent) == ("town 3", 3, None, "3")
    assert L.children(items, "shop", 3).select("land_id").distinct().collect() == [(3,)]


def test_children_open_one_folder(tables):
    _, items, _ = tables
    kids = L.children(items, "shop", 3)
    assert kids.select("town_id").distinct().collect() == [(3,)]
    plan = kids._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*level[^\]]*shard", plan) and "EqualTo(parent,3)" in plan
    assert {f.split("/level=")[1].rsplit("/", 1)[0] for f in kids.inputFiles()} >= {f"shop/shard={L.shard_of(3)}"}


def test_a_parent_with_many_children_is_cut_over_files(spark, tmp_path):
    few = spark.range(40_000).select(F.lit("shop").alias("level"), F.lit(1).alias("shard"), F.lit("3").alias("parent"), F.col("id").cast("string").alias("id"))
    written(L.laid_out(few, "id"), f"{tmp_path}/t")
    sizes = [r["n"] for r in spark.read.parquet(f"{tmp_path}/t").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 6 and max(sizes) < 12_000


@pytest.mark.parametrize("name,level", [
    ("drill_region_nation", "district"), ("drill_nation_block", "block"), ("drill_block_customer", "place"), ("sku_rank_in_node", "district"),
    ("place_rank_scoped", "district"), ("share_of_total_top5", "district"), ("segment_over_index", "block"), ("top_products_scoped", "state"), ("level_item_rollup", "district"),
])
def test_questions_read_level_tables(spark, sf, name, level):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity" not in plan and "o_custkey" not in plan
    for scan in re.findall(r"FileScan parquet .*", physical):
        if "by_level" in scan:
            assert f"level#" in scan.split("PartitionFilters: ")[1].split("]")[0] and level in physical


def test_levels_of_the_given_tables(spark, sf):
    n = LV.nodes(spark, sf).toPandas()
    assert set(n["level"]) == {"place", "block", "district", "state"} and n["name"].notna().all()
    assert n.groupby("level")["units"].sum().nunique() == 1

"""How the given tables play the parts of the demand model, and the shared stage tables.

state = region, district = nation, block = nation and market segment, place = customer,
facility = supplier, product = brand and type of a part, fact = what a place bought.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geodemand.session import spread, stage

# Upper size of each holding class and the product types that count as crops.
SIZE_BANDS = ("b1", "b2", "b3", "b4")
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def paths(sf: str, *names: str) -> list[str]:
    return [f"{sf}/{n}.parquet" for n in names]


def _coordinate(key: str, a: int, n: int, base: int):
    return F.lit(float(base)) + F.pmod(F.col(key) * a, F.lit(n)).cast("double") / 100.0


def states(spark, sf) -> DataFrame:
    return table(spark, sf, "region").select(
        F.col("r_regionkey").alias("state_id"), F.col("r_name").alias("state")
    )


def districts(spark, sf) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("district_id"),
        F.col("n_name").alias("district"),
        F.col("n_regionkey").alias("state_id"),
    )


def places(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    d = districts(spark, sf).select("district_id", "state_id")
    return c.select(
        F.col("c_custkey").alias("place_id"),
        F.col("c_name").alias("place"),
        F.concat_ws(":", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("block_id"),
        F.col("c_nationkey").alias("district_id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("acctbal"),
        _coordinate("c_custkey", 7919, 2000, 70).alias("lon"),
        _coordinate("c_custkey", 104729, 2500, 10).alias("lat"),
    ).join(d, "district_id")


def facilities(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier")
    d = districts(spark, sf).select("district_id", "state_id")
    return s.select(
        F.col("s_suppkey").alias("facility_id"),
        F.col("s_nationkey").alias("district_id"),
        _coordinate("s_suppkey", 6007, 2000, 70).alias("lon"),
        _coordinate("s_suppkey", 15485863, 2500, 10).alias("lat"),
    ).join(d, "district_id")


def size_band():
    p = F.col("p_size")
    return F.when(p <= 12, "b1").when(p <= 25, "b2").when(p <= 38, "b3").otherwise("b4")


def parts(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey",
        F.concat_ws(":", "p_brand", "p_type").alias("sku_id"),
        F.col("p_brand").alias("player"),
        F.col("p_type").alias("category"),
        size_band().alias("band"),
        "p_retailprice",
    )


def _build_products(spark, sf) -> DataFrame:
    p = parts(spark, sf)
    return p.groupBy("sku_id", "player", "category").agg(
        F.avg("p_retailprice").alias("price"),
        F.count(F.lit(1)).alias("n_parts"),
        *[F.avg((F.col("band") == b).cast("double")).alias(b) for b in SIZE_BANDS],
    )


def products(spark, sf) -> DataFrame:
    """Product dimension: price and the mix of sizes it comes in."""
    return stage(spark, "products", paths(sf, "part"), lambda: _build_products(spark, sf))


def cents(ten_thousandths):
    """Exact cents from a whole number of ten-thousandths."""
    return F.floor((ten_thousandths + 50) / 100).cast("bigint")


def _build_mix(spark, sf) -> DataFrame:
    """Place x product x size band, the finest grain any operator needs.

    Money is added up in whole ten-thousandths so every rebuild gives the same total whatever
    the order of the rows.
    """
    li = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_quantity",
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10000).cast("bigint").alias("v"),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0).alias("returned"),
    )
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    p = parts(spark, sf).select("p_partkey", "sku_id", "player", "category", "band")
    bought = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    # A place's lines meet in one task, and there the sums are formed: lines are moved to their place once.
    return (
        spread(bought.withColumnRenamed("o_custkey", "place_id"), "place_id")
        .groupBy("place_id", "sku_id", "player", "category", "band")
        .agg(
            F.sum("l_quantity").alias("units"),
            F.sum("v").alias("v"),
            F.sum("returned").alias("returned"),
            F.count(F.lit(1)).alias("lines"),
        )
    )


def mix(spark, sf) -> DataFrame:
    return stage(
        spark, "mix", paths(sf, "lineitem", "orders", "part"), lambda: _build_mix(spark, sf), bucket_by="place_id"
    )


def _build_fact(spark, sf) -> DataFrame:
    m = mix(spark, sf)
    f = m.groupBy("place_id", "sku_id", "player", "category").agg(
        F.sum("units").alias("units"),
        (cents(F.sum("v")) / F.lit(100.0)).alias("value"),
        F.sum("lines").alias("lines"),
        F.sum("returned").alias("owned"),
    )
    return f.withColumn("headroom", F.col("units") - F.col("owned"))


def fact(spark, sf) -> DataFrame:
    """Place x product: units, value, lines, owned, headroom."""
    return stage(
        spark, "fact", paths(sf, "lineitem", "orders", "part"), lambda: _build_fact(spark, sf), bucket_by="place_id"
    )


def place_fact(spark, sf) -> DataFrame:
    """Fact with the place's parents; the star the drill and ranking queries read."""
    p = places(spark, sf).select("place_id", "place", "block_id", "district_id", "state_id")
    return fact(spark, sf).join(p, "place_id")

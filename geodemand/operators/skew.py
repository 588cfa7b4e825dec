"""Joins that stay balanced when one key holds a large part of the rows.

Lookups of one row per group are left to adaptive execution, which broadcasts a side it has
measured to be small and splits skewed partitions otherwise. The joins here are for keys whose
row counts are known while the plan is built, such as ties and grid cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geodemand.session import parallelism

SALT = "_salt"


def _same(keys: list[str]) -> Column:
    """Null-safe equality of the keys with their h_-prefixed twins."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"h_{k}")) for k in keys])


def hot_keys(weights: DataFrame, keys: list[str], weight: str, ways: int | None = None) -> DataFrame | None:
    """Keys that hold more than 1/ways of all rows with the number of salts each needs, or None.

    At most `ways` keys can exceed that share, so what reaches the driver and is broadcast later
    is bounded by construction whatever the data size.
    """
    ways = ways or parallelism(weights.sparkSession)
    top, total = weights.agg(F.max(weight), F.sum(weight)).first()
    if not total or top <= max(total / ways, 1.0):
        return None
    share = total / ways
    hot = weights.where(F.col(weight) > share).select(
        *[F.col(k).alias(f"h_{k}") for k in keys], F.ceil(F.col(weight) / share).cast("int").alias("h_n")
    )
    return weights.sparkSession.createDataFrame(hot.collect(), hot.schema)


def add_salt(rows: DataFrame, hot: DataFrame, keys: list[str], spread_by: list) -> DataFrame:
    """Salt the rows of hot keys by a hash of `spread_by`; every other row gets salt 0.

    A hash rather than a random number, so a recomputed task gives the same salts.
    """
    return (
        rows.join(F.broadcast(hot), _same(keys), "left")
        .withColumn(
            SALT,
            F.when(F.col("h_n").isNotNull(), F.pmod(F.xxhash64(*spread_by), F.col("h_n"))).otherwise(
                F.lit(0)
            ).cast("int"),
        )
        .drop(*[f"h_{k}" for k in keys], "h_n")
    )


def add_all_salts(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Repeat the rows of hot keys once per salt so they meet every salted partner."""
    return (
        rows.join(F.broadcast(hot), _same(keys), "left")
        .withColumn(
            SALT,
            F.explode(F.sequence(F.lit(0), F.coalesce(F.col("h_n"), F.lit(1)) - 1)),
        )
        .drop(*[f"h_{k}" for k in keys], "h_n")
    )


def salted_join(
    many: DataFrame, few: DataFrame, keys: list[str], hot: DataFrame | None, spread_by: list, how: str = "inner"
) -> DataFrame:
    """Join in which the rows of `many` that carry a hot key are spread over several tasks.

    The matching rows of `few` are repeated once per salt; nothing is dropped. Without hot keys
    it is a plain join.
    """
    if hot is None:
        return many.join(few, keys, how)
    left = add_salt(many, hot, keys, spread_by)
    return left.join(add_all_salts(few, hot, keys), [*keys, SALT], how).drop(SALT)

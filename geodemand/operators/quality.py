"""Checks on tables: profile, references, uniqueness, bounds, set differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Group of a feature by a part of its name, first match wins.
FEATURE_GROUPS = {
    "crop_": "cropping pattern", "hold_": "land holding", "soil_": "soil", "peer_": "spatial spillover",
    "residue": "residue", "dealer": "distribution",
}


def table_profile(df: DataFrame, skip: list[str] = ()) -> DataFrame:
    """One row per column: group, type, distinct values of text columns; one pass over the table."""
    cols = [(c, t) for c, t in df.dtypes if c not in skip]
    group = lambda c: next((g for p, g in FEATURE_GROUPS.items() if p in c), "derived")
    counts = df.agg(*[
        (F.countDistinct(c) if t == "string" else F.first(F.lit(None)).cast("bigint")).alias(c) for c, t in cols
    ])
    meta = F.create_map(*[x for c, t in cols for x in (F.lit(c), F.struct(F.lit(group(c)).alias("g"), F.lit(t).alias("t")))])
    long = counts.unpivot([], [c for c, _ in cols], "feature", "nunique")
    return long.select("feature", meta[F.col("feature")]["g"].alias("group"), meta[F.col("feature")]["t"].alias("dtype"), "nunique")


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose parent does not exist."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def out_of_bounds(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    return df.where((F.col(column) < lo) | (F.col(column) > hi))


def missing_from(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that b does not have."""
    return a.subtract(b)

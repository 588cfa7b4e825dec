"""Stored roll-ups of every level of a hierarchy, laid out for questions about the children of one node.

Two tables, written once from the finest rows and read by every drill, ranking and share question:

* items: one row per level, node and product;
* nodes: one row per level and node, over all products.

A row's folder is its level and a shard of its parent's id; inside, rows lie by parent. A question about
the children of a node therefore opens one folder, and in it the row groups of that parent. Shards are a
fixed number, so a level with millions of parents has no more folders than one with ten; a parent with
very many children is cut over several files. A level is added up from the level below, so a parent is by
construction the sum of its children.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geodemand.session import parallelism, save_table

SHARDS = 16
ROOT = "all"  # parent of the nodes of the highest level


@dataclass(frozen=True)
class Hierarchy:
    """Levels from the finest up as (name, id column), the measures, and what tells products apart."""

    levels: tuple[tuple[str, str], ...]
    sums: tuple[str, ...]
    item: tuple[str, ...]
    by: str  # the measure that decides the top item
    ratio: str | None = None  # a column whose mean over the finest rows is kept

    def ids(self, at: int) -> list[str]:
        """Id columns of a level and of all above it."""
        return [c for _, c in self.levels[at:]]

    def above(self) -> dict[str, str]:
        """Level over each level but the highest."""
        names = [n for n, _ in self.levels]
        return dict(zip(names, names[1:], strict=False))


def shard_of(parent: str | int) -> int:
    """Folder of a parent's children."""
    return zlib.crc32(str(parent).encode()) % SHARDS


def _shard(parent: Column) -> Column:
    return F.pmod(F.crc32(parent.cast("binary")), F.lit(SHARDS)).cast("int")


def _placed(df: DataFrame, h: Hierarchy, at: int, columns: list) -> DataFrame:
    name, node = h.levels[at]
    parent = F.col(h.levels[at + 1][1]).cast("string") if at + 1 < len(h.levels) else F.lit(ROOT)
    return df.select(
        F.lit(name).alias("level"), _shard(parent).alias("shard"), parent.alias("parent"), F.col(node).cast("string").alias("id"), *h.ids(at), *columns
    )


def _stacked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def laid_out(df: DataFrame, *order: str) -> DataFrame:
    """Dealt by ranges of (level, shard, parent, id), so that files hold whole runs of children and none holds too many."""
    keys = ["level", "shard", "parent", *order]
    return df.repartitionByRange(parallelism(df.sparkSession), *keys).sortWithinPartitions(*keys)


def item_levels(star: DataFrame, h: Hierarchy, finest: bool = True) -> DataFrame:
    """Rows of the items table: sums, number of finest rows, the largest one, and the sum of the ratio.

    `star` has a column for the id of every level, those of the item, the measures and the ratio.
    A row carries the ids of all levels above its node. Without `finest` the lowest level, by far the
    largest, is left out.
    """
    measures = [*h.sums, "n_rows", *(["ratio_sum"] if h.ratio else [])]
    ratio = [F.sum(h.ratio).alias("ratio_sum")] if h.ratio else []
    below = star.groupBy(*h.ids(0), *h.item).agg(*[F.sum(m).alias(m) for m in h.sums], F.count(F.lit(1)).alias("n_rows"), F.max(h.by).alias("largest"), *ratio)
    parts = [_placed(below, h, 0, [*h.item, *measures, "largest"])] if finest else []
    for at in range(1, len(h.levels)):
        below = below.groupBy(*h.ids(at), *h.item).agg(*[F.sum(m).alias(m) for m in measures], F.max("largest").alias("largest"))
        if at == 1:
            below = save_table(below, "level-items")  # the levels above read this, not the finest rows
        parts.append(_placed(below, h, at, [*h.item, *measures, "largest"]))
    return laid_out(_stacked(parts), "id")


def node_levels(star: DataFrame, h: Hierarchy, attributes: DataFrame) -> DataFrame:
    """Rows of the nodes table: sums over all products, top item by the largest finest row, attributes.

    attributes: level, id and whatever a level's nodes are shown with. The largest row of a node
    is the largest of its children's; equal ones go to the first item by name.
    """
    largest = F.min(F.struct((-F.col(h.by)).alias("k"), *h.item)).alias("_top")
    below = star.groupBy(*h.ids(0)).agg(*[F.sum(m).alias(m) for m in h.sums], F.count(F.lit(1)).alias("n_rows"), largest)
    below = below.withColumn("n_finest", F.lit(1).cast("bigint"))
    columns = [*h.sums, "n_rows", "n_finest", *[F.col(f"_top.{c}").alias(f"top_{c}") for c in h.item]]
    parts = [_placed(below, h, 0, columns)]
    for at in range(1, len(h.levels)):
        below = below.groupBy(*h.ids(at)).agg(*[F.sum(m).alias(m) for m in (*h.sums, "n_rows", "n_finest")], F.min("_top").alias("_top"))
        if at == 1:
            below = save_table(below, "level-nodes")
        parts.append(_placed(below, h, at, columns))
    return laid_out(_stacked(parts).join(attributes, ["level", "id"], "left"), "id")


def children(table: DataFrame, level: str, parent: str | int | None = None) -> DataFrame:
    """Nodes of a level, of one parent where it is named: a filter on the folders and on the rows' order."""
    out = table.where(F.col("level") == level)
    if parent is not None:
        out = out.where((F.col("shard") == shard_of(parent)) & (F.col("parent") == str(parent)))
    return out


def node(table: DataFrame, level: str, parent: str | int, id: str | int) -> DataFrame:
    """Rows of one node."""
    return children(table, level, parent).where(F.col("id") == str(id))


def top_item_by_sum(items: DataFrame, by: str, item: list[str]) -> DataFrame:
    """Item with the largest sum in each node; equal sums go to the first item by name."""
    best = F.min(F.struct((-F.col(by)).alias("k"), *item)).alias("_t")
    return items.groupBy("level", "parent", "id").agg(best).select("level", "parent", "id", *[F.col(f"_t.{c}").alias(f"top_{c}") for c in item])


def unreconciled(table: DataFrame, h: Hierarchy, measures: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Nodes whose measures differ from the sum of their children's; no rows where all levels agree."""
    above = F.create_map(*[F.lit(x) for pair in h.above().items() for x in pair])
    kids = table.groupBy(above[F.col("level")].alias("level"), F.col("parent").alias("id")).agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    off = [F.abs(F.col(m) - F.col(f"_{m}")) > tolerance * F.greatest(F.abs(F.col(m)), F.lit(1.0)) for m in measures]
    own = table.groupBy("level", "id").agg(*[F.sum(m).alias(m) for m in measures])
    return own.join(kids, ["level", "id"]).where(reduce(lambda a, b: a | b, off))

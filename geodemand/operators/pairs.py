"""Pairs of rows of one group whose values lie close together, dealt as a triangle of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodemand.session import save_table

BLOCK = 256  # rows of a cell that one block holds, on average

_CELL = ["_group", "_low", "_step", "_below", "_above"]


def _cells(rows: DataFrame, block: int) -> DataFrame:
    """Per group and band: into how many blocks the band, the one below and the one above are dealt."""
    n = rows.groupBy("_group", "_band").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    n = save_table(n, "pair-cells")
    near = n.select("_group", "n", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("to"), "_band")
    at = lambda to: F.coalesce(F.max(F.when(F.col("to") == to, F.col("n"))), F.lit(0))
    return (
        near.withColumn("_band", F.col("_band") + F.col("to")).groupBy("_group", "_band")
        .agg(at(0).alias("_n"), at(-1).alias("_n_above"), at(1).alias("_n_below")).where("_n > 0")
    )


def dealt(rows: DataFrame, group: str, value: str, reach: float, key: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join: `rows` with the blocks they meet in.

    The rows of a cell (group and band of values) are dealt to blocks by a hash of their key. Every
    unordered pair of blocks of a cell, and every block with every block of the band above, is one
    join key. So a group of any size spreads over tasks, no key has more than about two blocks, and
    every two rows meet in exactly one of them.
    """
    width = reach * (1 + 1e-6)
    banded = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull() & F.col(key).isNotNull()).withColumn("_group", F.col(group))
    banded = banded.withColumn("_band", F.floor(F.col(value) / width).cast("bigint"))
    t = banded.join(_cells(banded, block), ["_group", "_band"]).withColumn("_block", F.pmod(F.xxhash64(key), "_n").cast("int"))
    # sequence() counts down where its end is smaller, so empty ranges are cut off.
    up_to = lambda n: F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(1), n)

    def side(step: int, partners, lower: bool):
        """Meetings of the row with `partners` blocks of its own band or the next one."""
        low = F.col("_band") if lower or step == 0 else F.col("_band") - 1
        pair = (lambda c: (F.col("_block"), c)) if lower else (lambda c: (c, F.col("_block")))
        return F.transform(
            partners, lambda c: F.struct(low.alias("_low"), F.lit(step).alias("_step"), pair(c)[0].alias("_below"), pair(c)[1].alias("_above"))
        )

    columns = rows.columns
    within = up_to(F.col("_n"))
    left = F.concat(side(0, F.filter(within, lambda c: c >= F.col("_block")), True), side(1, up_to(F.col("_n_above")), True))
    right = F.concat(side(0, F.filter(within, lambda c: c <= F.col("_block")), False), side(1, up_to(F.col("_n_below")), False))
    made = lambda meetings, mark: t.select("_group", F.explode(meetings).alias("_m"), *[F.col(c).alias(f"{c}_{mark}") for c in columns]).select(
        "_group", "_m.*", *[f"{c}_{mark}" for c in columns]
    )
    return made(left, "a"), made(right, "b")


def close_pairs(rows: DataFrame, group: str, value: str, reach: float, key: str, block: int = BLOCK) -> DataFrame:
    """All pairs of rows of a group whose values differ by `reach` at most, each once, the smaller key first.

    Columns come twice, with _a and _b behind their names. Rows without group, value or key pair
    with nothing; rows with equal keys do not pair with one another.
    """
    a, b = dealt(rows, group, value, reach, key, block)
    j = a.join(b, _CELL).where((F.col(f"{key}_a") != F.col(f"{key}_b")) & (F.abs(F.col(f"{value}_a") - F.col(f"{value}_b")) <= reach))
    # Inside one block both sides hold all rows, so each pair is met twice there.
    j = j.where((F.col("_step") == 1) | (F.col("_below") != F.col("_above")) | (F.col(f"{key}_a") < F.col(f"{key}_b")))
    turned = F.col(f"{key}_a") > F.col(f"{key}_b")
    pick = lambda c, x, y: F.when(turned, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}"))
    return j.select(*[pick(c, "a", "b").alias(f"{c}_a") for c in rows.columns], *[pick(c, "b", "a").alias(f"{c}_b") for c in rows.columns])

"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source starts with the same fractional copy probability. Pairs of fractional
documents hand mass (counted in words) to one another at random until one of them is integral, so
the words a source gives stay at its target while every document keeps its own expectation. The
pairs are settled inside blocks of documents; what stays fractional of a block goes up to the next
level of a reduction tree until one document of a source is left, which is rounded on its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geodemand.llm.common import WORD, columns_only, written
from geodemand.session import parallelism

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK = 64
SEED = 7


def running(df: DataFrame, order: list[Column], sums: list[str], name: str) -> DataFrame:
    """Rank (from 0) and sums of the rows before, in a total order, without one task seeing all rows.

    Rows are dealt by range, numbered inside each range, and shifted by the totals of the ranges
    before. There are as many ranges as shuffle partitions, which bounds the totals.
    """
    spark = df.sparkSession
    dealt = written(df.repartitionByRange(parallelism(spark), *order).withColumn("_pid", F.spark_partition_id()), name)
    before = Window.partitionBy("_pid").orderBy(*order)
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    per_range = dealt.groupBy("_pid").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums]).collect()
    shifts, seen = [], [0] + [0.0] * len(sums)
    for r in sorted(per_range):
        shifts.append((r[0], *seen))
        seen = [a + (b or 0) for a, b in zip(seen, r[1:], strict=True)]
    schema = "_pid int, _n bigint" + "".join(f", _s_{c} double" for c in sums)
    return (
        dealt.join(F.broadcast(spark.createDataFrame(shifts, schema)), "_pid")
        .withColumn("rank", F.row_number().over(before) - 1 + F.col("_n"))
        .withColumns({f"before_{c}": F.coalesce(F.sum(c).over(earlier), F.lit(0.0)) + F.col(f"_s_{c}") for c in sums})
        .select(*df.columns, "rank", *[f"before_{c}" for c in sums])
    )


def source_targets(
    sizes: DataFrame, source: str = "source", size: str = "size", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """Target words of each source: by weight, no source above `most` times its words.

    Raising a common level until the targets fill the budget, a source stops at its cap at the
    level cap / weight. In the order of those levels the right one is where the budget less the
    caps before, over the weights from there on, does not exceed the source's own.
    """
    per = sizes.groupBy(source).agg(F.sum(size).cast("long").alias("source_size"))
    ranked = running(per, [F.col(source).asc_nulls_last()], [], "sources").withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    )
    capped = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("stop", F.col("cap") / F.col("weight"))
    all_words, all_weight = capped.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = float(share) * (all_words or 0)
    levels = running(
        capped.select(source, "source_size", "weight", "cap", "stop"), [F.col("stop"), F.col(source).asc_nulls_last()], ["cap", "weight"], "levels"
    ).withColumn("level", (F.lit(budget) - F.col("before_cap")) / (F.lit(all_weight or 1.0) - F.col("before_weight")))
    found = levels.where(F.col("level") <= F.col("stop")).agg(F.min(F.struct("stop", "level"))).first()[0]
    target = F.col("cap") if found is None else F.least("cap", F.col("weight") * F.lit(found["level"]))
    return levels.select(source, "source_size", target.alias("target"))


def _coin(*keys) -> Column:
    """Number in [0, 1) that depends on the keys only, so reruns and recomputed tasks agree."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) / F.lit(float(1 << 40))


_ITEM = "struct<id:bigint,h:bigint,size:bigint,p:double>"


def _settle(items: Column, seed: int, level: int) -> Column:
    """Fold the documents of a block: `carry` is the one still fractional, `done` the integral ones."""
    start = F.struct(F.lit(None).cast(_ITEM).alias("carry"), F.array().cast(f"array<{_ITEM}>").alias("done"))

    def with_p(item, p):
        return F.struct(item["id"].alias("id"), item["h"].alias("h"), item["size"].alias("size"), p.alias("p"))

    def step(acc, x):
        a = acc["carry"]
        has_a, has_x = a["p"] * a["size"], x["p"] * x["size"]
        up = F.least(a["size"] - has_a, has_x)  # words that can move from x to the carry
        down = F.least(has_a, x["size"] - has_x)
        rise = _coin(F.lit(seed), F.lit(level), a["h"], x["h"]) * (up + down) < down
        moved = F.when(rise, up).otherwise(-down)
        # Which bound was met is known; setting it exactly keeps rounding noise out.
        a_whole = F.when(rise, up == a["size"] - has_a).otherwise(down == has_a)
        a_next = with_p(a, F.when(a_whole, F.when(rise, 1.0).otherwise(0.0)).otherwise((has_a + moved) / a["size"]))
        x_next = with_p(x, F.when(a_whole, (has_x - moved) / x["size"]).otherwise(F.when(rise, 0.0).otherwise(1.0)))
        pair = F.struct(
            F.when(a_whole, x_next).otherwise(a_next).alias("carry"),
            F.concat(acc["done"], F.array(F.when(a_whole, a_next).otherwise(x_next))).alias("done"),
        )
        return F.when(a.isNull(), F.struct(x.alias("carry"), acc["done"].alias("done"))).otherwise(pair)

    return F.aggregate(items, start, step)


def mix(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple = WEIGHTS, share: float = SHARE,
    most: float = MOST, seed: int = SEED, block: int = BLOCK, carry: tuple = (),
) -> DataFrame:
    """One row per row of `docs`: key, `carry` columns, size, source_size, target, copies, taken (= copies x size).

    Null text and texts without words have size 0, take part and give nothing. A null source is a
    source like any other, last in the order. Repeated rows and rows with equal or null keys are
    documents of their own. An empty table gives no rows. Other columns are not looked at. The
    outcome depends on keys, sizes and sources only, not on how the rows are stored, as long as
    keys are unique.
    """
    sizes = columns_only(docs, key, source, text, *carry).select(
        key, *carry, F.col(source).alias("_group"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(key).cast("string")).alias("_h"), F.monotonically_increasing_id().alias("_id"),
    )
    sizes = written(sizes, "sizes")
    targets = source_targets(sizes, "_group", "size", weights, share, most)
    counts = sizes.groupBy("_group").agg(F.count("*").alias("_docs")).withColumnRenamed("_group", "_same")
    targets = written(targets.join(counts, targets["_group"].eqNullSafe(counts["_same"])).drop("_group"), "targets")
    every = (
        sizes.join(targets, sizes["_group"].eqNullSafe(targets["_same"]), "left")
        .withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("_base", F.floor("_rate"))
        .withColumn("_p", F.col("_rate") - F.col("_base"))
    )
    blocks = F.ceil(F.col("_docs") / block)
    live = every.where("size > 0 and _p > 0").select(
        "_group", F.pmod("_h", blocks).alias("_slot"), F.col("_id").alias("id"), F.col("_h").alias("h"), "size", F.col("_p").alias("p")
    )
    most_docs = targets.agg(F.max("_docs")).first()[0] or 0
    level, slots = 0, max(1, -(-most_docs // block))
    outcomes = []
    while True:
        # Long documents are settled first, so what goes up the tree is short.
        sorted_items = F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("o"), "h", "id", "size", "p"))), lambda x: F.struct(x["id"], x["h"], x["size"], x["p"])
        )
        done = written(live.groupBy("_group", "_slot").agg(sorted_items.alias("items")).select("_group", "_slot", _settle("items", seed, level).alias("r")), f"level{level}")
        outcomes.append(done.select(F.explode("r.done").alias("x")).select("x.id", F.col("x.p").cast("long").alias("extra")))
        left = done.where("r.carry is not null").select("_group", "_slot", "r.carry.id", "r.carry.h", "r.carry.size", "r.carry.p")
        if slots == 1:
            last = _coin(F.lit(seed), F.lit(-1), "h") < F.col("p")
            outcomes.append(left.select("id", last.cast("long").alias("extra")))
            break
        level, slots = level + 1, -(-slots // block)
        live = left.withColumn("_slot", F.floor(F.col("_slot") / block))
    settled = reduce(DataFrame.unionAll, outcomes)
    copies = F.col("_base") + F.coalesce("extra", F.lit(0))
    return every.join(settled, every["_id"] == settled["id"], "left").select(
        key, *carry, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed_rows(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """The mix itself: rows of `docs`, each as often as it is taken; documents of size 0 stay once."""
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    copies = mix(rows, key, carry=("_row",), **how).select(
        F.col("_row").alias("_of"), F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("int").alias("_copies")
    )
    return (
        rows.join(copies, rows["_row"] == copies["_of"])
        .withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))))
        .select(*[rows[c] for c in docs.columns])
    )

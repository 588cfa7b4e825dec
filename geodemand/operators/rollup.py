"""Hierarchy rollups, drill-down, ranking inside a node, class breaks, concentration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geodemand.functions.scalars import equals_all, floored_ratio
from geodemand.operators.ranking import top_n


def item_rollup(star: DataFrame, keys: list[str], sums: list[str], means: list[str] = ()) -> DataFrame:
    """Sums of the measures, means where a sum has no meaning, and the number of rows."""
    return star.groupBy(*keys).agg(
        *[F.sum(m).alias(m) for m in sums],
        *[F.avg(m).alias(m) for m in means],
        F.count(F.lit(1)).alias("n_rows"),
    )


def top_item(item: list[str], by: str) -> Column:
    """Item of the single largest row of a group; equal rows go to the first item by name."""
    return F.min_by(F.struct(*item), F.struct((-F.col(by)).alias("k"), *item))


def node_totals(star: DataFrame, node: list[str], sums: list[str], item: list[str], by: str) -> DataFrame:
    """Totals of each node with its top item and the unserved share of the addressable market."""
    g = star.groupBy(*node).agg(*[F.sum(m).alias(m) for m in sums], top_item(item, by).alias("_t"))
    return g.select(
        *node,
        *sums,
        *[F.col(f"_t.{c}").alias(f"top_{c}") for c in item],
        floored_ratio("headroom", "units").alias("attach_gap"),
    )


def level_rollup(star: DataFrame, levels: list[str], sums: list[str]) -> DataFrame:
    """All levels of the hierarchy at once; a parent is by construction the sum of its children.

    The rows are first added up at the finest level, so the expansion into levels works on
    nodes, not on facts.
    """
    fine = star.groupBy(*levels).agg(
        *[F.sum(m).alias(m) for m in sums], F.count(F.lit(1)).alias("n_rows")
    )
    return fine.rollup(*levels).agg(
        F.grouping_id().alias("grouping"),
        *[F.sum(m).alias(m) for m in sums],
        F.sum("n_rows").alias("n_rows"),
    )


def rescoped(nodes: DataFrame, star: DataFrame, node: str, scope: dict, season=None) -> DataFrame:
    """Replace the all-product totals by those of one product or category.

    Nodes without rows in the scope drop out; the top item and the gap stay those of the whole
    node. The product wins where both product and category are given.
    """
    if scope.get("sku_id") is not None:
        scope = {"sku_id": scope["sku_id"]}
    out = nodes
    if any(v is not None for v in scope.values()):
        s = (
            star.where(equals_all(scope))
            .groupBy(node)
            .agg(*[F.sum(m).alias(f"_{m}") for m in ("units", "value", "headroom")])
        )
        out = nodes.join(s, node)
        for m in ("units", "value", "headroom"):
            out = out.withColumn(m, F.col(f"_{m}")).drop(f"_{m}")
    if season is not None:
        out = out.withColumn("units", F.col("units") * season).withColumn("value", F.col("value") * season)
    return out


def season_factor(season: DataFrame, month: int, sku: str | None = None, category: str | None = None) -> Column:
    """Season multiplier of a product, else its category's mean, else the mean of all; 1 if none."""
    s = season.where(F.col("month_of_year") == month)
    if sku is not None:
        s = s.where(F.col("sku_id") == sku)
    elif category is not None:
        s = s.where(F.col("category") == category)
    v = s.agg(F.avg("season_index").alias("v")).scalar()
    return F.when(v.isNull() | (v == 0), F.lit(1.0)).otherwise(v)


def share_of_total(df: DataFrame, measure: str, out: str) -> DataFrame:
    total = df.agg(F.sum(measure).alias("t")).scalar()
    return df.withColumn(out, F.col(measure) / F.nullif(total, F.lit(0.0)))


def concentration(df: DataFrame, node: str, measure: str, n: int = 5) -> DataFrame:
    """Share of the total that the n largest nodes hold."""
    top = df.orderBy(F.desc(measure), node).limit(n)
    total = df.agg(F.sum(measure).alias("t")).scalar()
    return top.agg(F.sum(measure).alias("top_units"), F.count(F.lit(1)).alias("n_nodes")).select(
        "n_nodes", "top_units", (F.col("top_units") / total * 100).alias("top_share_pct")
    )


def over_index(star: DataFrame, segment: Column, item: str, measure: str) -> DataFrame:
    """Share of each item inside a segment over its share everywhere."""
    g = star.groupBy(item).agg(
        F.sum(F.when(segment, F.col(measure))).alias("seg_units"), F.sum(measure).alias("all_units")
    )
    seg_total = g.agg(F.sum("seg_units").alias("t")).scalar()
    all_total = g.agg(F.sum("all_units").alias("t")).scalar()
    return g.where(F.col("seg_units").isNotNull()).select(
        item,
        "seg_units",
        ((F.col("seg_units") / seg_total) / F.nullif(F.col("all_units") / all_total, F.lit(0.0))).alias(
            "index_vs_all"
        ),
    )


def top_values_text(df: DataFrame, by: list[str], value: str, n: int, out: str) -> DataFrame:
    """The n most frequent values of each group as joined text, most frequent first."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    top = top_n(counts, by, [F.desc("_n"), F.col(value)], n)
    return top.groupBy(*by).agg(
        F.concat_ws(
            ", ",
            F.transform(F.array_sort(F.collect_list(F.struct("rn", value))), lambda x: x[value]),
        ).alias(out)
    )


def most_frequent(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Mode of each group; equal counts go to the smaller value."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(
        F.min_by(value, F.struct((-F.col("_n")).alias("k"), F.col(value))).alias(out)
    )


def allocate(df: DataFrame, parent: str, weight: str, target: str, out: str) -> DataFrame:
    """Split each parent's target over its children in proportion to their weights.

    The sum per parent is aggregated and joined back rather than taken in a window, so a parent
    with very many children is never gathered in one task.
    """
    sums = df.groupBy(parent).agg(F.sum(weight).alias("_s"))
    return (
        df.join(sums, parent)
        .withColumn(out, F.col(weight) * F.col(target) / F.nullif(F.col("_s"), F.lit(0.0)))
        .select(*df.columns, out)
    )


# Quantile cuts of a seven-colour map scale.
MAP_CUTS = (0.15, 0.35, 0.55, 0.72, 0.86, 0.95)


def class_breaks(nodes: DataFrame, by: list[str], measure: str, cuts=MAP_CUTS) -> DataFrame:
    """Colour class of each node inside its level.

    Linear from zero with fewer than 8 positive values or a spread under 40 %, else by lower
    quantiles. Nodes without a positive value are class -1.
    """
    from geodemand.operators.ranking import N_BEFORE, N_GROUP, N_TIES, ordered_counts

    n_class = len(cuts) + 1
    t = ordered_counts(nodes.where(F.col(measure) > 0), measure, by)
    stops = [
        F.max(
            F.when(
                (F.col(N_BEFORE) <= at) & (at < F.col(N_BEFORE) + F.col(N_TIES)), F.col(measure)
            )
        )
        for at in [F.least(F.col(N_GROUP) - 1, F.floor(F.lit(p) * F.col(N_GROUP))) for p in cuts]
    ]
    lim = t.groupBy(*by).agg(
        F.min(measure).alias("_lo"),
        F.max(measure).alias("_hi"),
        F.max(N_GROUP).alias("_n"),
        F.array(*stops).alias("_stops"),
    )
    v, hi = F.col(measure), F.col("_hi")
    linear = (F.col("_n") < 8) | ((hi - F.col("_lo")) / hi < 0.4)
    lin = F.least(F.lit(n_class - 1), F.floor(v / hi * n_class).cast("int"))
    quant = F.aggregate("_stops", F.lit(0), lambda a, s: a + F.when(v > s, 1).otherwise(0))
    return (
        nodes.join(lim, by, "left")
        .withColumn("color_class", F.when(v.isNull() | (v <= 0), -1).when(linear, lin).otherwise(quant))
        .drop("_lo", "_hi", "_n", "_stops")
    )


def split_entropy(df: DataFrame, by: list[str], value: str, n_classes: int) -> DataFrame:
    """Shannon entropy of the class shares of each group over ln(n_classes).

    Takes one row per group and class, so the list per group is as long as there are classes.
    """
    sums = df.groupBy(*by).agg(F.collect_list(value).alias("_v"))
    total = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x)
    h = F.aggregate(
        "_v", F.lit(0.0), lambda a, x: a - (x / total) * F.log(x / total + F.lit(1e-12))
    )
    return sums.select(*by, (h / math.log(n_classes)).alias("entropy"))


def gini(shares: list[str], sizes: list[float]) -> Column:
    """Gini of land across ordered size classes from their population shares in one row.

    Trapezoid between the cumulated population and area from the first class on, bounded to
    [0.05, 0.95].
    """
    area = [F.col(s) * F.lit(float(m)) for s, m in zip(shares, sizes)]
    total = sum(area[1:], area[0])
    cum, acc = [], None
    for a in area:
        acc = a / total if acc is None else acc + a / total
        cum.append(acc)
    lost = sum(
        [(cum[i] + cum[i - 1]) * F.col(shares[i]) for i in range(1, len(shares))], F.lit(0.0)
    )
    return F.greatest(F.lit(0.05), F.least(F.lit(0.95), 1 - lost))

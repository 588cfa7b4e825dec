"""What-if questions: other weights, shocks through the estimated slopes, a rival's move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geodemand.config import DISTANCE_SENSITIVITY, FACTORS, PRICE_SENSITIVITY
from geodemand.functions.stats import Z90


def _reweighted(scores: DataFrame, factors: DataFrame, weights_wide: DataFrame, overrides: dict) -> DataFrame:
    """`scores` with _m, by which each row changes under other factor weights."""
    unknown = set(overrides) - set(FACTORS)
    if unknown:
        raise ValueError(f"unknown factors {sorted(unknown)}")
    new = {f: F.lit(float(overrides[f])) if f in overrides else F.col(f"w_{f}") for f in FACTORS}
    pos = sum([F.greatest(v, F.lit(0.0)) for v in list(new.values())[1:]], F.greatest(new[FACTORS[0]], F.lit(0.0)))
    w = weights_wide.withColumn("_pos", F.when(pos == 0, 1.0).otherwise(pos))
    w = w.withColumns({f"n_{f}": v / F.col("_pos") for f, v in new.items()}).drop("_pos")
    s = scores.join(factors.select("place_id", *FACTORS), "place_id").join(w, "sku_id")
    dot = lambda p: sum([F.col(f) / 100 * F.col(f"{p}_{f}") for f in FACTORS[1:]], F.col(FACTORS[0]) / 100 * F.col(f"{p}_{FACTORS[0]}"))
    s = s.withColumn("_old", dot("w")).withColumn("_new", dot("n"))
    return s.withColumn("_m", F.when(F.col("_old") > 1e-9, F.col("_new") / F.col("_old")).otherwise(1.0))


def reweight(scores: DataFrame, factors: DataFrame, weights_wide: DataFrame, overrides: dict, level: str) -> DataFrame:
    """Demand under other factor weights, by node.

    The new weights are divided by the sum of their positives; a row changes by the ratio of its
    new to its old weighted index, and stays where the old one is nil.
    """
    m = F.col("_m")
    g = _reweighted(scores, factors, weights_wide, overrides).groupBy(level).agg(
        F.sum("potential_units_yr").alias("units_base"), F.sum(F.col("potential_units_yr") * m).alias("units_scenario"),
        F.sum("potential_value").alias("value_base"), F.sum(F.col("potential_value") * m).alias("value_scenario"),
    )
    return _deltas(g)


def _deltas(g: DataFrame) -> DataFrame:
    g = g.withColumn("delta_units", F.col("units_scenario") - F.col("units_base"))
    return g.withColumn(
        "delta_pct", F.when(F.col("units_base") > 0, F.col("delta_units") / F.col("units_base") * 100).otherwise(0.0)
    )


def _effects(base: DataFrame, betas: DataFrame, shocks: dict, group: str) -> DataFrame:
    """`base` (one row per group) with dlog, the change in logs, and var, the square of its standard error."""
    b = betas.where(F.col("regressor").isin(*shocks))
    missing = set(shocks) - {r[0] for r in b.select("regressor").distinct().collect()}  # at most the names asked for
    if missing:
        raise ValueError(f"no slopes for {sorted(missing)}")
    known = F.create_map(*[x for r, v in shocks.items() for x in (F.lit(r), F.lit(float(v)))])
    mean = b.groupBy("regressor").agg(F.avg("beta").alias("mb"), F.avg("se").alias("ms"))
    grid = base.select(group, F.explode(F.array(*[F.lit(r) for r in shocks])).alias("regressor"))
    e = grid.join(b.select(group, "regressor", "beta", "se"), [group, "regressor"], "left").join(mean, "regressor")
    sd = known[F.col("regressor")]
    beta, se = F.coalesce("beta", "mb"), F.coalesce("se", "ms")
    e = e.groupBy(group).agg(F.sum(beta * sd).alias("dlog"), F.sum(F.pow(se * sd, F.lit(2.0))).alias("var"))
    return base.join(e, group)


def _banded(g: DataFrame, group: str, parents: DataFrame | None, level: str | None) -> DataFrame:
    """Scenario and bounds from units, value, dlog and var of each group, added up to the level."""
    band = Z90 * F.sqrt("var")
    g = (
        g.withColumn("units_scenario", F.col("units") * F.exp("dlog"))
        .withColumn("value_scenario", F.col("value") * F.exp("dlog"))
        .withColumn("units_lo", F.col("units_scenario") * F.exp(-band))
        .withColumn("units_hi", F.col("units_scenario") * F.exp(band))
        .drop("units", "value")
    )
    if level is not None and level != group:
        sums = ("units_base", "units_scenario", "units_lo", "units_hi", "value_base", "value_scenario")
        g = g.join(parents, group).groupBy(level).agg(*[F.sum(c).alias(c) for c in sums])
    pct = lambda c: F.when(F.col("units_base") > 0, (F.col(c) / F.col("units_base") - 1) * 100).otherwise(0.0)
    return _deltas(g).withColumn("delta_pct_lo", pct("units_lo")).withColumn("delta_pct_hi", pct("units_hi"))


def shock(scores: DataFrame, betas: DataFrame, shocks: dict, group: str, parents: DataFrame | None = None, level: str | None = None) -> DataFrame:
    """Demand after shocks in standard deviations, with the 90 % band of the slopes.

    Every group answers with its own slopes; a group without one takes the mean of all. The
    facts are added up per group before anything is multiplied. Bounds of nodes above the group
    are sums of the bounds below.
    """
    base = scores.groupBy(group).agg(F.sum("potential_units_yr").alias("units_base"), F.sum("potential_value").alias("value_base"))
    g = _effects(base, betas, shocks, group).withColumn("units", F.col("units_base")).withColumn("value", F.col("value_base"))
    return _banded(g, group, parents, level)


def combined(
    scores: DataFrame, factors: DataFrame, weights_wide: DataFrame, betas: DataFrame, parents: DataFrame, group: str, weights: dict | None = None,
    shocks: dict | None = None, scope: Column | None = None, within: Column | None = None, level: str | None = None,
) -> DataFrame:
    """Other weights and shocks at once, by node, for the rows in `scope` of the groups in `within`.

    `scope` is a condition on the scores (a product, a category), `within` one on `parents` (a state).
    Weights act on each row; what they make of it is added up per group, and the group's slopes act on
    the sum, so the scored rows are passed once and never shuffled unaggregated. Without weights rows
    stay, without shocks the band is nil. Groups with no row in scope are left out; where none has
    one the result is empty.
    """
    s = scores if scope is None else scores.where(scope)
    if within is not None:
        s = s.join(parents.where(within).select(group), group, "left_semi")
    s = _reweighted(s, factors, weights_wide, weights) if weights else s.withColumn("_m", F.lit(1.0))
    base = s.groupBy(group).agg(
        F.sum("potential_units_yr").alias("units_base"), F.sum("potential_value").alias("value_base"),
        F.sum(F.col("potential_units_yr") * F.col("_m")).alias("units"), F.sum(F.col("potential_value") * F.col("_m")).alias("value"),
    )
    nil = {"dlog": F.lit(0.0), "var": F.lit(0.0)}
    return _banded(_effects(base, betas, shocks, group) if shocks else base.withColumns(nil), group, parents, level)


def rival_move(contests: DataFrame, rival: str, reach_km, price_change_pct: float, dealer_change_pct: float) -> DataFrame:
    """Own units by category after one rival changes price or network, against that rival only."""
    du = PRICE_SENSITIVITY * (price_change_pct / 100.0) + DISTANCE_SENSITIVITY * (-reach_km * dealer_change_pct / 100.0)
    c = contests.where(F.col("closest_rival") == rival)
    own, riv = F.col("own_share"), F.col("rival_share")
    new = own * (own + riv) / F.greatest(own + riv * F.exp(F.lit(du)), F.lit(1e-12))
    after = F.col("own_units") * (1 + (new - own) / F.greatest(own, F.lit(1e-12)))
    g = c.groupBy("category").agg(
        F.sum("own_units").alias("before"), F.sum(after).alias("after"), F.count(F.lit(1)).alias("contests")
    )
    return g.withColumn("delta", F.col("after") - F.col("before")).withColumn(
        "delta_pct", F.col("delta") / F.greatest("before", F.lit(1e-9)) * 100
    )

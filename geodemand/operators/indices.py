"""Composite indices, factor weights, season, scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geodemand.config import (
    ANNUAL_CONVERSION, FACTORS, HEADWIND_DEFAULT, WEIGHT_MAX, WEIGHT_MIN,
)
from geodemand.functions.scalars import clip, coefficient, floored_ratio
from geodemand.operators.ranking import scope_ranks
from geodemand.session import spread


def subfactor_table(spec: dict, have: list[str]) -> list[tuple[str, str, float, bool]]:
    """(factor, feature, weight share, flip) of the sub-factors whose feature exists."""
    out = []
    for factor, subs in spec.items():
        used = [s for s in subs if s[0] in have]
        if not used:
            raise ValueError(f"{factor} has no usable sub-factor")
        total = sum(w for _, w, _ in used)
        out += [(factor, f, w / total, d == "negative") for f, w, d in used]
    return out


def factor_index(features: DataFrame, key: str, state: str, spec: dict) -> DataFrame:
    """Factor indices 0-100, once over all places and once inside the state.

    All sub-factor ranks of both scopes come from a single ranking pass over the long form, whose short
    rows (place, metric, two ranks) are shuffled back to their place before the weighted sums widen them.
    """
    table = subfactor_table(spec, features.columns)
    used = sorted({f for _, f, _, _ in table})
    r = scope_ranks(features.select(key, state, *used), key, used, {"all": None, "state": state})

    def index(factor: str, pct: str) -> Column:
        part = {}
        for _, g, w, flip in [t for t in table if t[0] == factor]:
            part.setdefault(g, []).append((100 - F.col(pct) if flip else F.col(pct)) * float(w))
        return F.sum(F.coalesce(*[F.when(F.col("metric") == g, sum(c[1:], c[0])) for g, c in part.items()]))

    sums = [index(f, pct).alias(f"{f}{tag}") for f in spec for pct, tag in (("pct_all", ""), ("pct_state", "_state"))]
    return spread(r, key).groupBy(key).agg(*sums)


def factor_definitions(spark, spec: dict, have: list[str]) -> DataFrame:
    t = subfactor_table(spec, have)
    rows = [(f, ", ".join(g for h, g, _, _ in t if h == f), sum(1 for h, *_ in t if h == f)) for f in spec]
    return spark.createDataFrame(rows, "factor string, subfactors_used string, n_subfactors int")


def resolve_weights(
    products: DataFrame, prior: dict, by_category: dict, by_product: dict, betas: DataFrame | None,
    factor_of: dict,
) -> DataFrame:
    """Weight and origin of every factor for every product.

    Default, then category, then product priors; the factors the panel speaks for share their
    joint prior mass by their estimated importance; bounded; positives scaled to one, penalties
    kept as they are.
    """
    def flat(m: dict, name: str) -> Column:
        pairs = [x for k, v in m.items() for f, w in v.items() for x in (F.lit(f"{k}|{f}"), F.lit(float(w)))]
        return F.create_map(*pairs)[F.concat_ws("|", name, "factor")] if pairs else F.lit(None).cast("double")

    base = F.create_map(*[x for f, w in prior.items() for x in (F.lit(f), F.lit(float(w)))])
    names = F.explode(F.array(*[F.lit(f) for f in prior])).alias("factor")
    w = products.select("sku_id", "category", names)
    w = w.withColumn(
        "prior",
        F.coalesce(
            flat(by_product, "sku_id"),
            flat(by_category, "category"),
            base[F.col("factor")],
        ),
    )
    if betas is not None:
        fac = F.create_map(*[F.lit(x) for kv in factor_of.items() for x in kv])
        imp = betas.groupBy(fac[F.col("regressor")].alias("factor")).agg(F.sum(F.abs("beta_shrunk")).alias("imp"))
        w = w.join(imp, "factor", "left")
    else:
        w = w.withColumn("imp", F.lit(None).cast("double"))
    # One product has one row per factor, so these groups are as small as the factor list.
    covered = F.col("imp").isNotNull()
    g = w.groupBy("sku_id").agg(
        F.sum(F.when(covered, F.greatest("prior", F.lit(0.0)))).alias("_mass"), F.sum("imp").alias("_imp")
    )
    w = w.join(g, "sku_id")
    on = covered & (F.col("_mass") > 0) & (F.col("_imp") > 0)
    w = w.withColumn("_w", clip(F.when(on, F.col("_mass") * F.col("imp") / F.col("_imp")).otherwise(F.col("prior")), WEIGHT_MIN, WEIGHT_MAX))
    pos = w.groupBy("sku_id").agg(F.sum(F.when(F.col("_w") > 0, F.col("_w"))).alias("_pos"))
    return w.join(pos, "sku_id").select(
        "sku_id",
        "category",
        "factor",
        F.when((F.col("_w") > 0) & (F.col("_pos") > 0), F.col("_w") / F.col("_pos")).otherwise(F.col("_w")).alias("weight"),
        F.when(on, "ucm").otherwise("prior").alias("origin"),
    )


def weights_wide(weights: DataFrame, factors: list[str] = FACTORS) -> DataFrame:
    return weights.groupBy("sku_id").agg(
        *[F.max(F.when(F.col("factor") == f, F.col("weight"))).alias(f"w_{f}") for f in factors]
    )


def season_index(decomposition: DataFrame, products: DataFrame, month: str, seasonal: str) -> DataFrame:
    """Product season: estimated month effect times the product's own window, mean 1 over the year.

    `products` carries a `season` array of peak months.
    """
    g = decomposition.groupBy(F.month(month).alias("month_of_year")).agg(F.avg(seasonal).alias("s"))
    mean = g.agg(F.avg("s").alias("m")).scalar()
    gamma = g.select("month_of_year", F.exp(F.col("s") - mean).alias("gamma"))
    months = F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month_of_year")
    p = products.select("sku_id", "category", "season", months)
    p = p.withColumn("_w", F.when(F.array_contains("season", F.col("month_of_year")), 1.0).otherwise(0.3))
    p = p.join(gamma, "month_of_year", "inner")
    mean_w = p.groupBy("sku_id").agg(F.avg("_w").alias("_mw"), F.avg(F.col("_w") * F.col("gamma")).alias("_mb"))
    p = p.join(mean_w, "sku_id")
    return p.select(
        "sku_id",
        "category",
        "month_of_year",
        (F.col("_w") * F.col("gamma") / F.col("_mb")).alias("season_index"),
        (F.col("_w") / F.col("_mw")).alias("prior_index"),
        "gamma",
    )


def headwind(shares: DataFrame, group: list[str], player: str, share: str, own: str, incumbency: dict) -> DataFrame:
    """How contested a category is: grows with incumbency and the lead of the strongest rival."""
    g = shares.groupBy(*group).agg(
        F.max(F.when(F.col(player) == own, F.col(share))).alias("own_share"),
        F.max(F.when(F.col(player) != own, F.col(share))).alias("leader_share"),
    )
    inc = coefficient("category", incumbency, 0.0)
    lead = clip(F.col("leader_share") / (F.col("own_share") + 1e-9), 0, 4)
    return g.where(F.col("own_share").isNotNull() & F.col("leader_share").isNotNull()).withColumn(
        "headwind", clip(1 - 0.55 * inc * lead / 4, 0.25, 1.0)
    )


def soil_fit(hardness: str, draft: str, affinity: dict | None) -> Column:
    """Fit to the soil: from the declared affinity, else from the draft requirement."""
    if affinity is not None:
        return 0.5 + 0.5 * coefficient(hardness, affinity, 0.6)
    return clip(0.85 + 0.15 * (2.0 - F.col(draft)), 0.7, 1.15)


def band_overlap(lo: Column, hi: Column, bands: list[tuple[float, float]], self_propelled: Column) -> list[Column]:
    """Share of each power band inside [lo, hi]; all of it for self-propelled machines."""
    return [
        F.when(self_propelled, 1.0).otherwise(
            F.greatest(F.lit(0.0), F.least(hi, F.lit(float(b1))) - F.greatest(lo, F.lit(float(b0)))) / (b1 - b0)
        )
        for b0, b1 in bands
    ]


def market_state(df: DataFrame, addressable: Column, owned: Column, life_years: float) -> DataFrame:
    """Owned bounded by the market, penetration, headroom and yearly replacement."""
    d = df.withColumn("addressable", addressable).withColumn("owned", F.least(owned, F.col("addressable") * 0.95))
    return d.withColumn(
        "penetration", F.when(F.col("addressable") > 1e-9, F.col("owned") / F.col("addressable")).otherwise(0.0)
    ).withColumn("headroom", F.greatest(F.col("addressable") - F.col("owned"), F.lit(0.0))).withColumn(
        "replacement_units_yr", F.col("owned") / life_years
    )


def propensities(state: DataFrame, headwinds: DataFrame, soil: Column, carry=()) -> DataFrame:
    """Propensity, new and replacement demand of every place and product.

    `state` is place x product and already carries what belongs to the place (factors, conversion, whatever
    `soil` reads) and to the product (price, weights); what is joined here belongs to districts, so rows
    of the size places x products are never shuffled.
    """
    s = state.join(headwinds.select("district_id", "category", "headwind"), ["district_id", "category"], "left")
    dot = sum([F.col(f) / 100 * F.col(f"w_{f}") for f in FACTORS[1:]], F.col(FACTORS[0]) / 100 * F.col(f"w_{FACTORS[0]}"))
    hw = F.coalesce("headwind", F.lit(HEADWIND_DEFAULT))
    return s.select(
        "place_id", "district_id", "sku_id", "category", "price", "addressable", "owned", "headroom", "penetration", "replacement_units_yr",
        soil.alias("soil_fit"),
        hw.alias("compete_headwind"),
        "conversion",
        F.greatest(F.lit(0.0), dot * soil * hw).alias("propensity"),
        (F.col("headroom") * ANNUAL_CONVERSION * F.col("conversion")).alias("new_units_yr"),
        *carry,
    )


def potentials(propensities: DataFrame, mean: DataFrame) -> DataFrame:
    """Potential and its value: demand by propensity over the product's mean (sku_id, _mean), a small stored table."""
    pot = (F.col("new_units_yr") + F.col("replacement_units_yr")) * floored_ratio("propensity", "_mean")
    return (
        propensities.join(mean, "sku_id")
        .withColumn("potential_units_yr", pot)
        .withColumn("potential_value", F.col("potential_units_yr") * F.col("price"))
        .drop("_mean", "price")
    )


def driver_waterfall(factors: DataFrame, weights: DataFrame, place_id, sku_id: str) -> DataFrame:
    """Contribution of each factor to one place x product score, largest first."""
    ids = [f for f in FACTORS]
    f = factors.where(F.col("place_id") == place_id)
    idx = f.unpivot("place_id", ids, "factor", "index")
    st = f.unpivot("place_id", [f"{i}_state" for i in ids], "factor", "index_state_scope").withColumn(
        "factor", F.regexp_replace("factor", "_state$", "")
    )
    w = weights.where(F.col("sku_id") == sku_id)
    return (
        idx.join(st, ["place_id", "factor"])
        .join(w, "factor")
        .select(
            "place_id", "sku_id", "factor", "index", "index_state_scope", "weight",
            (F.col("index") / 100 * F.col("weight")).alias("contribution"), "origin",
        )
        .orderBy(F.desc(F.abs("contribution")), "factor")
    )

"""Ranks, factor indices, weights, market state and propensity scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from geodemand import config as C
from geodemand.functions.scalars import clip, coefficient, steady_round
from geodemand.operators import indices as I
from geodemand.operators import panel as P
from geodemand.operators import ranking as RK
from geodemand.operators.levels import children
from geodemand.plans import levels as LV
from geodemand.plans import place_role as PR
from geodemand.plans.panel_role import REGRESSORS, panel
from geodemand.plans.registry import cte, query
from geodemand.session import save_table, spread, stage
from geodemand.sources import roles


def sql_pct(v: str, part: str = "") -> str:
    """Average-tie percentile rank 0-100 in SQL."""
    p = f"PARTITION BY {part} " if part else ""
    pv = f"{part}, {v}" if part else v
    return (
        f"((rank() OVER ({p}ORDER BY {v}) + (count(*) OVER (PARTITION BY {pv}) - 1) / 2e0)"
        f" / count({v}) OVER ({p.strip()}) * 100)"
    )


@query(
    "pct_rank_global",
    f"SELECT place_id, round({sql_pct('acctbal')}, 6) AS pct, round(100 - {sql_pct('acctbal')}, 6) AS pct_inverted FROM place",
    needs=("place",),
)
def pct_rank_global(spark, sf):
    p = roles.places(spark, sf).select("place_id", "acctbal")
    e = RK.pct_of_group() * 100
    r = RK.ranked(p, "acctbal", [], "place_id", pct=e, pct_inverted=100 - e)
    return r.select("place_id", F.round("pct", 6).alias("pct"), F.round("pct_inverted", 6).alias("pct_inverted"))


@query(
    "pct_rank_by_region",
    f"SELECT place_id, state_id, round({sql_pct('tractors', 'state_id')}, 6) AS pct FROM feature",
    needs=("feature",),
)
def pct_rank_by_region(spark, sf):
    f = PR.features(spark, sf).select("place_id", "state_id", "tractors")
    return RK.pct_rank(f, "tractors", "place_id", ["state_id"]).select("place_id", "state_id", F.round("pct", 6).alias("pct"))


@query(
    "rank_desc_trunc",
    """SELECT place_id, district_id, CAST(floor(rank() OVER (PARTITION BY district_id ORDER BY tractors DESC)
         + (count(*) OVER (PARTITION BY district_id, tractors) - 1) / 2e0) AS BIGINT) AS rank_in_district,
         count(*) OVER (PARTITION BY district_id) AS places_in_district FROM feature""",
    needs=("feature",),
)
def rank_desc_trunc(spark, sf):
    f = PR.features(spark, sf).select("place_id", "district_id", "tractors")
    return RK.ranked(
        f, "tractors", ["district_id"], "place_id",
        rank_in_district=RK.descending_rank(), places_in_district=F.col(RK.N_GROUP),
    ).select("place_id", "district_id", "rank_in_district", "places_in_district")


@query(
    "zscore_vs_peers",
    """SELECT place_id, segment, round(coalesce((attach_rate - avg(attach_rate) OVER w)
          / nullif(stddev_samp(attach_rate) OVER w, 0), 0), 6) AS attach_z,
        round(coalesce((income_per_ha - avg(income_per_ha) OVER w) / nullif(stddev_samp(income_per_ha) OVER w, 0), 0), 6) AS income_z,
        round((attach_rate - avg(attach_rate) OVER ()) / nullif(stddev_pop(attach_rate) OVER (), 0), 6) AS attach_z_all
       FROM feature WINDOW w AS (PARTITION BY segment)""",
    needs=("feature",),
)
def zscore_vs_peers(spark, sf):
    f = PR.features(spark, sf).select("place_id", "segment", "attach_rate", "income_per_ha")
    s = f.agg(F.struct(F.avg("attach_rate").alias("m"), F.stddev_pop("attach_rate").alias("s")).alias("s")).scalar()
    z = RK.zscores(f, ["attach_rate", "income_per_ha"], ["segment"])
    return z.select(
        "place_id", "segment", F.round("attach_rate_z", 6).alias("attach_z"), F.round("income_per_ha_z", 6).alias("income_z"),
        F.round((F.col("attach_rate") - s["m"]) / F.nullif(s["s"], F.lit(0.0)), 6).alias("attach_z_all"),
    )


SCALED = ["attach_rate", "income_per_ha", "dealer_distance_km", "avg_holding_ha"]


@query(
    "robust_scale",
    ", q AS (SELECT " + ", ".join(
        f"quantile_cont({m}, 0.5) AS m_{m}, quantile_cont({m}, 0.75) - quantile_cont({m}, 0.25) AS i_{m}" for m in SCALED
    ) + " FROM feature) SELECT place_id, " + ", ".join(
        f"round(greatest(-5e0, least(5e0, ({m} - m_{m}) / CASE WHEN i_{m} < 1e-9 THEN 1 ELSE i_{m} END)), 6) AS {m}_z" for m in SCALED
    ) + " FROM feature, q",
    needs=("feature",),
)
def robust_scale(spark, sf):
    z = RK.robust_scale(PR.features(spark, sf), "place_id", SCALED)
    return z.select("place_id", *[F.round(f"{m}_z", 6).alias(f"{m}_z") for m in SCALED])


# ---------------------------------------------------------------- derived drivers and factors

cte(
    "latest12",
    """SELECT district_id, avg(x1) AS wage, avg(x2) AS rain FROM panel
       WHERE month IN (SELECT DISTINCT month FROM panel ORDER BY month DESC LIMIT 12) GROUP BY 1""",
    "panel",
)
cte(
    "driver1",
    """SELECT f.*, round(rain, 8) AS rainfall_departure, round(wage, 8) AS wage,
        (SELECT quantile_cont(income_per_ha, 0.5) FROM feature) AS inc50, (SELECT quantile_cont(income_per_ha, 0.9) FROM feature) AS inc90
       FROM feature f LEFT JOIN latest12 USING (district_id)""",
    "feature", "latest12",
)
cte(
    "driver",
    f"""SELECT * EXCLUDE (prog), round(prog + 3e-11, 8) AS progressive_farmer,
          round(least(1e0, greatest(0e0, 0.3e0 + 0.45e0 * market_access + 0.25e0 * prog)) + 3e-11, 8) AS digital_access,
          round(least(1e0, greatest(0e0, 0.45e0 * prog + 0.35e0 * high_value_share + 0.2e0 * dealer_accessibility)) + 3e-11, 8) AS precision_adoption
        FROM (SELECT *, round({sql_pct('wage')} / 100 * 0.6e0 + (1 - small_marginal_share) * 0.4e0 + 3e-11, 8) AS labour_scarcity,
          round(least(1e0, greatest(0e0, 0.35e0 + 0.45e0 * (1 - irrigation_reliability) - 0.2e0 * income_per_ha / inc50)) + 3e-11, 8) AS outmigration,
          round(least(1.2e0, greatest(0e0, 0.25e0 + 0.5e0 * market_access + 0.3e0 * high_value_share)) + 3e-11, 8) AS fpo_density,
          least(1e0, greatest(0e0, 0.5e0 * least(1e0, greatest(0e0, avg_holding_ha / 5)) + 0.5e0 * least(1e0, greatest(0e0, income_per_ha / inc90)))) AS prog
        FROM driver1)""",
    "driver1",
)


def _build_drivers(spark, sf):
    f = PR.features(spark, sf)
    latest = P.latest_periods_mean(panel(spark, sf), "district_id", "month", ["x1", "x2"]).select(
        "district_id", F.round("x1", 8).alias("wage"), F.round("x2", 8).alias("rainfall_departure")
    )
    f = f.join(latest, "district_id", "left")
    f = RK.pct_rank(f, "wage", "place_id", out="_wage_pct")
    q = RK.quantiles(f, "income_per_ha", [], {"q50": 0.5, "q90": 0.9}).select(F.struct("q50", "q90").alias("q")).scalar()
    c = F.col
    prog = clip(0.5 * clip(c("avg_holding_ha") / 5, 0, 1) + 0.5 * clip(c("income_per_ha") / q["q90"], 0, 1), 0, 1)
    f = f.withColumn("_prog", prog)
    new = {
        "labour_scarcity": c("_wage_pct") / 100 * 0.6 + (1 - c("small_marginal_share")) * 0.4,
        "outmigration": clip(0.35 + 0.45 * (1 - c("irrigation_reliability")) - 0.20 * c("income_per_ha") / q["q50"], 0, 1),
        "fpo_density": clip(0.25 + 0.5 * c("market_access") + 0.3 * c("high_value_share"), 0, 1.2),
        "progressive_farmer": c("_prog"),
        "digital_access": clip(0.30 + 0.45 * c("market_access") + 0.25 * c("_prog"), 0, 1),
        "precision_adoption": clip(0.45 * c("_prog") + 0.35 * c("high_value_share") + 0.20 * c("dealer_accessibility"), 0, 1),
    }
    return f.withColumns({k: steady_round(v, 8) for k, v in new.items()}).drop("_prog", "_wage_pct")


def drivers(spark, sf):
    return stage(spark, "drivers", roles.paths(sf, *PR.INPUTS), lambda: _build_drivers(spark, sf))


_HAVE = PR.NUMERIC + ["rainfall_departure", "labour_scarcity", "outmigration", "fpo_density", "progressive_farmer", "digital_access", "precision_adoption"]
_TABLE = I.subfactor_table(C.SUBFACTORS, _HAVE)


def _factor_sql() -> str:
    used = sorted({f for _, f, _, _ in _TABLE})
    inner = ", ".join(f"{sql_pct(m)} AS n_{m}, {sql_pct(m, 'state_id')} AS s_{m}" for m in used)
    cols = []
    for f in C.FACTORS:
        for tag, name in (("n", f), ("s", f"{f}_state")):
            terms = [
                f"{w!r}e0 * " + (f"(100 - {tag}_{g})" if flip else f"{tag}_{g}") for h, g, w, flip in _TABLE if h == f
            ]
            cols.append(f"{' + '.join(terms)} AS {name}")
    return f"SELECT place_id, {', '.join(cols)} FROM (SELECT place_id, {inner} FROM driver)"


cte("factor", _factor_sql(), "driver")


def factors(spark, sf):
    return stage(
        spark, "factors", roles.paths(sf, *PR.INPUTS),
        lambda: I.factor_index(drivers(spark, sf), "place_id", "state_id", C.SUBFACTORS),
    )


@query(
    "factor_index",
    "SELECT place_id, " + ", ".join(f"round({f}, 6) AS {f}, round({f}_state, 6) AS {f}_state" for f in C.FACTORS) + " FROM factor",
    needs=("factor",),
)
def factor_index(spark, sf):
    f = factors(spark, sf)
    return f.select("place_id", *[F.round(c, 6).alias(c) for x in C.FACTORS for c in (x, f"{x}_state")])


# ---------------------------------------------------------------- slopes and weights

cte(
    "fwl",
    """SELECT district_id, regressor, count(*) AS n, sum(xd * yd) / sum(xd * xd) AS beta,
         sqrt((sum(yd * yd) - sum(xd * yd) * sum(xd * yd) / sum(xd * xd)) / (count(*) - 13) / sum(xd * xd)) AS se
       FROM (SELECT district_id, regressor, ly - avg(ly) OVER w AS yd, x - avg(x) OVER w AS xd
         FROM (SELECT district_id, month(month) AS m, ln(y) AS ly, regressor, x
               FROM (SELECT district_id, month, y, x1, x2, x3, x4 FROM panel) UNPIVOT (x FOR regressor IN (x1, x2, x3, x4)))
         WINDOW w AS (PARTITION BY district_id, regressor, m)) GROUP BY 1, 2""",
    "panel",
)
cte(
    "betas",
    """SELECT *, CASE regressor WHEN 'x4' THEN 'negative' ELSE 'positive' END AS expected_sign,
         CASE WHEN se > 0 THEN beta / se END AS tstat, beta - 1.645e0 * se AS ci_low, beta + 1.645e0 * se AS ci_high,
         coalesce(abs(beta / se) > 1.645e0, false) AS significant,
         (beta > 0) = (regressor <> 'x4') AS sign_ok,
         coalesce(abs(beta / se) > 1.645e0, false) AND ((beta > 0) = (regressor <> 'x4')) AS usable
       FROM fwl""",
    "fwl",
)


def betas(spark, sf):
    e = P.elasticities(panel(spark, sf), "district_id", "month", "y", REGRESSORS)
    return P.audit(e, C.REGRESSOR_SIGN)


@query(
    "group_elasticity",
    """SELECT district_id, regressor, n, round(beta, 6) AS beta, round(se, 6) AS se, round(tstat, 6) AS tstat,
         round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, expected_sign, significant, sign_ok, usable FROM betas""",
    needs=("betas",),
)
def group_elasticity(spark, sf):
    b = betas(spark, sf)
    r = [F.round(c, 6).alias(c) for c in ("beta", "se", "tstat", "ci_low", "ci_high")]
    return b.select("district_id", "regressor", "n", *r, "expected_sign", "significant", "sign_ok", "usable")


cte(
    "shrunk",
    """SELECT b.*, pm, pv, pv / (pv + 6 * se * se + 1e-12) AS shrink_weight,
         pv / (pv + 6 * se * se + 1e-12) * beta + (1 - pv / (pv + 6 * se * se + 1e-12)) * pm AS beta_shrunk
       FROM betas b JOIN (SELECT regressor, avg(beta) AS pm, coalesce(var_samp(beta), 0) AS pv FROM betas WHERE usable GROUP BY 1) p
       USING (regressor) WHERE usable""",
    "betas",
)


@query(
    "beta_shrinkage",
    """SELECT district_id, regressor, round(pm, 6) AS pool_mean, round(pv, 6) AS pool_var,
         round(shrink_weight, 6) AS shrink_weight, round(beta_shrunk, 6) AS beta_shrunk FROM shrunk""",
    needs=("shrunk",),
)
def beta_shrinkage(spark, sf):
    s = P.shrink(betas(spark, sf))
    return s.select(
        "district_id", "regressor", *[F.round(c, 6).alias(c) for c in ("pool_mean", "pool_var", "shrink_weight", "beta_shrunk")]
    )


@query(
    "elasticity_pool",
    """SELECT regressor, expected_sign, round(avg(beta), 6) AS beta, round(avg(ci_low), 6) AS ci_low, round(avg(ci_high), 6) AS ci_high,
         round(avg(CASE WHEN significant THEN 1e0 ELSE 0e0 END), 6) AS sig_share, round(avg(CASE WHEN sign_ok THEN 1e0 ELSE 0e0 END), 6) AS sign_ok_share,
         round(avg(CASE WHEN usable THEN 1e0 ELSE 0e0 END), 6) AS usable_share, count(*) AS n_groups FROM betas GROUP BY 1, 2""",
    needs=("betas",),
)
def elasticity_pool(spark, sf):
    p = P.pooled(betas(spark, sf))
    return p.select("regressor", "expected_sign", *[
        F.round(c, 6).alias(c) for c in ("beta", "ci_low", "ci_high", "sig_share", "sign_ok_share", "usable_share")
    ], "n_groups")


def _prior_case() -> str:
    lines = []
    for sku, w in C.PRIOR_BY_PRODUCT.items():
        lines += [f"WHEN sku_id = '{sku}' AND fac.factor = '{f}' THEN {v}e0" for f, v in w.items()]
    for cat, w in C.PRIOR_BY_CATEGORY.items():
        lines += [f"WHEN category = '{cat}' AND fac.factor = '{f}' THEN {v}e0" for f, v in w.items()]
    lines += [f"WHEN fac.factor = '{f}' THEN {v}e0" for f, v in C.PRIOR.items()]
    return "CASE " + " ".join(lines) + " END"


cte(
    "weight",
    f"""SELECT sku_id, category, factor, CASE WHEN w > 0 AND pos > 0 THEN w / pos ELSE w END AS weight, origin FROM (
         SELECT *, sum(CASE WHEN w > 0 THEN w END) OVER (PARTITION BY sku_id) AS pos FROM (
           SELECT *, least(0.45e0, greatest(-0.25e0, CASE WHEN imp IS NOT NULL AND mass > 0 AND total > 0 THEN mass * imp / total ELSE prior END)) AS w,
             CASE WHEN imp IS NOT NULL AND mass > 0 AND total > 0 THEN 'ucm' ELSE 'prior' END AS origin FROM (
             SELECT *, sum(CASE WHEN imp IS NOT NULL THEN greatest(prior, 0) END) OVER (PARTITION BY sku_id) AS mass,
               sum(imp) OVER (PARTITION BY sku_id) AS total FROM (
               SELECT sku_id, category, fac.factor, {_prior_case()} AS prior, imp
               FROM (SELECT sku_id, category, unnest({C.FACTORS!r}) AS factor FROM product) fac
               LEFT JOIN (SELECT CASE regressor WHEN 'x2' THEN 'F7' WHEN 'x3' THEN 'F4' ELSE 'F1' END AS factor,
                    sum(abs(beta_shrunk)) AS imp FROM shrunk GROUP BY 1) i ON i.factor = fac.factor))))""",
    "product", "shrunk",
)


def weights(spark, sf):
    return stage(
        spark, "weights", roles.paths(sf, *PR.INPUTS),
        lambda: I.resolve_weights(
            roles.products(spark, sf), C.PRIOR, C.PRIOR_BY_CATEGORY, C.PRIOR_BY_PRODUCT,
            P.shrink(betas(spark, sf)), C.REGRESSOR_FACTOR,
        ),
    )


@query(
    "resolved_weights",
    "SELECT sku_id, category, factor, round(weight, 8) AS weight, origin FROM weight",
    needs=("weight",),
)
def resolved_weights(spark, sf):
    return weights(spark, sf).select("sku_id", "category", "factor", F.round("weight", 8).alias("weight"), "origin")


# ---------------------------------------------------------------- headwind, state, scores

cte(
    "player_units",
    """SELECT district_id, category, player, u / sum(u) OVER (PARTITION BY district_id, category) AS share
       FROM (SELECT district_id, category, player, sum(units) AS u FROM star GROUP BY 1, 2, 3)""",
    "star",
)


def _inc_case() -> str:
    return "CASE category " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in C.INCUMBENCY.items()) + " ELSE 0e0 END"


cte(
    "headwind",
    f"""SELECT district_id, category, own_share, leader_share,
         least(1e0, greatest(0.25e0, 1 - 0.55e0 * {_inc_case()} * least(4e0, greatest(0e0, leader_share / (own_share + 1e-9))) / 4)) AS headwind
       FROM (SELECT district_id, category, max(CASE WHEN player = '{C.OWN_PLAYER}' THEN share END) AS own_share,
              max(CASE WHEN player <> '{C.OWN_PLAYER}' THEN share END) AS leader_share FROM player_units GROUP BY 1, 2)
       WHERE own_share IS NOT NULL AND leader_share IS NOT NULL""",
    "player_units",
)


def player_units(spark, sf):
    """Share of each player in a district's category."""
    g = children(LV.items_above(spark, sf), "district").groupBy("district_id", "category", "player").agg(F.sum("units").alias("u"))
    t = g.groupBy("district_id", "category").agg(F.sum("u").alias("t"))
    return g.join(t, ["district_id", "category"]).select("district_id", "category", "player", (F.col("u") / F.col("t")).alias("share"))


def headwinds(spark, sf):
    return stage(spark, "headwinds", roles.paths(sf, *PR.INPUTS), lambda: _build_headwinds(spark, sf))


def _build_headwinds(spark, sf):
    return I.headwind(player_units(spark, sf), ["district_id", "category"], "player", "share", C.OWN_PLAYER, C.INCUMBENCY)


@query(
    "headwind",
    """SELECT district_id, category, round(own_share, 6) AS own_share, round(leader_share, 6) AS leader_share,
         round(headwind, 6) AS headwind FROM headwind""",
    needs=("headwind",),
)
def headwind(spark, sf):
    h = headwinds(spark, sf)
    return h.select("district_id", "category", *[F.round(c, 6).alias(c) for c in ("own_share", "leader_share", "headwind")])


def _map_case(m: dict) -> str:
    return "CASE p.category " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in m.items()) + " END"


_OVER = ", ".join(
    f"CASE WHEN p.category = 'SMALL' THEN 1e0 ELSE greatest(0e0, least(lo + 20, {b1}e0) - greatest(lo, {b0}e0)) / {b1 - b0}e0 END AS o{i}"
    for i, (b0, b1) in enumerate(C.POWER_BANDS, 1)
)

cte(
    "state",
    f"""SELECT place_id, district_id, sku_id, category, fleet_in_band, size_fit, crop_fit, gate, addressable, owned,
         CASE WHEN addressable > 1e-9 THEN owned / addressable ELSE 0e0 END AS penetration,
         greatest(addressable - owned, 0e0) AS headroom, owned / 10e0 AS replacement_units_yr FROM (
        SELECT *, least(addressable * adoption * maturity * least(1e0, greatest(0.45e0, 1 - rental * chc_density / 0.12e0 * 0.35e0)),
                   addressable * 0.95e0) AS owned FROM (
        SELECT *, fleet_in_band * size_fit * crop_fit * 0.5e0 * gate AS addressable FROM (
        SELECT f.place_id, f.district_id, p.sku_id, p.category, adoption, chc_density, {_map_case(C.MATURITY)} AS maturity, {_map_case(C.RENTAL)} AS rental,
          tractors * h_b1 * o1 + tractors * h_b2 * o2 + tractors * h_b3 * o3 + tractors * h_b4 * o4 AS fleet_in_band,
          h_b1 * b1 + h_b2 * b2 + h_b3 * b3 + h_b4 * b4 AS size_fit,
          CASE p.category WHEN 'ECONOMY' THEN c_ECONOMY WHEN 'LARGE' THEN c_LARGE WHEN 'MEDIUM' THEN c_MEDIUM
            WHEN 'PROMO' THEN c_PROMO WHEN 'SMALL' THEN c_SMALL ELSE c_STANDARD END AS crop_fit,
          CASE p.category WHEN 'MEDIUM' THEN least(1.2e0, greatest(0e0, irrigation_ratio / 0.55e0))
            WHEN 'PROMO' THEN least(1.3e0, greatest(0e0, least(1.5e0, greatest(0e0, residue_t / greatest((SELECT quantile_cont(residue_t, 0.9) FROM feature), 1e-6)))))
            ELSE 1e0 END AS gate
        FROM feature f CROSS JOIN (SELECT p.*, {_OVER} FROM (SELECT *, CAST(20 + (CAST(regexp_extract(player, '[0-9]+') AS INT) % 6) * 5 AS DOUBLE) AS lo FROM product) p) p)))""",
    "feature", "product",
)


def _catalogue(spark, sf):
    """Products of the modelled categories, with what a row of place x product reads of its product."""
    lo = (20 + (F.regexp_extract("player", "[0-9]+", 0).cast("int") % 6) * 5).cast("double")
    p = roles.products(spark, sf).where(F.col("category").isin(*roles.TYPES)).withColumn("_lo", lo)
    over = I.band_overlap(F.col("_lo"), F.col("_lo") + 20, C.POWER_BANDS, F.col("category").isin(*C.SELF_PROPELLED))
    gate = F.when(F.col("category").isin(*C.NEEDS_IRRIGATION), 1).when(F.col("category").isin(*C.NEEDS_RESIDUE), 2).otherwise(0)
    return p.select(
        "sku_id", "category", "b1", "b2", "b3", "b4", *[o.alias(f"o{i}") for i, o in enumerate(over, 1)], gate.alias("_gated"),
        F.array_position(F.array(*[F.lit(x) for x in roles.TYPES]), F.col("category")).cast("int").alias("_type"),
        coefficient("category", C.MATURITY, 0.0).alias("_maturity"), coefficient("category", C.RENTAL, 0.0).alias("_rental"), F.lit(1).alias("_one"),
    )


def _residue_q90(spark, sf):
    build = lambda: RK.quantiles(PR.features(spark, sf), "residue_t", [], {"q": 0.9})
    return stage(spark, "residue_q90", roles.paths(sf, *PR.INPUTS), build).first()["q"]


def state(spark, sf, places=None, products=None, carry=()):
    """Market of every place for every product.

    The catalogue is small and is put beside every place, and the rows stay with their place: what is added up
    per place later needs no shuffle of the pairs. Places with a category, one row each, meet its products
    only. Columns named in `carry` ride along, from the places or the products.
    """
    f = PR.features(spark, sf) if places is None else places
    c = F.col
    q90 = F.lit(_residue_q90(spark, sf))
    f = f.withColumns({
        "_irrigated": clip(c("irrigation_ratio") / 0.55, 0, 1.2),
        "_residue": clip(clip(c("residue_t") / F.greatest(q90, F.lit(1e-6)), 0, 1.5), 0, 1.3),
        **{f"_t{i}": c("tractors") * c(f"h_b{i}") for i in (1, 2, 3, 4)},
    })
    key = "category" if "category" in f.columns else "_one"
    f = f.withColumn("_one", F.lit(1)) if key == "_one" else f
    p = save_table(_catalogue(spark, sf), "catalogue") if products is None else products
    s = spread(f, "place_id").join(p.drop("_one") if key == "category" else p, key)
    shares = F.when(c("_type") == 1, c(f"c_{roles.TYPES[0]}"))
    for i, name in enumerate(roles.TYPES[1:], 2):
        shares = shares.when(c("_type") == i, c(f"c_{name}"))
    s = s.withColumns({
        "fleet_in_band": sum([c(f"_t{i}") * c(f"o{i}") for i in (2, 3, 4)], c("_t1") * c("o1")),
        "size_fit": sum([c(f"h_b{i}") * c(f"b{i}") for i in (2, 3, 4)], c("h_b1") * c("b1")),
        "crop_fit": shares,
        "gate": F.when(c("_gated") == 1, c("_irrigated")).when(c("_gated") == 2, c("_residue")).otherwise(1.0),
    })
    a = c("fleet_in_band") * c("size_fit") * c("crop_fit") * C.ATTACH_CEILING * c("gate")
    absorb = clip(1 - c("_rental") * c("chc_density") / 0.12 * 0.35, 0.45, 1.0)
    s = I.market_state(s, a, c("addressable") * c("adoption") * c("_maturity") * absorb, C.LIFE_YEARS)
    return s.select(
        "place_id", "district_id", "sku_id", "category", "fleet_in_band", "size_fit", "crop_fit", "gate", "addressable", "owned",
        "penetration", "headroom", "replacement_units_yr", *carry,
    )


_STATE_COLS = ["fleet_in_band", "size_fit", "crop_fit", "gate", "addressable", "owned", "penetration", "headroom", "replacement_units_yr"]


@query(
    "addressable_state",
    "SELECT place_id, sku_id, " + ", ".join(f"round({c} + 3e-11, 6) AS {c}" for c in _STATE_COLS) + " FROM state",
    needs=("state",),
)
def addressable_state(spark, sf):
    return state(spark, sf).select("place_id", "sku_id", *[steady_round(c, 6).alias(c) for c in _STATE_COLS])


_DOT = " + ".join(f"{f} / 100 * w_{f}" for f in C.FACTORS)

cte(
    "weight_wide",
    "SELECT sku_id, " + ", ".join(f"max(CASE WHEN factor = '{f}' THEN weight END) AS w_{f}" for f in C.FACTORS) + " FROM weight GROUP BY 1",
    "weight",
)
cte(
    "score",
    f"""SELECT *, (new_units_yr + replacement_units_yr) * propensity / greatest(avg(propensity) OVER (PARTITION BY sku_id), 1e-9) AS potential_units_yr,
         (new_units_yr + replacement_units_yr) * propensity / greatest(avg(propensity) OVER (PARTITION BY sku_id), 1e-9) * price AS potential_value
       FROM (SELECT *, greatest(0e0, ({_DOT}) * soil_fit * compete_headwind) AS propensity, headroom * 0.09e0 * conversion AS new_units_yr
       FROM (SELECT s.*, fa.* EXCLUDE (place_id), w.* EXCLUDE (sku_id), p.price, coalesce(h.headwind, 0.75e0) AS compete_headwind,
          f.approval_rate * (0.55e0 + 0.45e0 * f.dealer_accessibility) AS conversion,
          CASE WHEN s.category = 'LARGE' THEN 0.5e0 + 0.5e0 * CASE f.soil_texture WHEN 'clay' THEN 1e0 WHEN 'loam' THEN 0.7e0 ELSE 0.6e0 END
            ELSE least(1.15e0, greatest(0.7e0, 0.85e0 + 0.15e0 * (2 - f.draft_requirement))) END AS soil_fit
        FROM state s JOIN factor fa USING (place_id) JOIN weight_wide w USING (sku_id) JOIN product p USING (sku_id) JOIN feature f USING (place_id)
        LEFT JOIN headwind h ON h.district_id = s.district_id AND h.category = s.category))""",
    "state", "factor", "weight_wide", "product", "feature", "headwind",
)


def _scored_places(spark, sf):
    """Places with all that their scores read, one row each."""
    hardness = F.when(F.col("soil_texture") == "clay", "hard").when(F.col("soil_texture") == "loam", "medium").otherwise("soft")
    p = PR.features(spark, sf).withColumn("hardness", hardness).join(factors(spark, sf).select("place_id", *C.FACTORS), "place_id")
    return p.withColumns({
        "_soil_large": I.soil_fit("hardness", "draft_requirement", C.SOIL_AFFINITY["LARGE"]),
        "_soil_other": I.soil_fit("hardness", "draft_requirement", None),
        "conversion": F.col("approval_rate") * (0.55 + 0.45 * F.col("dealer_accessibility")),
    }).drop("hardness")


def scored_places(spark, sf):
    return stage(spark, "scored_places", roles.paths(sf, *PR.INPUTS), lambda: _scored_places(spark, sf), bucket_by="place_id")


def _weighted_catalogue(spark, sf):
    """The catalogue with each product's price and weights."""
    build = lambda: _catalogue(spark, sf).join(I.weights_wide(weights(spark, sf)), "sku_id").join(roles.products(spark, sf).select("sku_id", "price"), "sku_id")
    return stage(spark, "weighted_catalogue", roles.paths(sf, *PR.INPUTS), build)


def _propensities(spark, sf, places=None, carry=()):
    f = scored_places(spark, sf) if places is None else places
    read = ["_soil_large", "_soil_other", "conversion", *C.FACTORS, "price", *[f"w_{x}" for x in C.FACTORS]]
    soil = F.when(F.col("category") == "LARGE", F.col("_soil_large")).otherwise(F.col("_soil_other"))
    return I.propensities(state(spark, sf, f, _weighted_catalogue(spark, sf), [*read, *carry]), headwinds(spark, sf), soil, carry)


def mean_propensity(spark, sf):
    """Mean propensity of each product over all places."""
    build = lambda: _propensities(spark, sf).groupBy("sku_id").agg(F.avg("propensity").alias("_mean"))
    return stage(spark, "mean_propensity", roles.paths(sf, *PR.INPUTS), build)


def scores(spark, sf, places=None, carry=()):
    """Scored place x product rows: what every later question about demand reads.

    Only what belongs to places and products, and the means of the products, is stored. The rows follow from
    these without a shuffle and are worked out by each question, which reads far less than the pairs would take.
    `places` may be the scored places with more columns, of which those in `carry` ride along.
    """
    return I.potentials(_propensities(spark, sf, places, carry), mean_propensity(spark, sf))


_SCORE_COLS = ["soil_fit", "compete_headwind", "conversion", "propensity", "new_units_yr", "potential_units_yr", "potential_value"]


@query(
    "propensity_scores",
    "SELECT place_id, sku_id, " + ", ".join(f"round({c} + 3e-11, 5) AS {c}" for c in _SCORE_COLS) + " FROM score",
    needs=("score",),
)
def propensity_scores(spark, sf):
    return scores(spark, sf).select("place_id", "sku_id", *[steady_round(c, 5).alias(c) for c in _SCORE_COLS])


@query(
    "propensity_rank_in_product",
    f"SELECT place_id, sku_id, round({sql_pct('p', 'sku_id')}, 5) AS propensity_score FROM (SELECT place_id, sku_id, round(propensity, 9) AS p FROM score)",
    needs=("score",),
)
def propensity_rank_in_product(spark, sf):
    # Three narrow columns, read three times by the ranking, are written rather than worked out each time.
    s = save_table(scores(spark, sf).select("place_id", "sku_id", F.round("propensity", 9).alias("p")), "propensities")
    return RK.pct_rank(s, "p", "place_id", ["sku_id"], "pct").select("place_id", "sku_id", F.round("pct", 5).alias("propensity_score"))


@query(
    "driver_waterfall",
    """, f AS (SELECT * FROM factor WHERE place_id = 11), w AS (SELECT * FROM weight WHERE sku_id = 'Brand#1:PROMO'),
       i AS (SELECT factor, idx FROM (SELECT F1,F2,F3,F4,F5,F6,F7,F8,F9,F10 FROM f) UNPIVOT (idx FOR factor IN (F1,F2,F3,F4,F5,F6,F7,F8,F9,F10))),
       s AS (SELECT replace(factor, '_state', '') AS factor, st FROM (SELECT """
    + ", ".join(f"{x}_state" for x in C.FACTORS)
    + " FROM f) UNPIVOT (st FOR factor IN ("
    + ", ".join(f"{x}_state" for x in C.FACTORS)
    + """)))
      SELECT CAST(11 AS BIGINT) AS place_id, w.sku_id, w.factor, round(idx, 4) AS "index", round(st, 4) AS index_state_scope,
        round(weight, 8) AS weight, round(idx / 100 * weight + 3e-11, 6) AS contribution, origin
      FROM w JOIN i USING (factor) JOIN s USING (factor)""",
    needs=("factor", "weight"),
)
def driver_waterfall(spark, sf):
    d = I.driver_waterfall(factors(spark, sf), weights(spark, sf), 11, "Brand#1:PROMO")
    return d.select(
        "place_id", "sku_id", "factor", F.round("index", 4).alias("index"), F.round("index_state_scope", 4).alias("index_state_scope"),
        F.round("weight", 8).alias("weight"), steady_round("contribution", 6).alias("contribution"), "origin",
    )

"""Place features: the stage table behind indices, insights and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from geodemand.config import DECAY_KM, KM_LAT, KM_LON, LIFE_YEARS, MAX_DEALER_KM, TIER_SCORE
from geodemand.functions.scalars import clip, coefficient, dominant, dot, steady_round
from geodemand.operators.rollup import gini
from geodemand.operators.spatial import nearest, neighbour_mean
from geodemand.plans.registry import cte
from geodemand.session import stage
from geodemand.sources import roles

INPUTS = ("customer", "nation", "supplier", "orders", "lineitem", "part")
MIDDLES = [0.5, 1.5, 3.0, 7.0]

cte(
    "dealer",
    """SELECT p.place_id, least(65e0, coalesce(min(sqrt((p.lon * 95e0 - f.lon * 95e0) * (p.lon * 95e0 - f.lon * 95e0)
         + (p.lat * 111e0 - f.lat * 111e0) * (p.lat * 111e0 - f.lat * 111e0))), 65e0)) AS dealer_distance_km
       FROM place p LEFT JOIN facility f ON p.state_id = f.state_id GROUP BY 1""",
    "place",
    "facility",
)


def dealer_distance(spark, sf):
    p = roles.places(spark, sf).select("place_id", "state_id", "lon", "lat")
    f = roles.facilities(spark, sf).select("facility_id", "state_id", "lon", "lat")
    return nearest(p, "place_id", f, "facility_id", ["state_id"], MAX_DEALER_KM)


_SHARES = {
    "c_ECONOMY": "category = 'ECONOMY'", "c_LARGE": "category = 'LARGE'", "c_MEDIUM": "category = 'MEDIUM'",
    "c_PROMO": "category = 'PROMO'", "c_SMALL": "category = 'SMALL'", "c_STANDARD": "category = 'STANDARD'",
    "h_b1": "band = 'b1'", "h_b2": "band = 'b2'", "h_b3": "band = 'b3'", "h_b4": "band = 'b4'",
}

_BASE_SQL = """SELECT m.place_id, sum(units) AS addressable, sum(returned) AS owned,
       CAST(sum(lines) AS BIGINT) AS n_lines, """ + ", ".join(
    f"sum(CASE WHEN {c} THEN units ELSE 0e0 END) / sum(units) AS {n}" for n, c in _SHARES.items()
) + " FROM mix m GROUP BY 1"

cte("place_mix", _BASE_SQL, "mix")
cte(
    "place_orders",
    """SELECT o_custkey AS place_id, count(*) AS n_orders,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100e0 AS spend FROM orders GROUP BY 1""",
)
cte("block_centre", "SELECT block_id, avg(lon) AS blon, avg(lat) AS blat FROM place GROUP BY 1", "place")
cte(
    "bought",
    "SELECT place_id, " + ", ".join(f"coalesce({x}, 0) AS {x}" for x in ("addressable", "owned", "n_lines", *_SHARES)) + " FROM place LEFT JOIN place_mix USING (place_id)",
    "place", "place_mix",
)
cte(
    "ordered",
    "SELECT place_id, CAST(coalesce(n_orders, 0) AS DOUBLE) AS tractors, coalesce(spend, 0) AS spend FROM place LEFT JOIN place_orders USING (place_id)",
    "place", "place_orders",
)
cte(
    "feat1",
    """SELECT p.*, m.addressable, m.owned, m.addressable - m.owned AS headroom, m.n_lines, o.spend,
       o.tractors, d.dealer_distance_km,
       c_ECONOMY, c_LARGE, c_MEDIUM, c_PROMO, c_SMALL, c_STANDARD, h_b1, h_b2, h_b3, h_b4,
       m.addressable / 10e0 AS net_sown_ha,
       h_b1 * 0.5e0 + h_b2 * 1.5e0 + h_b3 * 3e0 + h_b4 * 7e0 AS avg_holding_ha,
       c_ECONOMY + c_STANDARD AS irrigation_ratio, c_PROMO + c_LARGE AS high_value_share,
       h_b1 + h_b2 AS small_marginal_share, h_b3 + h_b4 AS large_holding_share,
       CASE p.place_id % 3 WHEN 0 THEN 'sandy' WHEN 1 THEN 'loam' ELSE 'clay' END AS soil_texture,
       CAST(30 + p.place_id % 150 AS DOUBLE) AS depth_cm, CAST(p.place_id % 28 AS DOUBLE) AS slope_pct,
       sqrt((p.lon * 95e0 - blon * 95e0) * (p.lon * 95e0 - blon * 95e0)
          + (p.lat * 111e0 - blat * 111e0) * (p.lat * 111e0 - blat * 111e0)) AS km_to_block
     FROM place p JOIN bought m USING (place_id) JOIN ordered o USING (place_id)
       JOIN dealer d USING (place_id) JOIN block_centre USING (block_id)""",
    "place", "bought", "ordered", "dealer", "block_centre",
)
cte(
    "feat2",
    """SELECT *, least(2.6e0, greatest(1e0, 1 + 0.95e0 * irrigation_ratio)) AS cropping_intensity,
       irrigation_ratio * least(1e0, greatest(0e0, 0.45e0 + 0.55e0 * irrigation_ratio)) AS irrigation_reliability,
       CASE WHEN net_sown_ha > 0 THEN tractors / net_sown_ha * 1000 ELSE 0 END AS tractor_density, 30 + 5 * avg_holding_ha AS mean_hp,
       least(1e0, greatest(0.25e0, depth_cm / 120)) AS depth_score, least(1e0, greatest(0.3e0, 1 - slope_pct / 30)) AS slope_score,
       exp(-dealer_distance_km / 18e0) AS dealer_accessibility,
       least(1e0, greatest(0e0, 1 / (1 + km_to_block / 12e0))) AS market_access,
       spend / greatest(net_sown_ha, 1e-6) AS income_per_ha,
       least(0.95e0, greatest(0.05e0, 0.3e0 + acctbal / 20000)) AS kcc,
       owned / greatest(tractors, 1e-6) AS attach_rate, owned / greatest(addressable, 1e-6) AS penetration,
       (owned / 10e0) / greatest(tractors, 1e-6) AS replacement_pressure,
       CASE WHEN addressable > 0 THEN n_lines / addressable ELSE 0 END AS chc_density,
       -(c_ECONOMY * ln(c_ECONOMY + 1e-12) + c_LARGE * ln(c_LARGE + 1e-12) + c_MEDIUM * ln(c_MEDIUM + 1e-12)
         + c_PROMO * ln(c_PROMO + 1e-12) + c_SMALL * ln(c_SMALL + 1e-12) + c_STANDARD * ln(c_STANDARD + 1e-12)) / ln(6) AS crop_entropy,
       h_b1 * 0.5e0 AS a1, h_b2 * 1.5e0 AS a2, h_b3 * 3e0 AS a3, h_b4 * 7e0 AS a4,
       CASE state_id WHEN 0 THEN 1e0 WHEN 1 THEN 0.6e0 WHEN 2 THEN 0.28e0 WHEN 3 THEN 0.6e0 ELSE 0.28e0 END AS tier,
       CASE greatest(c_ECONOMY, c_LARGE, c_MEDIUM, c_PROMO, c_SMALL, c_STANDARD)
         WHEN c_ECONOMY THEN 'ECONOMY' WHEN c_LARGE THEN 'LARGE' WHEN c_MEDIUM THEN 'MEDIUM' WHEN c_PROMO THEN 'PROMO'
         WHEN c_SMALL THEN 'SMALL' ELSE 'STANDARD' END AS dominant_crop
     FROM feat1""",
    "feat1",
)
cte(
    "feat3",
    """SELECT *, net_sown_ha * cropping_intensity AS gross_cropped_ha,
       CASE soil_texture WHEN 'sandy' THEN 0.85e0 WHEN 'loam' THEN 1e0 ELSE 0.62e0 END * depth_score * slope_score AS workability,
       least(1.6e0, greatest(0.2e0, CASE soil_texture WHEN 'sandy' THEN 0.45e0 WHEN 'loam' THEN 0.65e0 ELSE 1e0 END
         * (1 + 0.4e0 * (1 - depth_score)) * (1 + 0.3e0 * (1 - slope_score)))) AS draft_requirement,
       tractors * mean_hp * 0.746e0 / greatest(net_sown_ha, 1e-6) AS tractor_power,
       least(1.4e0, greatest(0e0, kcc * (0.55e0 + 0.45e0 * least(1.5e0, greatest(0e0, avg_holding_ha / 4))))) AS credit_depth,
       CASE WHEN avg_holding_ha <= 0 THEN 0.05e0 ELSE greatest(0.05e0, least(0.95e0, 1 - ((a1 / (a1+a2+a3+a4) + (a1+a2) / (a1+a2+a3+a4)) * h_b2
         + ((a1+a2) / (a1+a2+a3+a4) + (a1+a2+a3) / (a1+a2+a3+a4)) * h_b3
         + ((a1+a2+a3) / (a1+a2+a3+a4) + (a1+a2+a3+a4) / (a1+a2+a3+a4)) * h_b4))) END AS holding_gini,
       least(1.5e0, greatest(0e0, dealer_accessibility * 1.9e0)) AS service_density
     FROM feat2""",
    "feat2",
)
cte(
    "feat4",
    """SELECT *, gross_cropped_ha * (c_SMALL * 5.5e0 + c_MEDIUM * 3.6e0 + c_PROMO * 2e0) AS residue_t,
       tractor_power + irrigation_ratio * 2.05e0 + tractor_power * 0.14e0
         + least(0.42e0, greatest(0.04e0, 0.42e0 - 0.16e0 * tractor_power))
         + least(0.18e0, greatest(0.05e0, 0.1e0 + 0.05e0 * small_marginal_share)) AS farm_power_kw_ha,
       least(0.95e0, greatest(0.15e0, 0.61e0 + 0.34e0 * (credit_depth - 0.5e0) + 0.08e0)) AS approval_rate,
       least(0.98e0, greatest(0.02e0, 0.28e0 * tier + 0.3e0 * dealer_accessibility + 0.22e0 * least(1e0, greatest(0e0, credit_depth))
         + 0.2e0 * least(1e0, greatest(0e0, avg_holding_ha / 5)))) AS adoption
     FROM feat3""",
    "feat3",
)

NUMERIC = [
    "addressable", "owned", "headroom", "tractors", "dealer_distance_km", "net_sown_ha", "avg_holding_ha",
    "irrigation_ratio", "high_value_share", "small_marginal_share", "large_holding_share", "cropping_intensity",
    "irrigation_reliability", "tractor_density", "mean_hp", "dealer_accessibility", "market_access", "income_per_ha",
    "attach_rate", "penetration", "replacement_pressure", "chc_density", "crop_entropy", "gross_cropped_ha",
    "workability", "draft_requirement", "credit_depth", "holding_gini", "service_density", "residue_t",
    "farm_power_kw_ha", "approval_rate", "adoption", "residue_per_ha",
    "c_ECONOMY", "c_LARGE", "c_MEDIUM", "c_PROMO", "c_SMALL", "c_STANDARD", "h_b1", "h_b2", "h_b3", "h_b4",
]
IDS = ["place_id", "place", "block_id", "district_id", "state_id", "segment", "lon", "lat", "soil_texture", "dominant_crop"]

cte(
    "feature",
    "SELECT " + ", ".join(IDS) + ", "
    + ", ".join(f"round({c} + 3e-11, 8) AS {c}" for c in NUMERIC if c != "residue_per_ha")
    + ", round(residue_t / greatest(gross_cropped_ha, 1e-6) + 3e-11, 8) AS residue_per_ha FROM feat4",
    "feat4",
)


def soil_workability(texture: str, depth: str, slope: str):
    """(workability, draft requirement) of a soil from texture, depth and slope."""
    depth_score = clip(F.col(depth) / 120, 0.25, 1.0)
    slope_score = clip(1 - F.col(slope) / 30, 0.3, 1.0)
    work = coefficient(texture, {"sandy": 0.85, "loam": 1.0, "clay": 0.62}, 0.62) * depth_score * slope_score
    draft = coefficient(texture, {"sandy": 0.45, "loam": 0.65, "clay": 1.0}, 1.0)
    return work, clip(draft * (1 + 0.4 * (1 - depth_score)) * (1 + 0.3 * (1 - slope_score)), 0.2, 1.6)


def farm_power(tractor_power: str, irrigation: str, small_share: str):
    """Total farm power per hectare: tractors, pumps, self-propelled, draught and human."""
    t = F.col(tractor_power)
    return (
        t + F.col(irrigation) * 2.05 + t * 0.14 + clip(0.42 - 0.16 * t, 0.04, 0.42)
        + clip(0.10 + 0.05 * F.col(small_share), 0.05, 0.18)
    )


def _build(spark, sf):
    m = roles.mix(spark, sf)
    shares = [
        (F.sum(F.when(F.expr(c), F.col("units")).otherwise(0.0)) / F.sum("units")).alias(n) for n, c in _SHARES.items()
    ]
    mix = m.groupBy("place_id").agg(
        F.sum("units").alias("addressable"), F.sum("returned").alias("owned"), F.sum("lines").alias("n_lines"), *shares
    )
    orders = roles.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("place_id")).agg(
        F.count(F.lit(1)).cast("double").alias("tractors"),
        (F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).cast("double") / 100.0).alias("spend"),
    )
    p = roles.places(spark, sf)
    centre = p.groupBy("block_id").agg(F.avg("lon").alias("blon"), F.avg("lat").alias("blat"))
    km = dealer_distance(spark, sf).select("place_id", F.col("near_km").alias("dealer_distance_km"))
    # A place that bought nothing keeps its row, with zeros.
    f = p.join(mix, "place_id", "left").join(orders, "place_id", "left").join(km, "place_id", "left").join(centre, "block_id")
    f = f.fillna(0, ["addressable", "owned", "n_lines", "tractors", "spend", *_SHARES]).fillna({"dealer_distance_km": MAX_DEALER_KM})

    c = F.col
    f = f.withColumns({
        "headroom": c("addressable") - c("owned"),
        "net_sown_ha": c("addressable") / 10.0,
        "avg_holding_ha": dot(["h_b1", "h_b2", "h_b3", "h_b4"], MIDDLES),
        "irrigation_ratio": c("c_ECONOMY") + c("c_STANDARD"),
        "high_value_share": c("c_PROMO") + c("c_LARGE"),
        "small_marginal_share": c("h_b1") + c("h_b2"),
        "large_holding_share": c("h_b3") + c("h_b4"),
        "soil_texture": F.when(c("place_id") % 3 == 0, "sandy").when(c("place_id") % 3 == 1, "loam").otherwise("clay"),
        "depth_cm": (30 + c("place_id") % 150).cast("double"),
        "slope_pct": (c("place_id") % 28).cast("double"),
        "km_to_block": F.sqrt(
            (c("lon") * KM_LON - c("blon") * KM_LON) * (c("lon") * KM_LON - c("blon") * KM_LON)
            + (c("lat") * KM_LAT - c("blat") * KM_LAT) * (c("lat") * KM_LAT - c("blat") * KM_LAT)
        ),
        "tier": coefficient("state_id", TIER_SCORE, 0.28),
        "kcc": clip(0.3 + c("acctbal") / 20000, 0.05, 0.95),
    })
    work, draft = soil_workability("soil_texture", "depth_cm", "slope_pct")
    f = f.withColumns({
        "cropping_intensity": clip(1 + 0.95 * c("irrigation_ratio"), 1.0, 2.6),
        "irrigation_reliability": c("irrigation_ratio") * clip(0.45 + 0.55 * c("irrigation_ratio"), 0, 1),
        "tractor_density": F.when(c("net_sown_ha") > 0, c("tractors") / c("net_sown_ha") * 1000).otherwise(0.0),
        "mean_hp": 30 + 5 * c("avg_holding_ha"),
        "workability": work,
        "draft_requirement": draft,
        "dealer_accessibility": F.exp(-c("dealer_distance_km") / DECAY_KM),
        "market_access": clip(1 / (1 + c("km_to_block") / 12.0), 0, 1),
        "income_per_ha": c("spend") / F.greatest(c("net_sown_ha"), F.lit(1e-6)),
        "attach_rate": c("owned") / F.greatest(c("tractors"), F.lit(1e-6)),
        "penetration": c("owned") / F.greatest(c("addressable"), F.lit(1e-6)),
        "replacement_pressure": (c("owned") / LIFE_YEARS) / F.greatest(c("tractors"), F.lit(1e-6)),
        "chc_density": F.when(c("addressable") > 0, c("n_lines") / c("addressable")).otherwise(0.0),
        "crop_entropy": -sum([c(f"c_{t}") * F.log(c(f"c_{t}") + 1e-12) for t in roles.TYPES[1:]],
                             c(f"c_{roles.TYPES[0]}") * F.log(c(f"c_{roles.TYPES[0]}") + 1e-12)) / F.log(F.lit(6.0)),
        "holding_gini": F.when(c("avg_holding_ha") > 0, gini(["h_b1", "h_b2", "h_b3", "h_b4"], MIDDLES)).otherwise(0.05),
        "dominant_crop": dominant([f"c_{t}" for t in roles.TYPES], list(roles.TYPES)),
    })
    f = f.withColumns({
        "gross_cropped_ha": c("net_sown_ha") * c("cropping_intensity"),
        "tractor_power": c("tractors") * c("mean_hp") * 0.746 / F.greatest(c("net_sown_ha"), F.lit(1e-6)),
        "credit_depth": clip(c("kcc") * (0.55 + 0.45 * clip(c("avg_holding_ha") / 4, 0, 1.5)), 0, 1.4),
        "service_density": clip(c("dealer_accessibility") * 1.9, 0, 1.5),
    })
    f = f.withColumns({
        "residue_t": c("gross_cropped_ha") * dot(["c_SMALL", "c_MEDIUM", "c_PROMO"], [5.5, 3.6, 2.0]),
        "farm_power_kw_ha": farm_power("tractor_power", "irrigation_ratio", "small_marginal_share"),
        "approval_rate": clip(0.61 + 0.34 * (c("credit_depth") - 0.5) + 0.08, 0.15, 0.95),
        "adoption": clip(
            0.28 * c("tier") + 0.30 * c("dealer_accessibility") + 0.22 * clip(c("credit_depth"), 0, 1)
            + 0.20 * clip(c("avg_holding_ha") / 5, 0, 1), 0.02, 0.98,
        ),
    })
    f = f.withColumn("residue_per_ha", c("residue_t") / F.greatest(c("gross_cropped_ha"), F.lit(1e-6)))
    return f.select(*IDS, *[steady_round(n, 8).alias(n) for n in NUMERIC])


def features(spark, sf):
    return stage(spark, "features", roles.paths(sf, *INPUTS), lambda: _build(spark, sf))


cte(
    "peer",
    """SELECT a.place_id, coalesce(avg(CASE WHEN d > 0 THEN b_rate END), (SELECT avg(attach_rate) FROM feature)) AS peer_attach_rate
       FROM (SELECT a.place_id, b.attach_rate AS b_rate,
         sqrt((a.lon * 95e0 - b.lon * 95e0) * (a.lon * 95e0 - b.lon * 95e0)
            + (a.lat * 111e0 - b.lat * 111e0) * (a.lat * 111e0 - b.lat * 111e0)) AS d,
         row_number() OVER (PARTITION BY a.place_id ORDER BY d, b.place_id) AS rn
         FROM feature a JOIN feature b ON a.state_id = b.state_id) a
       WHERE rn <= 13 GROUP BY 1""",
    "feature",
)


def _build_peers(spark, sf):
    f = features(spark, sf).select("place_id", "state_id", "lon", "lat", "attach_rate", "tractor_density", "income_per_ha")
    return neighbour_mean(f, "place_id", ["state_id"], ["attach_rate", "tractor_density", "income_per_ha"])


def peers(spark, sf):
    """Neighbourhood means of each place."""
    return stage(spark, "peers", roles.paths(sf, *INPUTS), lambda: _build_peers(spark, sf))

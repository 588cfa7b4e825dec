"""Choice shares, contests, substitution between products, what-if questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from geodemand import config as C
from geodemand.functions.scalars import steady_round
from geodemand.operators import choice as H
from geodemand.operators import indices as I
from geodemand.operators import scenario as X
from geodemand.operators.levels import children
from geodemand.operators.pairs import close_pairs
from geodemand.plans import levels as LV
from geodemand.plans import place_role as PR
from geodemand.plans import scoring as SC
from geodemand.plans.drill import SEASONS
from geodemand.plans.registry import cte, query
from geodemand.session import spread, stage
from geodemand.sources import roles

OWN = C.OWN_PLAYER

cte(
    "offer",
    f"""SELECT b.state_id, f.category, b.player, {C.BRAND_WEIGHT}e0 * (bias - 1) + {C.FIT_WEIGHT}e0 * (fit / max(fit) OVER (PARTITION BY b.state_id, f.category))
          + {C.PRICE_SENSITIVITY}e0 * (price_index - 1) AS u, reach, price_index
        FROM (SELECT state_id, player, (u / sum(u) OVER (PARTITION BY state_id)) / (n / sum(u) OVER ()) AS bias FROM
               (SELECT state_id, player, sum(units) AS u, sum(sum(units)) OVER (PARTITION BY player) AS n FROM star GROUP BY 1, 2)) b
        JOIN (SELECT category, player, sum(units) / sum(sum(units)) OVER (PARTITION BY player) AS fit FROM fact GROUP BY 1, 2) f ON f.player = b.player
        JOIN (SELECT player, avg(p_retailprice) / (SELECT avg(p_retailprice) FROM part) AS price_index,
               CAST(20 + 5 * (CAST(regexp_extract(player, '[0-9]+') AS INT) % 7) AS DOUBLE) AS reach FROM parts GROUP BY player) r ON r.player = b.player""",
    "star", "fact", "parts",
)
cte(
    "share",
    """SELECT place_id, district_id, state_id, category, player, e / sum(e) OVER (PARTITION BY place_id, category) AS share FROM (
        SELECT place_id, district_id, state_id, category, player, exp(v - max(v) OVER (PARTITION BY place_id, category)) AS e FROM (
         SELECT f.place_id, f.district_id, f.state_id, o.category, o.player, o.u + -0.055e0 * greatest(0e0, f.dealer_distance_km - o.reach) AS v
         FROM feature f JOIN offer o ON o.state_id = f.state_id))""",
    "feature", "offer",
)
cte(
    "land",
    f"""SELECT place_id, category, coalesce(max(CASE WHEN player = '{OWN}' THEN share END), 0) AS own_share,
         max(CASE WHEN r = 1 THEN player END) AS leader, max(CASE WHEN r = 1 THEN share END) AS leader_share,
         max(CASE WHEN player <> '{OWN}' AND q = 1 THEN player END) AS closest_rival, max(CASE WHEN player <> '{OWN}' AND q = 1 THEN share END) AS rival_share,
         sum(share * share) AS hhi FROM (
        SELECT *, row_number() OVER (PARTITION BY place_id, category ORDER BY share DESC, player) AS r,
          row_number() OVER (PARTITION BY place_id, category, player = '{OWN}' ORDER BY share DESC, player) AS q FROM share) GROUP BY 1, 2""",
    "share",
)


def offers(spark, sf):
    f = children(LV.items_above(spark, sf), "state")
    by_state = f.groupBy("state_id", "player").agg(F.sum("units").alias("u"))
    state = by_state.groupBy("state_id").agg(F.sum("u").alias("s"))
    player = by_state.groupBy("player").agg(F.sum("u").alias("n"))
    total = by_state.agg(F.sum("u").alias("t")).scalar()
    bias = by_state.join(state, "state_id").join(player, "player").select(
        "state_id", "player", ((F.col("u") / F.col("s")) / (F.col("n") / total)).alias("bias")
    )
    by_cat = f.groupBy("category", "player").agg(F.sum("units").alias("u"))
    fit = by_cat.join(player, "player").select("category", "player", (F.col("u") / F.col("n")).alias("fit"))
    return H.offers(bias, fit, price_reach(spark, sf))


def price_reach(spark, sf):
    p = roles.table(spark, sf, "part")
    mean = p.agg(F.avg("p_retailprice").alias("m")).scalar()
    n = F.regexp_extract("player", "[0-9]+", 0).cast("int")
    return (
        p.groupBy(F.col("p_brand").alias("player")).agg(F.avg("p_retailprice").alias("a"))
        .select("player", (F.col("a") / mean).alias("price_index"), (20 + 5 * (n % 7)).cast("double").alias("reach_km"))
    )


def shares(spark, sf):
    def build():
        p = PR.features(spark, sf).select("place_id", "district_id", "state_id", "dealer_distance_km")
        return H.choice_shares(spread(p, "place_id"), offers(spark, sf), "dealer_distance_km").drop("dealer_distance_km")

    return stage(spark, "shares", roles.paths(sf, *PR.INPUTS), build)


def _lands(spark, sf):
    """The graded landscape of each place and category."""
    build = lambda: H.graded_lands(H.landscape(shares(spark, sf), OWN).drop("district_id", "state_id"), OWN)
    return stage(spark, "lands", roles.paths(sf, *PR.INPUTS), build, bucket_by="place_id")


_LAND = ["own_share", "leader", "leader_share", "closest_rival", "rival_share", "share_gap", "hhi", "closeness", "status", "win_part", "loss_part"]


def _met(spark, sf):
    """Scored rows with the landscape of their place and category, which meets the place before the products do."""
    s = SC.scores(spark, sf, SC.scored_places(spark, sf).join(_lands(spark, sf), "place_id"), _LAND)
    return s.select("place_id", "district_id", "sku_id", "category", "potential_units_yr", "potential_value", *_LAND)


def contests(spark, sf):
    """Graded scored rows, worked out anew by each question from what is stored per place."""
    build = lambda: _met(spark, sf).groupBy("category").agg(F.avg("own_share").alias("_norm"))
    return H.grade_contests(_met(spark, sf), stage(spark, "share_norm", roles.paths(sf, *PR.INPUTS), build))


@query(
    "choice_shares",
    "SELECT place_id, category, player, round(share, 8) AS share FROM share",
    needs=("share",),
)
def choice_shares(spark, sf):
    s = shares(spark, sf).select("place_id", "category", F.explode("shares").alias("s"))
    return s.select("place_id", "category", F.col("s.player").alias("player"), F.round("s.share", 8).alias("share"))


@query(
    "choice_landscape",
    """SELECT place_id, category, round(own_share, 8) AS own_share, leader, round(leader_share, 8) AS leader_share, closest_rival,
         round(rival_share, 8) AS rival_share, round(rival_share - own_share, 8) AS share_gap, round(hhi, 8) AS hhi FROM land""",
    needs=("land",),
)
def choice_landscape(spark, sf):
    l = H.landscape(shares(spark, sf), OWN)
    r = lambda c: F.round(c, 8).alias(c)
    return l.select("place_id", "category", r("own_share"), "leader", r("leader_share"), "closest_rival", r("rival_share"), r("share_gap"), r("hhi"))


@query(
    "player_shares",
    """SELECT s.district_id, s.category, s.player, round(avg(share), 8) AS share, round(min(price_index), 8) AS price_index, min(reach) AS reach_km
       FROM share s JOIN (SELECT DISTINCT player, price_index, reach FROM offer) o USING (player) GROUP BY 1, 2, 3""",
    needs=("share",),
)
def player_shares(spark, sf):
    p = H.player_shares(shares(spark, sf), "district_id").join(price_reach(spark, sf), "player")
    return p.select("district_id", "category", "player", F.round("share", 8).alias("share"), F.round("price_index", 8).alias("price_index"), "reach_km")


@query(
    "player_summary",
    """, d AS (SELECT district_id, category, player, avg(share) AS share FROM share GROUP BY 1, 2, 3)
       SELECT player, round(avg(share), 8) AS share FROM d WHERE category = 'PROMO' GROUP BY 1""",
    needs=("share",),
)
def player_summary(spark, sf):
    p = H.player_shares(shares(spark, sf), "district_id").where(F.col("category") == "PROMO")
    return p.groupBy("player").agg(F.round(F.avg("share"), 8).alias("share"))


cte(
    "contest",
    f"""SELECT *, CASE WHEN leader = '{OWN}' THEN 'Leading' WHEN closeness >= 0.42e0 THEN 'Winnable' WHEN closeness >= 0.28e0 THEN 'Stretch' ELSE 'Out of reach' END AS status,
         competitor_units * pow(least(1e0, greatest(0e0, (closeness - 0.25e0) / 0.35e0)), 1.5e0) * 0.3e0 AS winnable_units,
         least(own_units, own_units * pow(least(1e0, greatest(0e0, 1 - closeness)), 1.2e0) * 0.4e0) AS at_risk_units FROM (
        SELECT s.place_id, s.district_id, s.sku_id, s.category, s.potential_units_yr AS market_units, l.* EXCLUDE (place_id, category),
          s.potential_units_yr * own_share AS own_units, s.potential_units_yr - s.potential_units_yr * own_share AS competitor_units,
          own_share / greatest(avg(own_share) OVER (PARTITION BY s.category), 1e-9) * 100 AS share_index,
          own_share / greatest(own_share + rival_share, 1e-9) AS closeness
        FROM score s JOIN land l ON l.place_id = s.place_id AND l.category = s.category)""",
    "score", "land",
)
_CONTEST = ["market_units", "own_units", "competitor_units", "share_index", "closeness", "winnable_units", "at_risk_units"]


@query(
    "contest_grading",
    "SELECT place_id, sku_id, leader, closest_rival, status, " + ", ".join(f"round({c} + 3e-11, 6) AS {c}" for c in _CONTEST) + " FROM contest",
    needs=("contest",),
)
def contest_grading(spark, sf):
    return contests(spark, sf).select("place_id", "sku_id", "leader", "closest_rival", "status", *[steady_round(c, 6).alias(c) for c in _CONTEST])


@query(
    "contest_status_case",
    """SELECT status, count(*) AS contests, round(sum(market_units), 4) AS market, round(sum(own_units), 5) AS own,
         round(sum(winnable_units), 5) AS winnable FROM contest GROUP BY 1""",
    needs=("contest",),
)
def contest_status_case(spark, sf):
    m = H.market_sums(contests(spark, sf), ["status"])
    return m.select("status", "contests", F.round("market", 4).alias("market"), F.round("own", 5).alias("own"), F.round("winnable", 5).alias("winnable"))


_MS = """round(sum(market_units), 4) AS market, round(sum(own_units), 5) AS own, round(sum(competitor_units), 4) AS competitor,
   round(sum(winnable_units), 5) AS winnable, round(sum(at_risk_units), 5) AS at_risk"""


def _ms(m):
    return [F.round(c, d).alias(c) for c, d in (("market", 4), ("own", 5), ("competitor", 4), ("winnable", 5), ("at_risk", 5))]


@query(
    "market_summary",
    f"""SELECT 'all' AS scope, CAST(NULL AS VARCHAR) AS rival, count(*) AS contests, {_MS}, round(avg(hhi), 6) AS hhi,
          round(sum(own_units) / sum(market_units) * 100, 6) AS own_share_pct FROM contest
        UNION ALL SELECT 'rival', closest_rival, count(*), {_MS}, round(avg(hhi), 6), round(sum(own_units) / sum(market_units) * 100, 6)
        FROM contest WHERE closest_rival <> '{OWN}' GROUP BY closest_rival""",
    needs=("contest",),
)
def market_summary(spark, sf):
    c = contests(spark, sf)
    cols = lambda m: ["contests", *_ms(m), F.round("hhi", 6).alias("hhi"), F.round("own_share_pct", 6).alias("own_share_pct")]
    a, r = H.market_sums(c, []), H.market_sums(c.where(F.col("closest_rival") != OWN), ["closest_rival"])
    total = a.select(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("rival"), *cols(a))
    return total.unionByName(r.select(F.lit("rival").alias("scope"), F.col("closest_rival").alias("rival"), *cols(r)))


@query(
    "head_to_head",
    f"""SELECT category, {_MS}, round(avg(closeness), 6) AS closeness FROM contest
        WHERE closest_rival = (SELECT max(closest_rival) FROM contest) GROUP BY 1""",
    needs=("contest",),
)
def head_to_head(spark, sf):
    c = contests(spark, sf)
    rival = c.agg(F.max("closest_rival").alias("r")).scalar()
    m = H.market_sums(c.where(F.col("closest_rival") == rival), ["category"])
    return m.select("category", *_ms(m), F.round("closeness", 6).alias("closeness"))


@query(
    "head_to_head_districts",
    """SELECT n_name AS district, round(sum(competitor_units), 4) AS theirs, round(sum(winnable_units), 5) AS winnable
       FROM contest JOIN nation ON n_nationkey = district_id WHERE closest_rival = (SELECT max(closest_rival) FROM contest)
       GROUP BY 1 ORDER BY winnable DESC, district LIMIT 12""",
    needs=("contest",),
)
def head_to_head_districts(spark, sf):
    c = contests(spark, sf)
    rival = c.agg(F.max("closest_rival").alias("r")).scalar()
    m = H.market_sums(c.where(F.col("closest_rival") == rival), ["district_id"])
    d = roles.districts(spark, sf).select("district_id", "district")
    return m.join(d, "district_id").select("district", F.round("competitor", 4).alias("theirs"), F.round("winnable", 5).alias("winnable")).orderBy(
        F.desc("winnable"), "district"
    ).limit(12)


# ---------------------------------------------------------------- substitution

_BN = "CAST(regexp_extract(player, '[0-9]+') AS INT)"
_DOM = "CASE greatest(b1, b2, b3, b4) WHEN b1 THEN 'b1' WHEN b2 THEN 'b2' WHEN b3 THEN 'b3' ELSE 'b4' END"

cte(
    "item",
    f"""SELECT p.sku_id, category, price, ln(price) AS lp, [{_DOM} || ' ' || category, 'group ' || ({_BN} % 5) || ' ' || category] AS jobs,
         o1, o2, o3, o4, b1, b2, b3, b4, c0, c1, c2, c3, c4 FROM (SELECT p.*, {SC._OVER} FROM (SELECT *, CAST(20 + ({_BN} % 6) * 5 AS DOUBLE) AS lo FROM product) p) p
       JOIN (SELECT sku_id, sum(CASE WHEN state_id = 0 THEN units ELSE 0 END) AS c0, sum(CASE WHEN state_id = 1 THEN units ELSE 0 END) AS c1,
          sum(CASE WHEN state_id = 2 THEN units ELSE 0 END) AS c2, sum(CASE WHEN state_id = 3 THEN units ELSE 0 END) AS c3,
          sum(CASE WHEN state_id = 4 THEN units ELSE 0 END) AS c4 FROM star GROUP BY 1) s USING (sku_id)""",
    "product", "star",
)


def _cos(cols):
    dot = " + ".join(f"a.{c} * b.{c}" for c in cols)
    na = " + ".join(f"a.{c} * a.{c}" for c in cols)
    nb = " + ".join(f"b.{c} * b.{c}" for c in cols)
    return f"(({dot}) / ((sqrt({na}) + 1e-12) * (sqrt({nb}) + 1e-12)))"


cte(
    "overlap",
    f"""SELECT * FROM (SELECT a.sku_id AS sku_a, b.sku_id AS sku_b, array_to_string(list_sort(list_intersect(a.jobs, b.jobs)), ', ') AS shared_job,
         a.category = b.category AS same_category, a.price AS price_a, b.price AS price_b,
         {_cos(['o1', 'o2', 'o3', 'o4'])} * {_cos(['b1', 'b2', 'b3', 'b4'])} * {_cos(['c0', 'c1', 'c2', 'c3', 'c4'])}
          * (0.55e0 + 0.45e0 * 1e0) * exp(-abs(a.lp - b.lp) / 1.4e0) AS overlap
        FROM item a JOIN item b ON a.sku_id < b.sku_id AND len(list_intersect(a.jobs, b.jobs)) > 0) WHERE overlap >= 0.35""",
    "item",
)


def items(spark, sf):
    """Product profiles: jobs, power bands, sizes, where they sell, when they sell."""
    n = F.regexp_extract("player", "[0-9]+", 0).cast("int")
    lo = (20 + (n % 6) * 5).cast("double")
    from geodemand.functions.scalars import dominant

    p = roles.products(spark, sf).withColumn("_lo", lo)
    bands = I.band_overlap(F.col("_lo"), F.col("_lo") + 20, C.POWER_BANDS, F.col("category").isin(*C.SELF_PROPELLED))
    regions = [r[0] for r in roles.states(spark, sf).select("state_id").orderBy("state_id").collect()]  # as many as the profile is long
    sold = children(LV.items_above(spark, sf), "state").groupBy("sku_id").agg(
        F.array(*[F.sum(F.when(F.col("state_id") == i, F.col("units")).otherwise(0.0)) for i in regions]).alias("crops")
    )
    season = F.create_map(*[
        x for c, m in SEASONS.items() for x in (F.lit(c), F.array(*[F.lit(1.0 if i in m else 0.0) for i in range(1, 13)]))
    ])
    return p.select(
        "sku_id", "category", "price",
        F.array(
            F.concat_ws(" ", dominant(["b1", "b2", "b3", "b4"]), "category"),
            F.concat(F.lit("group "), (n % 5).cast("string"), F.lit(" "), F.col("category")),
        ).alias("jobs"),
        F.array(*bands).alias("bands"), F.array("b1", "b2", "b3", "b4").alias("sizes"), season[F.col("category")].alias("season"),
    ).join(sold, "sku_id")


def overlaps(spark, sf):
    return stage(spark, "overlaps", roles.paths(sf, *PR.INPUTS), lambda: H.item_overlap(items(spark, sf)))


@query(
    "item_overlap",
    "SELECT sku_a, sku_b, shared_job, same_category, round(overlap, 8) AS overlap FROM overlap",
    needs=("overlap",),
)
def item_overlap(spark, sf):
    return overlaps(spark, sf).select("sku_a", "sku_b", "shared_job", "same_category", F.round("overlap", 8).alias("overlap"))


@query(
    "theta_pairs",
    """SELECT a.sku_id AS sku_a, b.sku_id AS sku_b, round(a.price - b.price, 4) AS price_gap FROM product a JOIN product b
       ON a.category = b.category AND a.sku_id < b.sku_id WHERE abs(a.price - b.price) <= 2""",
    needs=("product",),
)
def theta_pairs(spark, sf):
    """Pairs of a category whose prices lie within 2 of each other, met by price band and block."""
    p = close_pairs(roles.products(spark, sf).select("category", "sku_id", "price"), "category", "price", 2, "sku_id")
    return p.select(F.col("sku_id_a").alias("sku_a"), F.col("sku_id_b").alias("sku_b"), F.round(F.col("price_a") - F.col("price_b"), 4).alias("price_gap"))


@query(
    "shared_tags",
    """SELECT sku_a, sku_b, array_to_string(list_sort(list_intersect(a.jobs, b.jobs)), ', ') AS shared,
         CAST(len(list_intersect(a.jobs, b.jobs)) AS INT) AS n_shared
       FROM overlap JOIN item a ON a.sku_id = sku_a JOIN item b ON b.sku_id = sku_b""",
    needs=("overlap", "item"),
)
def shared_tags(spark, sf):
    i = items(spark, sf)
    a = i.select(F.col("sku_id").alias("sku_a"), F.col("jobs").alias("ja"))
    b = i.select(F.col("sku_id").alias("sku_b"), F.col("jobs").alias("jb"))
    o = overlaps(spark, sf).select("sku_a", "sku_b").join(a, "sku_a").join(b, "sku_b")
    s = F.array_sort(F.array_intersect("ja", "jb"))
    return o.select("sku_a", "sku_b", F.concat_ws(", ", s).alias("shared"), F.size(s).alias("n_shared"))


def own_units(spark, sf):
    return contests(spark, sf).select("place_id", "sku_id", F.col("own_units").alias("units"))


cte(
    "concession",
    """SELECT a.place_id, sku_a, sku_b, overlap * 0.45e0 AS frac, least(a.own_units, b.own_units) AS shared,
         CASE WHEN a.own_units <= b.own_units + 1e-12 THEN sku_a ELSE sku_b END AS sku_id, CASE WHEN a.own_units <= b.own_units + 1e-12 THEN a.own_units ELSE b.own_units END AS own
       FROM overlap JOIN contest a ON a.sku_id = sku_a JOIN contest b ON b.sku_id = sku_b AND b.place_id = a.place_id WHERE overlap >= 0.55""",
    "overlap", "contest",
)


@query(
    "internal_displacement",
    """, k AS (SELECT place_id, sku_id, product(1 - CASE WHEN own > 0 THEN least(1e0, greatest(0e0, shared / greatest(own, 1e-9) * frac)) ELSE 0 END) AS retain,
           max(own) AS own FROM concession GROUP BY 1, 2),
         l AS (SELECT sku_id, sum(own * (1 - retain)) AS d FROM k GROUP BY 1), g AS (SELECT sku_id, sum(own_units) AS g FROM contest GROUP BY 1)
       SELECT sku_id, round(d, 6) AS displaced_units, round(g, 6) AS gross_units, round(d / greatest(g, 1e-9) * 100, 5) AS displaced_pct
       FROM l JOIN g USING (sku_id) WHERE d > 0""",
    needs=("concession",),
)
def internal_displacement(spark, sf):
    d = H.displacement_by_item(own_units(spark, sf), overlaps(spark, sf))
    return d.select("sku_id", F.round("displaced_units", 6).alias("displaced_units"), F.round("gross_units", 6).alias("gross_units"), F.round("displaced_pct", 5).alias("displaced_pct"))


@query(
    "displacement_pairs",
    """SELECT sku_a, sku_b, CAST(sum(CASE WHEN shared > 0.01 THEN 1 ELSE 0 END) AS BIGINT) AS places_affected, round(sum(shared * frac), 6) AS displaced_units,
         round(sum(shared * frac) * least(min(price_a), min(price_b)), 4) AS displaced_value
       FROM concession JOIN overlap USING (sku_a, sku_b) GROUP BY 1, 2 HAVING sum(shared * frac) >= 0.001""",
    needs=("concession", "overlap"),
)
def displacement_pairs(spark, sf):
    d = H.displacement_by_pair(own_units(spark, sf), overlaps(spark, sf), min_units=0.001)
    return d.select("sku_a", "sku_b", "places_affected", F.round("displaced_units", 6).alias("displaced_units"), F.round("displaced_value", 4).alias("displaced_value"))


# ---------------------------------------------------------------- what-if

NEW = {"F6": 0.30, "F10": 0.20}
_NW = {f: (f"{NEW[f]}e0" if f in NEW else f"w_{f}") for f in C.FACTORS}
_POS = " + ".join(f"greatest({v}, 0)" for v in _NW.values())


@query(
    "scenario_reweight",
    ", nw AS (SELECT sku_id, " + ", ".join(f"{v} / ({_POS}) AS n_{f}" for f, v in _NW.items()) + " FROM weight_wide),"
    + " r AS (SELECT s.district_id, s.potential_units_yr AS u, s.potential_value AS v, "
    + " + ".join(f"fa.{f} / 100 * s.w_{f}" for f in C.FACTORS) + " AS old, "
    + " + ".join(f"fa.{f} / 100 * n_{f}" for f in C.FACTORS)
    + """ AS new FROM score s JOIN factor fa USING (place_id) JOIN nw USING (sku_id)),
       m AS (SELECT district_id, u, v, CASE WHEN old > 1e-9 THEN new / old ELSE 1 END AS k FROM r)
       SELECT district_id, round(sum(u), 5) AS units_base, round(sum(u * k), 5) AS units_scenario, round(sum(v), 2) AS value_base, round(sum(v * k), 2) AS value_scenario,
         round(sum(u * k) - sum(u), 5) AS delta_units, round((sum(u * k) - sum(u)) / sum(u) * 100, 5) AS delta_pct FROM m GROUP BY 1""",
    needs=("score", "factor", "weight_wide"),
)
def scenario_reweight(spark, sf):
    r = X.reweight(SC.scores(spark, sf), SC.factors(spark, sf), I.weights_wide(SC.weights(spark, sf)), NEW, "district_id")
    return r.select("district_id", *[F.round(c, d).alias(c) for c, d in (
        ("units_base", 5), ("units_scenario", 5), ("value_base", 2), ("value_scenario", 2), ("delta_units", 5), ("delta_pct", 5))])


_SHOCK_SQL = """, s AS (SELECT district_id, sum(potential_units_yr) AS units_base, sum(potential_value) AS value_base FROM score GROUP BY 1),
   e AS (SELECT district_id, sum(beta * CASE regressor WHEN 'x2' THEN -1.5e0 ELSE 0.5e0 END) AS dlog,
     sum(pow(se * CASE regressor WHEN 'x2' THEN -1.5e0 ELSE 0.5e0 END, 2)) AS var FROM betas WHERE regressor IN ('x2', 'x3') GROUP BY 1),
   g AS (SELECT s.district_id, units_base, units_base * exp(dlog) AS units_scenario, units_base * exp(dlog) * exp(-1.645e0 * sqrt(var)) AS units_lo,
     units_base * exp(dlog) * exp(1.645e0 * sqrt(var)) AS units_hi FROM s JOIN e USING (district_id))"""
_SHOCK_OUT = """round(sum(units_base), 5) AS units_base, round(sum(units_scenario), 5) AS units_scenario,
   round((sum(units_scenario) - sum(units_base)) / sum(units_base) * 100, 5) AS delta_pct,
   round((sum(units_lo) / sum(units_base) - 1) * 100, 5) AS delta_pct_lo, round((sum(units_hi) / sum(units_base) - 1) * 100, 4) AS delta_pct_hi"""
SHOCKS = {"x2": -1.5, "x3": 0.5}


def _shock_out(df, key):
    return df.select(key, *[F.round(c, d).alias(c) for c, d in (
        ("units_base", 5), ("units_scenario", 5), ("delta_pct", 5), ("delta_pct_lo", 5), ("delta_pct_hi", 4))])


@query("scenario_shock", _SHOCK_SQL + f" SELECT district_id, {_SHOCK_OUT} FROM g GROUP BY 1", needs=("score", "betas"))
def scenario_shock(spark, sf):
    return _shock_out(X.shock(SC.scores(spark, sf), SC.betas(spark, sf), SHOCKS, "district_id"), "district_id")


@query(
    "scenario_shock_state",
    _SHOCK_SQL + f" SELECT n_regionkey AS state_id, {_SHOCK_OUT} FROM g JOIN nation ON n_nationkey = district_id GROUP BY 1",
    needs=("score", "betas"),
)
def scenario_shock_state(spark, sf):
    d = roles.districts(spark, sf).select("district_id", "state_id")
    return _shock_out(X.shock(SC.scores(spark, sf), SC.betas(spark, sf), SHOCKS, "district_id", d, "state_id"), "state_id")


_MIXED = """ round(sum(units_base), 5) AS units_base, round(sum(units_scenario), 5) AS units_scenario,
       round((sum(units_scenario) / sum(units_base) - 1) * 100, 5) AS delta_pct, round((sum(units_lo) / sum(units_base) - 1) * 100, 5) AS delta_pct_lo,
       round((sum(units_hi) / sum(units_base) - 1) * 100, 4) AS delta_pct_hi, round(sum(value_scenario), 2) AS value_scenario FROM g GROUP BY 1"""


def _mixed_sql(where: str, level: str) -> str:
    """Every scored row by its new weight and its district's slopes, in one product."""
    return (
        ", nw AS (SELECT sku_id, " + ", ".join(f"{v} / ({_POS}) AS n_{f}" for f, v in _NW.items()) + " FROM weight_wide),"
        + " r AS (SELECT s.district_id, n_regionkey AS state_id, s.potential_units_yr AS u, s.potential_value AS v, "
        + " + ".join(f"fa.{f} / 100 * s.w_{f}" for f in C.FACTORS) + " AS old, " + " + ".join(f"fa.{f} / 100 * n_{f}" for f in C.FACTORS)
        + f""" AS new FROM score s JOIN factor fa USING (place_id) JOIN nw USING (sku_id) JOIN nation ON n_nationkey = s.district_id WHERE {where}),
       e AS (SELECT district_id, sum(beta * CASE regressor WHEN 'x2' THEN -1.5e0 ELSE 0.5e0 END) AS dlog,
         sqrt(sum(pow(se * CASE regressor WHEN 'x2' THEN -1.5e0 ELSE 0.5e0 END, 2))) AS sd FROM betas WHERE regressor IN ('x2', 'x3') GROUP BY 1),
       m AS (SELECT *, CASE WHEN old > 1e-9 THEN new / old ELSE 1 END * exp(dlog) AS k FROM r JOIN e USING (district_id)),
       g AS (SELECT district_id, state_id, u AS units_base, u * k AS units_scenario, v * k AS value_scenario, u * k * exp(-1.645e0 * sd) AS units_lo,
         u * k * exp(1.645e0 * sd) AS units_hi FROM m) SELECT {level},"""
        + _MIXED
    )


def _mixed(spark, sf, key, scope=None, within=None):
    d = roles.districts(spark, sf).select("district_id", "state_id")
    r = X.combined(
        SC.scores(spark, sf), SC.factors(spark, sf), I.weights_wide(SC.weights(spark, sf)), SC.betas(spark, sf), d, "district_id", NEW, SHOCKS, scope, within, key
    )
    return r.select(key, *[F.round(c, n).alias(c) for c, n in (
        ("units_base", 5), ("units_scenario", 5), ("delta_pct", 5), ("delta_pct_lo", 5), ("delta_pct_hi", 4), ("value_scenario", 2))])


@query("scenario_combined", _mixed_sql("s.category = (SELECT min(category) FROM product) AND n_regionkey = 2", "district_id"), needs=("score", "factor", "weight_wide", "betas", "product"))
def scenario_combined(spark, sf):
    """Weights and shocks at once, in one category and one state."""
    first = roles.products(spark, sf).agg(F.min("category")).first()[0]
    return _mixed(spark, sf, "district_id", F.col("category") == first, F.col("state_id") == 2)


@query("scenario_combined_state", _mixed_sql("true", "state_id"), needs=("score", "factor", "weight_wide", "betas"))
def scenario_combined_state(spark, sf):
    return _mixed(spark, sf, "state_id")


@query(
    "scenario_rival_move",
    """, r AS (SELECT max(closest_rival) AS rival FROM contest), k AS (SELECT min(reach) AS reach FROM offer, r WHERE player = rival),
       d AS (SELECT -2.4e0 * (-10 / 100e0) + -0.055e0 * (-reach * 15 / 100e0) AS du FROM k),
       x AS (SELECT category, own_units AS b, own_units * (1 + (own_share * (own_share + rival_share) / greatest(own_share + rival_share * exp(du), 1e-12) - own_share)
              / greatest(own_share, 1e-12)) AS a FROM contest, d WHERE closest_rival = (SELECT rival FROM r))
       SELECT category, round(sum(b), 6) AS before, round(sum(a), 6) AS after, count(*) AS contests, round(sum(a) - sum(b), 6) AS delta,
         round((sum(a) - sum(b)) / greatest(sum(b), 1e-9) * 100, 5) AS delta_pct FROM x GROUP BY 1""",
    needs=("contest", "offer"),
)
def scenario_rival_move(spark, sf):
    c = contests(spark, sf)
    # One name and one number decide the move; they are read off before the contests are touched.
    rival = c.agg(F.max("closest_rival")).first()[0]
    reach = price_reach(spark, sf).where(F.col("player") == rival).first()["reach_km"]
    m = X.rival_move(c, rival, reach, price_change_pct=-10.0, dealer_change_pct=15.0)
    return m.select("category", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "contests", F.round("delta", 6).alias("delta"), F.round("delta_pct", 5).alias("delta_pct"))

"""Fact packs with their text, points of a block, definitions of the factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from geodemand import config as C
from geodemand.functions.scalars import steady_round
from geodemand.operators import indices as I
from geodemand.operators import panel as P
from geodemand.operators.segments import segment_cards
from geodemand.plans import scoring as SC
from geodemand.plans.insight import base_insights, insights
from geodemand.plans.panel_plan import simple_parts
from geodemand.plans.registry import query
from geodemand.sources import roles


@query(
    "fact_pack_executive",
    """, s AS (SELECT r_name AS state, sum(potential_units_yr) AS u FROM ins3 JOIN region ON r_regionkey = state_id GROUP BY 1),
       p AS (SELECT sku_id, sum(potential_units_yr) AS u FROM score GROUP BY 1), c AS (SELECT category, sum(potential_units_yr) AS u FROM score GROUP BY 1),
       a AS (SELECT count(*) AS places, sum(potential_units_yr) AS u, sum(potential_value) AS v, sum(headroom) AS h, sum(owned) / sum(addressable) * 100 AS pen,
         count(*) FILTER (action_segment = 'Convert now') AS convert_now FROM ins3)
       SELECT places, round(u, 3) AS total_units, round(v / 1e7, 5) AS value_crore, round(h, 3) AS unserved, round(pen, 4) AS penetration_pct,
         (SELECT state FROM s ORDER BY u DESC, state LIMIT 1) AS lead_state, (SELECT sku_id FROM p ORDER BY round(u, 6) DESC, sku_id LIMIT 1) AS top_product,
         (SELECT category FROM c ORDER BY u DESC, category LIMIT 1) AS biggest_category, convert_now,
         format('{:,}', places) || ' places; most demand in ' || (SELECT state FROM s ORDER BY u DESC, state LIMIT 1) || '; served so far: '
           || printf('%.0f', round(pen + 3e-11)) || ' percent.' AS txt FROM a""",
    needs=("ins3", "score"),
)
def fact_pack_executive(spark, sf):
    i = base_insights(spark, sf)
    lead = lambda df, k: df.groupBy(k).agg(F.sum("potential_units_yr").alias("u")).agg(F.min_by(k, F.struct((-F.round("u", 6)).alias("x"), k)).alias("v")).scalar()
    state = lead(i.join(roles.states(spark, sf), "state_id"), "state")
    sc = SC.scores(spark, sf)
    a = i.agg(
        F.count(F.lit(1)).alias("places"), F.sum("potential_units_yr").alias("u"), F.sum("potential_value").alias("v"), F.sum("headroom").alias("h"),
        (F.sum("owned") / F.sum("addressable") * 100).alias("pen"), F.count(F.when(F.col("action_segment") == "Convert now", 1)).alias("convert_now"),
    )
    text = F.concat(
        F.format_number("places", 0), F.lit(" places; most demand in "), state, F.lit("; served so far: "),
        F.format_string("%.0f", steady_round("pen", 0)), F.lit(" percent."),
    )
    return a.select(
        "places", F.round("u", 3).alias("total_units"), F.round(F.col("v") / 1e7, 5).alias("value_crore"), F.round("h", 3).alias("unserved"),
        F.round("pen", 4).alias("penetration_pct"), state.alias("lead_state"), lead(sc, "sku_id").alias("top_product"), lead(sc, "category").alias("biggest_category"),
        "convert_now", text.alias("txt"),
    )


@query(
    "fact_pack_drivers",
    """, k AS (SELECT *, (row_number() OVER (PARTITION BY district_id ORDER BY month DESC) - 1) // 12 AS blk FROM parts12),
       d AS (SELECT district_id, """
    + ", ".join(f"avg({c}) FILTER (blk = 0) - avg({c}) FILTER (blk = 1) AS {n}" for c, n in (("ly", "total"), ("seasonal", "seasonal"), ("contrib_x1", "x1"), ("contrib_x2", "x2"), ("irregular", "irregular")))
    + """ FROM k WHERE blk < 2 GROUP BY 1 HAVING count(*) = 24),
       u AS (SELECT district_id, total, component, v FROM d UNPIVOT (v FOR component IN (seasonal, x1, x2, irregular)) WHERE abs(v) >= 1e-6),
       b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY district_id ORDER BY abs(v) DESC, component) = 1)
       SELECT n_name AS district, round((exp(total) - 1) * 100, 4) AS change_pct, component AS biggest_driver, round(v * 100, 4) AS effect_pp,
         'Sales in ' || n_name || ' moved ' || CASE WHEN exp(total) - 1 >= 0 THEN '+' ELSE '-' END || printf('%.1f', round(abs((exp(total) - 1) * 100) + 3e-11, 1))
          || '% over the last year. The biggest single influence was ' || component || '.' AS txt FROM b JOIN nation ON n_nationkey = district_id""",
    needs=("parts12",),
)
def fact_pack_drivers(spark, sf):
    p = simple_parts(spark, sf).withColumnRenamed("contrib_x1", "c_x1").withColumnRenamed("contrib_x2", "c_x2")
    p = p.drop("x1", "x2").withColumnRenamed("c_x1", "x1").withColumnRenamed("c_x2", "x2")
    u = P.uplift(p, "district_id", "month", "ly", ["seasonal", "x1", "x2", "irregular"])
    top = u.groupBy("district_id", "total_growth_pct").agg(
        F.min_by(F.struct("component", "pp_of_growth"), F.struct((-F.abs("delta_log")).alias("k"), "component")).alias("t")
    ).join(roles.districts(spark, sf), "district_id")
    g = F.col("total_growth_pct")
    size = F.format_string("%.1f", steady_round(F.abs(g), 1))
    text = F.concat(
        F.lit("Sales in "), "district", F.lit(" moved "), F.when(g >= 0, "+").otherwise("-"), size,
        F.lit("% over the last year. The biggest single influence was "), F.col("t.component"), F.lit("."),
    )
    return top.select(
        "district", F.round(g, 4).alias("change_pct"), F.col("t.component").alias("biggest_driver"), F.round("t.pp_of_growth", 4).alias("effect_pp"), text.alias("txt")
    )


@query(
    "fact_pack_scenario",
    """, s AS (SELECT district_id, sum(potential_units_yr) AS b FROM score GROUP BY 1),
       e AS (SELECT district_id, sum(beta * -1.5e0) AS dlog FROM betas WHERE regressor = 'x2' GROUP BY 1),
       g AS (SELECT district_id, b, b * exp(dlog) AS u, round((exp(dlog) - 1) * 100, 6) AS pct FROM s JOIN e USING (district_id))
       SELECT round(sum(b), 3) AS baseline_units, round(sum(u), 3) AS scenario_units, round((sum(u) / sum(b) - 1) * 100, 5) AS change_pct,
         arg_min(district_id, pct * 1000 + district_id * 1e-9) AS worst_district, arg_max(district_id, pct * 1000 - district_id * 1e-9) AS best_district FROM g""",
    needs=("score", "betas"),
)
def fact_pack_scenario(spark, sf):
    from geodemand.operators.scenario import shock

    g = shock(SC.scores(spark, sf), SC.betas(spark, sf), {"x2": -1.5}, "district_id").withColumn("pct", F.round("delta_pct", 6))
    return g.agg(
        F.sum("units_base").alias("b"), F.sum("units_scenario").alias("u"), F.min_by("district_id", F.struct("pct", "district_id")).alias("worst_district"),
        F.min_by("district_id", F.struct((-F.col("pct")).alias("x"), "district_id")).alias("best_district"),
    ).select(
        F.round("b", 3).alias("baseline_units"), F.round("u", 3).alias("scenario_units"), F.round((F.col("u") / F.col("b") - 1) * 100, 5).alias("change_pct"),
        "worst_district", "best_district",
    )


@query(
    "fact_pack_place",
    """, t AS (SELECT place_id, string_agg(CAST(sku_id AS VARCHAR), ', ' ORDER BY rn) AS best_products, round(sum(u), 5) AS best_units,
           round(max(penetration) FILTER (rn = 1), 5) AS best_owned, min(CAST(sku_id AS VARCHAR)) FILTER (rn = 1) AS first
         FROM (SELECT place_id, sku_id, potential_units_yr AS u, penetration,
                 row_number() OVER (PARTITION BY place_id ORDER BY round(potential_units_yr, 9) DESC, sku_id) AS rn FROM score) WHERE rn <= 4 GROUP BY 1)
       SELECT i.place_id, place, district, archetype, micro_id, action_segment, rank_in_district, places_in_district, round(potential_units_yr, 4) AS units,
         round(headroom, 4) AS unserved, round(attach_rate, 5) AS attach_rate, round(peer_attach_micro, 5) AS peer_attach, round(dealer_distance_km, 4) AS km,
         best_products, best_units, best_owned,
         place || ' stands at ' || rank_in_district || ' among ' || places_in_district || ' in ' || district || ' and wants ' || first || ' most.' AS txt
       FROM insight i JOIN t USING (place_id)""",
    needs=("insight", "score"),
)
def fact_pack_place(spark, sf):
    """What is known of each place, with its four best products."""
    line = F.struct((-F.round("potential_units_yr", 9)).alias("k"), "sku_id", F.col("potential_units_yr").alias("u"), "penetration")
    t = SC.scores(spark, sf).groupBy("place_id").agg(F.slice(F.array_sort(F.collect_list(line)), 1, 4).alias("best"))  # as long as the catalogue
    names = F.transform("best", lambda x: x["sku_id"].cast("string"))
    i = insights(spark, sf).join(t, "place_id")
    text = F.concat(
        "place", F.lit(" stands at "), F.col("rank_in_district").cast("string"), F.lit(" among "), F.col("places_in_district").cast("string"), F.lit(" in "),
        "district", F.lit(" and wants "), names[0], F.lit(" most."),
    )
    return i.select(
        "place_id", "place", "district", "archetype", "micro_id", "action_segment", "rank_in_district", "places_in_district",
        F.round("potential_units_yr", 4).alias("units"), F.round("headroom", 4).alias("unserved"), F.round("attach_rate", 5).alias("attach_rate"),
        F.round("peer_attach_micro", 5).alias("peer_attach"), F.round("dealer_distance_km", 4).alias("km"), F.array_join(names, ", ").alias("best_products"),
        F.round(F.aggregate("best", F.lit(0.0), lambda z, x: z + x["u"]), 5).alias("best_units"), F.round(F.col("best")[0]["penetration"], 5).alias("best_owned"),
        text.alias("txt"),
    )


@query(
    "fact_pack_clusters",
    """, c AS (SELECT micro_id, count(*) AS n, avg(opportunity_score) AS o, avg(dealer_distance_km) AS km FROM ins3 GROUP BY 1),
       m AS (SELECT micro_id, action_segment FROM ins3 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY micro_id ORDER BY count(*) DESC, action_segment) = 1),
       p AS (SELECT * FROM c JOIN m USING (micro_id) ORDER BY round(o, 4) DESC, micro_id LIMIT 6)
       SELECT 'type' AS kind, archetype AS name, count(*) AS places, round(sum(potential_units_yr), 3) AS amount, round(avg(attach_rate), 4) AS detail, NULL AS note FROM ins3 GROUP BY 2
       UNION ALL SELECT 'action', action_segment, count(*), round(sum(headroom), 3), NULL, NULL FROM ins3 GROUP BY 2
       UNION ALL SELECT 'pocket', micro_id, n, round(o, 4), round(km, 4), action_segment FROM p""",
    needs=("ins3",),
)
def fact_pack_clusters(spark, sf):
    """Types by demand, actions by unserved need, and the six best pockets with what they call for."""
    i = base_insights(spark, sf)
    columns = lambda kind, name, amount, detail, note: (F.lit(kind).alias("kind"), F.col(name).alias("name"), "places", amount.alias("amount"), detail.alias("detail"), note.alias("note"))
    none, count = F.lit(None), F.count(F.lit(1)).alias("places")
    types = i.groupBy("archetype").agg(count, F.sum("potential_units_yr").alias("u"), F.avg("attach_rate").alias("a"))
    acts = i.groupBy("action_segment").agg(count, F.sum("headroom").alias("h"))
    cards = segment_cards(i, "micro_id").withColumn("o", F.round("avg_opportunity", 4)).withColumnRenamed("n_places", "places")
    cards = cards.orderBy(F.desc("o"), "micro_id").limit(6)
    return (
        types.select(*columns("type", "archetype", F.round("u", 3), F.round("a", 4), none.cast("string")))
        .unionByName(acts.select(*columns("action", "action_segment", F.round("h", 3), none.cast("double"), none.cast("string"))))
        .unionByName(cards.select(*columns("pocket", "micro_id", F.col("o"), F.round("dealer_km", 4), F.col("dominant_action"))))
    )


@query(
    "block_points",
    """SELECT i.place_id AS id, place AS name, round(lon, 6) AS lon, round(lat, 6) AS lat, action_segment, archetype, top_sku, round(opportunity_score, 4) AS opportunity,
         round(sum(s.potential_units_yr), 6) AS units FROM ins3 i JOIN score s ON s.place_id = i.place_id
       WHERE i.block_id = '7:BUILDING' AND s.category = 'PROMO' GROUP BY ALL ORDER BY units DESC, id""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5, 6, 7, 8"),
    needs=("ins3", "score"),
)
def block_points(spark, sf):
    i = base_insights(spark, sf).where(F.col("block_id") == "7:BUILDING")
    i = i.select("place_id", "place", "lon", "lat", "action_segment", "archetype", "top_sku", "opportunity_score")
    s = SC.scores(spark, sf).where(F.col("category") == "PROMO").join(i.select("place_id"), "place_id", "left_semi")
    u = s.groupBy("place_id").agg(F.round(F.sum("potential_units_yr"), 6).alias("units"))
    return i.join(u, "place_id").select(
        F.col("place_id").alias("id"), F.col("place").alias("name"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "action_segment", "archetype",
        "top_sku", F.round("opportunity_score", 4).alias("opportunity"), "units",
    ).orderBy(F.desc("units"), "id")


def _definitions() -> str:
    t = I.subfactor_table(C.SUBFACTORS, SC._HAVE)
    rows = [
        f"SELECT '{f}' AS factor, '{', '.join(g for h, g, _, _ in t if h == f)}' AS subfactors_used, {sum(1 for h, *_ in t if h == f)} AS n_subfactors,"
        f" round(min({f}), 6) AS lowest, round(max({f}), 6) AS highest FROM factor"
        for f in C.SUBFACTORS
    ]
    return " UNION ALL ".join(rows)


@query("factor_definitions", _definitions(), needs=("factor",))
def factor_definitions(spark, sf):
    """Sub-factors that went into each factor, with the range the factor takes over all places."""
    d = I.factor_definitions(spark, C.SUBFACTORS, SC.drivers(spark, sf).columns)
    f = SC.factors(spark, sf).unpivot("place_id", C.FACTORS, "factor", "v")
    r = f.groupBy("factor").agg(F.round(F.min("v"), 6).alias("lowest"), F.round(F.max("v"), 6).alias("highest"))
    return d.join(r, "factor")

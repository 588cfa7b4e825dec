"""Segmentation queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from geodemand.operators import many_means as M
from geodemand.operators import segments as G
from geodemand.plans import place_role as PR
from geodemand.plans.insight import base_insights
from geodemand.plans.registry import query
from geodemand.session import stage
from geodemand.sources import roles

NUMERIC = ["avg_holding_ha", "small_marginal_share", "irrigation_reliability", "crop_entropy", "high_value_share", "tractor_density",
           "farm_power_kw_ha", "attach_rate", "residue_per_ha", "workability", "income_per_ha", "dealer_accessibility", "chc_density"]
CATEGORICAL = ["dominant_crop", "soil_texture", "state_id"]
MICRO = ["attach_rate", "tractor_density", "dealer_accessibility", "credit_depth", "income_per_ha", "avg_holding_ha", "replacement_pressure", "chc_density"]


def vectors(spark, sf):
    return stage(spark, "vectors", roles.paths(sf, *PR.INPUTS), lambda: G.vectors(PR.features(spark, sf), "place_id", NUMERIC, CATEGORICAL))


def labels(spark, sf):
    def build():
        v = vectors(spark, sf)
        return G.assign(G.fit(v, 6, 7), v).select("place_id", "cluster")

    return stage(spark, "labels", roles.paths(sf, *PR.INPUTS), build)


@query("kmeans_segments")
def kmeans_segments(spark, sf):
    return labels(spark, sf)


@query("k_selection")
def k_selection(spark, sf):
    return G.select_k(vectors(spark, sf))


@query("segment_stability")
def segment_stability(spark, sf):
    return G.stability(vectors(spark, sf), 6)


@query("segment_stability_range", "SELECT CAST(r AS INT) AS resample, true AS in_range FROM unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS t(r)")
def segment_stability_range(spark, sf):
    """Agreement of every resample's fit with the reference lies between none and full."""
    s = G.stability(vectors(spark, sf), 6)
    return s.select("resample", F.col("ari").between(-0.5, 1.0).alias("in_range"))


@query(
    "archetype_profiles_complete",
    "SELECT count(*) AS n_places, true AS names_differ, true AS shares_make_the_whole FROM place",
    needs=("place",),
)
def archetype_profiles_complete(spark, sf):
    """The archetypes hold every place once, under names of their own."""
    p = archetype_profiles(spark, sf)
    return p.agg(
        F.sum("n_places").alias("n_places"), (F.countDistinct("archetype") == F.count(F.lit(1))).alias("names_differ"),
        (F.abs(F.sum("share_pct") - 100) < 1).alias("shares_make_the_whole"),
    )


@query("archetype_profiles")
def archetype_profiles(spark, sf):
    return G.name_archetypes(PR.features(spark, sf).join(labels(spark, sf), "place_id"), "cluster", NUMERIC)


def micro(spark, sf):
    f = PR.features(spark, sf).withColumnRenamed("segment", "archetype")
    build = lambda: G.micro_segments(f, "place_id", "archetype", MICRO)
    return stage(spark, "micro_segments", roles.paths(sf, *PR.INPUTS), build)


@query("micro_segments")
def micro_segments(spark, sf):
    return micro(spark, sf)


@query(
    "micro_segments_complete",
    """SELECT segment AS archetype, count(*) AS n_places, count(*) AS n_labelled, CAST(0 AS BIGINT) AS n_misnumbered, true AS number_in_range
       FROM place GROUP BY 1""",
    needs=("place",),
)
def micro_segments_complete(spark, sf):
    """Every place has one label; labels count down from the largest segment; there are two to four of them."""
    sizes = micro(spark, sf).groupBy("archetype", "micro_segment").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("place_id").alias("places"))
    w = F.array_sort(F.collect_list(F.struct("micro_segment", "n")))
    g = sizes.groupBy("archetype").agg(F.sum("n").alias("n_labelled"), F.sum("places").alias("n_places"), w.alias("w"))
    off = F.filter("w", lambda x, i: (x["micro_segment"] != i) | ((i > 0) & (x["n"] > F.get("w", i - 1)["n"])))
    return g.select("archetype", "n_places", "n_labelled", F.size(off).cast("bigint").alias("n_misnumbered"), F.size("w").between(2, 4).alias("number_in_range"))


@query(
    "segment_fits_add_up",
    """SELECT CAST(k AS INT) AS k, (SELECT count(*) FROM place) AS n_places, 1e0 AS explained_and_left
       FROM unnest([5, 6, 7, 8, 9, 10, 11, 12]) AS t(k)""",
    needs=("place",),
)
def segment_fits_add_up(spark, sf):
    """In every fit all places are dealt out, and what the centres explain and what is left make the whole."""
    points = G.save_table(M.points_of(vectors(spark, sf), "place_id", vector_to_array("features")), "points")
    models = [M.Model(f"k{k}", k) for k in G.K_RANGE]
    centres = M.fit(points, models, 10)
    stats = M.sums(points, models, centres)
    rows = [(m.k, int(sum(v[0] for v in stats[i].values())), round(q[4], 6)) for i, (m, q) in enumerate(zip(models, M.quality(points, models, centres), strict=True))]
    return spark.createDataFrame(rows, "k int, n_places long, explained_and_left double")


@query("embedding_segments")
def embedding_segments(spark, sf):
    """Segments of the embedding table and how far they agree with its labels."""
    from pyspark.ml.functions import array_to_vector

    e = roles.table(spark, sf, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    p = G.assign(G.fit(e, 10, 7), e)
    return p.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))


def _top(c, out):
    return f"""(SELECT string_agg({c}, ', ' ORDER BY rn) FROM (SELECT {c}, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rn FROM ins3 x
        WHERE x.micro_id = i.micro_id GROUP BY 1) WHERE rn <= 3) AS {out}"""


@query(
    "segment_cards",
    f""", m AS (SELECT micro_id, action_segment, count(*) AS n FROM ins3 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY micro_id ORDER BY n DESC, action_segment) = 1),
       s AS (SELECT micro_id, string_agg(top_sku, ', ' ORDER BY rn) AS top_skus FROM (SELECT micro_id, top_sku, row_number() OVER (PARTITION BY micro_id ORDER BY count(*) DESC, top_sku) AS rn
             FROM ins3 GROUP BY 1, 2) WHERE rn <= 3 GROUP BY 1),
       d AS (SELECT micro_id, string_agg(district, ', ' ORDER BY rn) AS districts FROM (SELECT micro_id, district, row_number() OVER (PARTITION BY micro_id ORDER BY count(*) DESC, district) AS rn
             FROM ins3 GROUP BY 1, 2) WHERE rn <= 3 GROUP BY 1)
       SELECT i.micro_id, count(*) AS n_places, round(avg(opportunity_score), 4) AS avg_opportunity, round(sum(potential_units_yr), 3) AS total_units, round(sum(headroom), 3) AS total_headroom,
         round(avg(attach_rate), 4) AS attach_rate, round(avg(dealer_distance_km), 4) AS dealer_km, min(m.action_segment) AS dominant_action, min(top_skus) AS top_skus, min(districts) AS districts
       FROM ins3 i JOIN m USING (micro_id) JOIN s USING (micro_id) JOIN d USING (micro_id) GROUP BY 1""",
    needs=("ins3",),
)
def segment_cards(spark, sf):
    c = G.segment_cards(base_insights(spark, sf), "micro_id")
    digits = {"avg_opportunity": 4, "total_units": 3, "total_headroom": 3, "attach_rate": 4, "dealer_km": 4}
    return c.select("micro_id", "n_places", *[F.round(k, d).alias(k) for k, d in digits.items()], "dominant_action", "top_skus", "districts")

"""Invariants of the demand model over the whole test tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geodemand import config as C
from geodemand.functions import scalars as X
from geodemand.operators import choice as H
from geodemand.operators import entity as E
from geodemand.operators import indices as I
from geodemand.operators import insights as N
from geodemand.operators import scenario as W
from geodemand.operators import segments as G
from geodemand.plans import QUERIES
from geodemand.plans import insight as IN
from geodemand.plans import market as MK
from geodemand.plans import scoring as SC
from geodemand.sources import roles, sinks, tables


def test_levels_reconcile(spark, sf):
    r = QUERIES["level_rollup_reconciled"](spark, sf).toPandas()
    for m in ("units", "value", "headroom"):
        total = r[r.grouping == 7][m].iloc[0]
        for level in (0, 1, 3):
            assert r[r.grouping == level][m].sum() == pytest.approx(total, rel=1e-9)


def test_factor_bounds_and_weights(spark, sf):
    f = SC.factors(spark, sf).toPandas()
    v = f[C.FACTORS + [f"{x}_state" for x in C.FACTORS]].to_numpy(float)
    assert np.nanmin(v) >= 0 and np.nanmax(v) <= 100
    w = SC.weights(spark, sf).toPandas()
    pos = w[w.weight > 0].groupby("sku_id")["weight"].sum()
    assert np.allclose(pos, 1.0) and w["weight"].min() >= C.WEIGHT_MIN


def test_missing_subfactor_renormalises():
    t = I.subfactor_table({"F1": [("a", 0.6, "positive"), ("b", 0.4, "dual"), ("c", 1.0, "negative")]}, ["a", "b"])
    assert [(g, w, f) for _, g, w, f in t] == [("a", 0.6, False), ("b", 0.4, False)]
    with pytest.raises(ValueError):
        I.subfactor_table({"F1": [("z", 1.0, "positive")]}, [])


def test_scores_are_consistent(spark, sf):
    s = SC.scores(spark, sf)
    bad = s.where("propensity < 0 or penetration < 0 or penetration > 0.9500001 or owned > addressable or headroom < 0")
    assert bad.count() == 0
    g = s.groupBy("sku_id").agg(F.sum("potential_units_yr").alias("p"), F.count(F.lit(1)).alias("n")).toPandas()
    assert (g["n"] == s.select("place_id").distinct().count()).all()


def test_season_mean_one(spark, sf):
    s = QUERIES["season_index"](spark, sf).toPandas()
    assert np.allclose(s.groupby("sku_id")["season_index"].mean(), 1.0, atol=1e-6)


def test_choice_shares_sum_to_one_and_respond_to_price(spark, sf):
    s = MK.shares(spark, sf).select(F.explode("shares").alias("s"), "place_id", "category")
    g = s.groupBy("place_id", "category").agg(F.sum("s.share").alias("t"))
    assert g.where("abs(t - 1) > 1e-9").count() == 0
    c = MK.contests(spark, sf)
    rival = c.agg(F.max("closest_rival")).first()[0]
    cheaper = W.rival_move(c, rival, 30.0, -10.0, 0.0).agg(F.sum("delta")).first()[0]
    dearer = W.rival_move(c, rival, 30.0, 10.0, 0.0).agg(F.sum("delta")).first()[0]
    assert cheaper < 0 < dearer


def test_contests_conserve_units(spark, sf):
    c = MK.contests(spark, sf)
    bad = c.where(
        (F.abs(F.col("own_units") + F.col("competitor_units") - F.col("market_units")) > 1e-9)
        | (F.col("at_risk_units") > F.col("own_units") + 1e-12) | (F.col("winnable_units") > F.col("competitor_units"))
    )
    assert bad.count() == 0


def test_displacement_never_exceeds_gross(spark, sf):
    d = H.displacement_by_item(MK.own_units(spark, sf), MK.overlaps(spark, sf))
    assert d.where("displaced_units > gross_units or displaced_pct > 100").count() == 0


def test_overlap_finds_every_pair(spark, sf):
    """Price bands lose no pair: compare with all pairs that share a job."""
    i = MK.items(spark, sf).withColumn("price", F.col("price") * (1 + (F.hash("sku_id") % 7).cast("double") / 3).cast("double"))
    i = i.where("price > 0")
    got = {(r.sku_a, r.sku_b) for r in H.item_overlap(i, 0.2).select("sku_a", "sku_b").collect()}
    p = i.toPandas()
    cos = lambda a, b: float(np.dot(a, b) / ((np.linalg.norm(a) + 1e-12) * (np.linalg.norm(b) + 1e-12)))
    want, rows = set(), list(p.itertuples())
    for a in rows:
        for b in rows:
            if a.sku_id < b.sku_id and set(a.jobs) & set(b.jobs):
                o = cos(a.bands, b.bands) * cos(a.sizes, b.sizes) * cos(a.crops, b.crops) * (0.55 + 0.45 * cos(a.season, b.season))
                if o * np.exp(-abs(np.log(a.price / b.price)) / 1.4) >= 0.2:
                    want.add((a.sku_id, b.sku_id))
    assert got == want and len(got) > 20


def test_reweight_with_own_weights_changes_little(spark, sf):
    with pytest.raises(ValueError):
        W.reweight(None, None, None, {"F99": 1.0}, "district_id")
    r = QUERIES["scenario_reweight"](spark, sf).toPandas()
    assert (r["units_base"] > 0).all() and r["delta_pct"].abs().max() < 500


def test_insight_ranks_and_finder(spark, sf):
    i = IN.insights(spark, sf)
    best = i.where("rank_in_district = 1").groupBy("district_id").agg(F.max("opportunity_score").alias("a"))
    top = i.groupBy("district_id").agg(F.max("opportunity_score").alias("b"))
    assert best.join(top, "district_id").where("a <> b").count() == 0
    assert i.where("opportunity_score < 0 or opportunity_score > 100").count() == 0
    with pytest.raises(ValueError):
        N.find(i, {}, sort="place")


def test_headlines_are_grounded(spark, sf):
    """Every number of four digits in a headline stands in the row it was made from."""
    i = IN.insights(spark, sf)
    facts = i.select("place_id", F.explode(F.array("headroom", "tractors", F.col("rank_in_district").cast("double"))).alias("fact"))
    assert E.ungrounded_numbers(i, "place_id", "headline", facts).count() == 0
    assert E.banned_terms(i, "place_id", "headline", C.BANNED_TERMS).count() == 0


def test_segments(spark, sf):
    k = QUERIES["k_selection"](spark, sf).toPandas()
    assert k["chosen"].sum() == 1 and k[k.chosen]["k"].between(6, 10).all() and list(k["k"]) == list(range(5, 13))
    m = QUERIES["micro_segments"](spark, sf).toPandas()
    assert m.groupby("archetype")["micro_segment"].nunique().between(1, 4).all()
    a = QUERIES["archetype_profiles"](spark, sf).toPandas()
    assert a["archetype"].is_unique and a["n_places"].is_monotonic_decreasing


def test_adjusted_rand(spark):
    same = spark.createDataFrame([(i % 3, (i + 1) % 3) for i in range(30)], "a int, b int")
    assert G.adjusted_rand(same, "a", "b") == pytest.approx(1.0)
    rng = np.random.default_rng(0)
    mixed = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 3, (900, 2))], "a int, b int")
    assert abs(G.adjusted_rand(mixed, "a", "b")) < 0.05


def test_write_contract(spark, tmp_path):
    df = spark.range(3)
    with pytest.raises(ValueError, match="provenance"):
        sinks.write_table(df, str(tmp_path / "a"))
    with pytest.raises(ValueError, match="unknown"):
        sinks.write_table(df.withColumn("provenance", F.lit("guess")), str(tmp_path / "b"))
    sinks.write_table(df.withColumn("provenance", F.lit("real")), str(tmp_path / "c"))
    assert tables.read_table(spark, str(tmp_path / "c")).count() == 3
    with pytest.raises(FileNotFoundError, match="run marts first"):
        tables.read_table(spark, str(tmp_path / "d"), "marts")
    assert tables.register_views(spark, {"t_c": str(tmp_path / "c"), "t_d": str(tmp_path / "d")}) == ["t_c"]


def test_csv_config_and_node_json(spark, tmp_path):
    (tmp_path / "d.csv").write_text("district,zone\nA,Malwa\nB,Doaba\n")
    schema = T.StructType([T.StructField("district", T.StringType()), T.StructField("zone", T.StringType())])
    assert tables.read_dimension_csv(spark, str(tmp_path / "d.csv"), schema).count() == 2
    cfg = tables.config_table(
        spark, [{"id": "A", "season": [4, 5]}, {"id": "B", "season": [10]}],
        T.StructType([T.StructField("id", T.StringType()), T.StructField("season", T.ArrayType(T.IntegerType()))]),
    )
    assert {r["s"] for r in cfg.select(tables.season_text("season").alias("s")).collect()} == {"4,5", "10"}
    df = spark.createDataFrame([("state", "x", 1.0), ("state", "y", float("nan"))], "level string, parent string, v double")
    sinks.write_nodes_json(df, str(tmp_path / "j"), ["level", "parent"])
    back = {r["parent"]: r["v"] for r in spark.read.schema("v double, level string, parent string").json(str(tmp_path / "j")).collect()}
    assert back == {"x": 1.0, "y": None}


def test_geojson_and_priority(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    one = {"features": [{"properties": {"ST_NM": "Pun jab", "District": "A-1"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}
    two = {"features": [
        {"properties": {"NAME_1": "Punjab", "NAME_2": "A1"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}},
        {"properties": {"NAME_1": "Punjab", "NAME_2": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}},
        {"properties": {"NAME_1": "Punjab"}, "geometry": None},
    ]}
    (tmp_path / "1.json").write_text(json.dumps(one))
    (tmp_path / "2.json").write_text(json.dumps(two))
    keys = (["st_nm", "name_1"], ["district", "name_2"])
    a = tables.read_geojson(spark, str(tmp_path / "1.json"), *keys, "official")
    b = tables.read_geojson(spark, str(tmp_path / "2.json"), *keys, "older")
    m = {r["district_key"]: r for r in tables.first_source_wins([a, b], ["state_key", "district_key"]).collect()}
    assert m["a1"]["source"] == "official" and len(m["a1"]["rings"]) == 1
    assert m["b"]["source"] == "older" and len(m["b"]["rings"]) == 3


def test_fallback_is_stamped(spark):
    empty, full = spark.range(0), spark.range(2)
    assert {r["mode"] for r in tables.primary_or_fallback(empty, full).collect()} == {"synthetic"}
    assert {r["provenance"] for r in tables.primary_or_fallback(full, empty).collect()} == {"real"}


def test_scalars(spark):
    r = spark.range(1).select(
        X.clip(F.lit(None).cast("double"), 0, 1).alias("n"), X.clip(F.lit(7.0), 0, 1).alias("c"), X.guarded_ratio(F.lit(1.0), F.lit(0.0)).alias("g"),
        X.right_closed_bin(F.lit(0.25), [-0.01, 0.25, 0.6], ["a", "b"]).alias("b"), X.amount_text(F.lit(2.5e8)).alias("cr"),
        X.amount_text(F.lit(12345.0), " u").alias("k"), X.amount_text(F.lit(3.14159)).alias("d"), X.signed_text(F.lit(1.25), 1).alias("s"), X.slug(F.lit("A b-C")).alias("sl"),
        X.amount_text(F.lit(5000.0), money=True).alias("m"),
    ).first()
    assert r["n"] is None and r["c"] == 1.0 and r["g"] == 0.0 and r["b"] == "a"
    assert (r["cr"], r["k"], r["d"], r["sl"], r["m"]) == ("₹25 cr", "12,345 u", "3.1", "a_b_c", "₹5,000")


def test_band_overlap(spark):
    o = I.band_overlap(F.lit(30.0), F.lit(50.0), C.POWER_BANDS, F.lit(False))
    r = spark.range(1).select(*o).first()
    assert list(r) == pytest.approx([1 / 3, 1.0, 1 / 3, 0.0])


def test_weights_without_estimates_are_the_prior(spark, sf):
    w = I.resolve_weights(roles.products(spark, sf), C.PRIOR, {}, {}, None, C.REGRESSOR_FACTOR)
    assert w.where("origin <> 'prior'").count() == 0
    one = {r["factor"]: r["weight"] for r in w.where("sku_id = 'Brand#1:PROMO'").collect()}
    pos = sum(v for v in C.PRIOR.values() if v > 0)
    assert one["F3"] == pytest.approx(C.PRIOR["F3"] / pos) and one["F8"] == C.PRIOR["F8"]

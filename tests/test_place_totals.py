"""Totals and top product of each place: pairs are not sorted, ties and missing potentials as by a plain sort."""

import math

from geodemand.plans import insight as IN
from geodemand.plans import scoring as SC


def test_pairs_are_folded_without_a_sort(spark, sf):
    plan = IN._place_totals(SC.scores(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and "HashAggregate" in plan


def test_top_product_with_ties_and_missing_potentials(spark, monkeypatch):
    rows = [
        (1, "b", "x", 2.0), (1, "a", "y", 2.0000000001), (1, "c", "x", 1.0),  # a tie after rounding
        (2, "b", "x", None), (2, "a", "y", 9.0), (2, "d", "y", None),  # a row without a potential comes first
        (3, "a", "x", math.nan), (3, "b", "y", 0.0), (4, "a", "x", math.nan),
    ]
    cols = "place_id long, sku_id string, category string, potential_units_yr double"
    s = spark.createDataFrame(rows, cols)
    for m in IN.TOTALS:
        s = s if m == "potential_units_yr" else s.withColumn(m, s.potential_units_yr)
    monkeypatch.setattr(SC, "scored_places", lambda *a: s.select("place_id").distinct())
    monkeypatch.setattr(SC, "scores", lambda spark, sf, places, carry: s.join(places, "place_id"))
    t = IN._place_totals(s)
    assert {r.place_id: r["_t"].sku_id for r in IN._tops(spark, "", t).collect()} == {1: "a", 2: "b", 3: "b", 4: "a"}
    assert {r.place_id: r.potential_units_yr for r in t.where("place_id < 2").collect()} == {1: 5.0}


def test_pairs_are_not_rounded_one_by_one(spark):
    """Rounding a double costs as much as the rest of a pair; large, tiny and negative potentials keep their order and top."""
    r = [1e15 + 0.3, 1e15 + 0.2, 5e-10, 4e-10, -5e-10, 2.00000000049, 2.0000000005, -7.5, 1e300, math.inf]
    rows = [(p, f"s{i % 3}", "x", v) for p, (a, b) in enumerate((a, b) for a in r for b in r) for i, v in enumerate((a, b, a))]
    s = spark.createDataFrame(rows, "place_id long, sku_id string, category string, potential_units_yr double")
    for m in IN.TOTALS:
        s = s if m == "potential_units_yr" else s.selectExpr("*", f"0.0 AS {m}")
    t = IN._place_totals(s)
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert "round(min(-potential_units_yr" in plan and "min(-round(" not in plan
    s.createOrReplaceTempView("pairs_of_totals")
    want = spark.sql("SELECT place_id, min(-round(potential_units_yr, 9)) AS w FROM pairs_of_totals GROUP BY 1")
    assert t.join(want, "place_id").where("_least <=> w").count() == len(r) ** 2

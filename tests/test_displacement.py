"""Displacement between own products: folded inside a place's row, the same as a direct reading of the rule."""

import random
from collections import defaultdict

import pytest

from geodemand.operators import choice as H


def case(spark, seed=3):
    r = random.Random(seed)
    skus = [f"s{i}" for i in range(12)]
    units = [(p, s, r.choice([0.0, 0.5, 2.0, 2.0, r.random() * 9])) for p in range(200) for s in skus if r.random() < 0.6]
    pairs = [(a, b, r.choice([0.3, 0.55, 0.7, 0.99]), r.random() * 9 + 1, r.random() * 9 + 1) for i, a in enumerate(skus) for b in skus[i + 1 :] if r.random() < 0.5]
    return units, pairs, spark.createDataFrame(units, "place_id long, sku_id string, units double").repartition(4), spark.createDataFrame(
        pairs, "sku_a string, sku_b string, overlap double, price_a double, price_b double")


def by_hand(units, pairs, cut=0.55, rate=0.45):
    at = defaultdict(dict)
    for p, s, u in units:
        at[p][s] = u
    lost, moved = defaultdict(float), defaultdict(lambda: [0, 0.0])
    for m in at.values():
        retain = defaultdict(lambda: 1.0)
        for a, b, o, _, _ in pairs:
            if o >= cut and a in m and b in m:
                ua, ub, f = m[a], m[b], o * rate
                loser, own = (a, ua) if ua <= ub + 1e-12 else (b, ub)
                if own > 0:
                    retain[loser] *= 1 - min(1.0, max(0.0, min(ua, ub) / max(own, 1e-9) * f))
                moved[a, b][0] += min(ua, ub) > 0.01
                moved[a, b][1] += min(ua, ub) * f
        for s, k in retain.items():
            lost[s] += m[s] * (1 - k)
    return {s: v for s, v in lost.items() if v > 0}, {k: v for k, v in moved.items() if v[1] >= 1.0}


@pytest.mark.parametrize("beside", [100_000, 0])
def test_displacement(spark, monkeypatch, beside):
    """Beyond so many hot pairs they are joined; the result is the same."""
    monkeypatch.setattr(H, "PAIRS_BESIDE_A_ROW", beside)
    units, pairs, u, p = case(spark)
    lost, moved = by_hand(units, pairs)
    got = {r.sku_id: r.displaced_units for r in H.displacement_by_item(u, p).collect()}
    assert got == pytest.approx(lost) and len(lost) > 8
    rows = {(r.sku_a, r.sku_b): [r.places_affected, r.displaced_units] for r in H.displacement_by_pair(u, p).collect()}
    assert rows.keys() == moved.keys() and all(rows[k] == pytest.approx(moved[k]) for k in rows)


def test_displacement_without_hot_pairs(spark):
    _, _, u, p = case(spark)
    assert H.displacement_by_item(u, p.where("overlap > 2")).count() == 0


def test_no_join_of_the_fact_with_itself(spark):
    _, _, u, p = case(spark)
    plan = H._pairs_in_row(u, p.selectExpr("sku_a", "sku_b", "overlap AS frac"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("place_id") > 0 and plan.count("Join") == 1  # the one with the numbers of the products

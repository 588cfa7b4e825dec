"""The combined scenario against plain Python, and its parts against the single scenarios."""

import math

import pytest
from pyspark.sql import functions as F

from geodemand.config import FACTORS
from geodemand.operators import scenario as X


@pytest.fixture(scope="module")
def made(spark):
    """Three groups, the last without slopes; a product whose old index is nil in one place."""
    scores = [(p, f"s{k}", f"c{k % 2}", p % 3, 10.0 * p + k, 100.0 * p + k) for p in range(1, 7) for k in range(3)]
    factors = [(p, *[(7.0 * p * (i + 1)) % 100 if p != 4 else 0.0 for i in range(len(FACTORS))]) for p in range(1, 7)]
    weights = [(f"s{k}", *[(0.1 + 0.05 * ((k + i) % 4)) * (-1 if i == 2 else 1) for i in range(len(FACTORS))]) for k in range(3)]
    betas = [(0, "x", 0.2, 0.05), (1, "x", -0.1, 0.02), (0, "y", 0.3, 0.1), (1, "y", 0.1, 0.2)]
    return {
        "scores": spark.createDataFrame(scores, "place_id long, sku_id string, category string, g long, potential_units_yr double, potential_value double"),
        "factors": spark.createDataFrame(factors, "place_id long, " + ", ".join(f"{f} double" for f in FACTORS)),
        "weights_wide": spark.createDataFrame(weights, "sku_id string, " + ", ".join(f"w_{f} double" for f in FACTORS)),
        "betas": spark.createDataFrame(betas, "g long, regressor string, beta double, se double"),
        "parents": spark.createDataFrame([(0, 8), (1, 8), (2, 9)], "g long, top long"),
        "rows": (scores, factors, weights, betas),
    }


def by_hand(rows, weights, shocks, wanted):
    scores, factors, old, betas = rows
    fac = {r[0]: r[1:] for r in factors}
    out = {}
    for place, sku, category, g, units, _ in scores:
        if not wanted(sku, category, g):
            continue
        w = dict(zip(FACTORS, next(r[1:] for r in old if r[0] == sku), strict=True))
        n = {**w, **weights}
        pos = sum(max(v, 0) for v in n.values()) or 1.0
        a = sum(x / 100 * v for x, v in zip(fac[place], w.values(), strict=True))
        b = sum(x / 100 * v / pos for x, v in zip(fac[place], n.values(), strict=True))
        k = b / a if weights and a > 1e-9 else 1.0
        log, var = 0.0, 0.0
        for r, sd in shocks.items():
            mine = [x for x in betas if x[1] == r and x[0] == g] or [x for x in betas if x[1] == r]
            log += sum(x[2] for x in mine) / len(mine) * sd
            var += (sum(x[3] for x in mine) / len(mine) * sd) ** 2
        new = units * k * math.exp(log)
        u = out.setdefault(8 if g < 2 else 9, [0.0] * 4)
        for i, v in enumerate((units, new, new * math.exp(-1.645 * math.sqrt(var)), new * math.exp(1.645 * math.sqrt(var)))):
            u[i] += v
    return out


def run(made, **how):
    parts = {k: v for k, v in made.items() if k != "rows"}
    got = X.combined(**parts, group="g", level="top", **how).collect()
    return {r.top: [r.units_base, r.units_scenario, r.units_lo, r.units_hi] for r in got}


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-6)


def test_weights_and_shocks(made):
    weights, shocks = {FACTORS[0]: 0.5, FACTORS[3]: 0.0}, {"x": -1.5, "y": 0.5}
    every = lambda *_: True
    close(run(made, weights=weights, shocks=shocks), by_hand(made["rows"], weights, shocks, every))
    close(run(made, shocks=shocks), by_hand(made["rows"], {}, shocks, every))
    close(run(made, weights=weights), by_hand(made["rows"], weights, {}, every))
    close(run(made), by_hand(made["rows"], {}, {}, every))


def test_scope(made):
    weights, shocks = {FACTORS[1]: 0.4}, {"x": 1.0}
    close(run(made, weights=weights, shocks=shocks, scope=F.col("sku_id") == "s1"), by_hand(made["rows"], weights, shocks, lambda s, c, g: s == "s1"))
    close(run(made, weights=weights, shocks=shocks, scope=F.col("category") == "c0", within=F.col("top") == 8), by_hand(made["rows"], weights, shocks, lambda s, c, g: c == "c0" and g < 2))
    assert run(made, weights=weights, shocks=shocks, scope=F.col("sku_id") == "none") == {}


def test_unknown_names_are_refused(made):
    with pytest.raises(ValueError, match="unknown factors"):
        run(made, weights={"F99": 1.0})
    with pytest.raises(ValueError, match="no slopes for"):
        run(made, shocks={"nothing": 1.0, "x": 1.0})

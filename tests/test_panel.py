"""The grouped fit: recovery of known slopes, additivity, short series, and its twins in SQL form."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geodemand.operators import panel as P

TRUE = {"x1": 0.18, "x2": -0.12, "x3": 0.06}


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(11)
    rows = []
    for g in range(6):
        n = 120 if g < 5 else 40
        t = np.arange(n)
        x = rng.normal(size=(n, 3))
        ly = 5 + 0.004 * t + 0.2 * np.sin(2 * np.pi * t / 12) + 0.05 * np.sin(2 * np.pi * t / 46) + x @ np.array(list(TRUE.values())) + rng.normal(0, 0.05, n)
        m = pd.date_range("2015-01-01", periods=n, freq="MS").date
        rows.append(pd.DataFrame({"g": g, "month": m, "y": np.exp(ly), "x1": x[:, 0], "x2": x[:, 1], "x3": x[:, 2]}))
    return pd.concat(rows, ignore_index=True)


@pytest.fixture(scope="module")
def fits(spark, series):
    f = P.fit_groups(spark.createDataFrame(series), "g", "month", "y", list(TRUE))
    f.cache()
    return f


def test_short_series_is_reported(fits):
    r = {x["group_id"]: x for x in P.diagnostics(fits).collect()}
    assert not r["5"]["ok"] and r["5"]["reason"] == "only 40 obs"
    assert all(r[str(g)]["ok"] for g in range(5))


def test_known_slopes_are_recovered(fits, series):
    b = P.fitted_betas(fits, {"x1": "positive", "x2": "negative", "x3": "positive"}).toPandas()
    sd = series[series.g < 5].groupby("g")[list(TRUE)].std(ddof=0)
    hits = 0
    for r in b.itertuples():
        true = TRUE[r.regressor] * sd.loc[int(r.group_id), r.regressor]
        assert abs(r.beta - true) < 0.03
        hits += r.ci_low <= true <= r.ci_high
    assert hits / len(b) > 0.7
    assert b["sign_ok"].all() and b["usable"].mean() > 0.9


def test_components_add_up(fits):
    d = P.decomposition(fits, list(TRUE)).toPandas()
    total = d[["trend", "seasonal", "cycle", "regression", "irregular"]].sum(axis=1)
    np.testing.assert_allclose(total, d["observed_log"], atol=1e-9)
    np.testing.assert_allclose(d[[f"contrib_{r}" for r in TRUE]].sum(axis=1), d["regression"], atol=1e-9)
    per_year = d[d.group_id == "0"].head(12)["seasonal"].sum()
    assert abs(per_year) < 1e-6


def test_beats_naive_and_fits(fits):
    d = P.diagnostics(fits).where("ok").toPandas()
    assert d["beats_snaive"].all() and (d["r2_like"] > 0.8).all()


def test_partialled_slope_equals_joint_regression(spark, series):
    one = series[series.g < 2]
    e = P.elasticities(spark.createDataFrame(one), "g", "month", "y", ["x1"]).toPandas().set_index("g")
    for g, s in one.groupby("g"):
        moy = pd.to_datetime(s.month).dt.month
        a = np.column_stack([pd.get_dummies(moy).to_numpy(float), s.x1])
        coef, *_ = np.linalg.lstsq(a, np.log(s.y), rcond=None)
        resid = np.log(s.y) - a @ coef
        se = np.sqrt(resid @ resid / (len(s) - 13) * np.linalg.inv(a.T @ a)[-1, -1])
        assert e.loc[g, "beta"] == pytest.approx(coef[-1]) and e.loc[g, "se"] == pytest.approx(se)


def test_vif_of_unrelated_and_collinear(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=500)
    df = pd.DataFrame({"a": a, "b": a + rng.normal(0, 0.1, 500), "c": rng.normal(size=500)})
    v = {r["regressor"]: r for r in P.variance_inflation(spark.createDataFrame(df), ["a", "b", "c"]).collect()}
    assert v["a"]["above_threshold"] and v["b"]["above_threshold"] and not v["c"]["above_threshold"]
    x = np.column_stack([np.ones(500), df.b, df.c])
    r2 = 1 - np.var(df.a - x @ np.linalg.lstsq(x, df.a, rcond=None)[0]) / np.var(df.a)
    assert v["a"]["vif"] == pytest.approx(1 / (1 - r2), rel=1e-6)


def gappy(series):
    """The series without some months of every group, the last year's and its forerunners' among them."""
    n = series.groupby("g").cumcount()
    size = series.groupby("g")["month"].transform("size")
    return series[~n.isin([7, 30, 31]) & ~(size - n).isin([3, 17, 20])]


def test_lags_count_months_not_rows(spark, series):
    p = gappy(series)
    df = spark.createDataFrame(p).repartition(3)
    dense = P.every_month(df, "g", "month").toPandas()
    assert len(dense) == len(series) and dense["y"].notna().sum() == len(p)
    naive = {r.g: (r.snaive_mape, r.n) for r in P.seasonal_naive(df, "g", "month", "y").collect()}
    rho = {r.g: r for r in P.autocorrelations(df.withColumn("e", F.log("y")), "g", "month", "e").collect()}
    for g, rows in p.groupby("g"):
        y = {pd.Period(m, "M"): v for m, v in zip(rows["month"], rows["y"])}
        last = max(y)
        err = [abs(v - y[m - 12]) / v for m, v in y.items() if m > last - 12 and m - 12 in y]
        assert naive[g] == (pytest.approx(np.mean(err) * 100), len(err)) and len(err) in (7, 9)
        mean = np.mean(np.log(list(y.values())))
        e = {m: np.log(v) - mean for m, v in y.items()}
        total = sum(v * v for v in e.values())
        for k in (1, 5, 12):
            assert rho[g][f"rho_{k}"] == pytest.approx(sum(v * e[m - k] for m, v in e.items() if m - k in e) / total)
        assert rho[g]["n"] == len(y)


def test_fit_of_a_series_with_gaps(spark, series):
    p = gappy(series)
    f = {r.group_id: r for r in P.diagnostics(P.fit_groups(spark.createDataFrame(p), "g", "month", "y", list(TRUE))).collect()}
    naive = {str(r.g): r.snaive_mape for r in P.seasonal_naive(spark.createDataFrame(p), "g", "month", "y").collect()}
    for g in "01234":
        assert f[g].ok and f[g].snaive_mape == pytest.approx(naive[g]) and f[g].beats_snaive

"""Ranks and quantiles against pandas, also where one value or group holds a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geodemand.operators import ranking as RK
from geodemand.operators.skew import hot_keys, salted_join


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    n = 3000
    g = np.where(rng.random(n) < 0.4, "big", rng.integers(0, 40, n).astype(str))
    v = np.where(rng.random(n) < 0.35, 0.0, np.round(rng.normal(0, 5, n), 2))
    v[:20] = np.nan
    return pd.DataFrame({"id": np.arange(n), "g": g, "v": v})


def nulls(df):
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_pct_rank_is_pandas_average_rank(spark, skewed, by):
    df = nulls(spark.createDataFrame(skewed))
    got = RK.pct_rank(df, "v", "id", by).toPandas().sort_values("id")["pct"].to_numpy(float)
    s = skewed.groupby("g")["v"] if by else skewed["v"]
    want = s.rank(pct=True, na_option="keep").to_numpy() * 100
    np.testing.assert_allclose(got, want, rtol=0, atol=1e-9)


def test_descending_rank_is_truncated(spark, skewed):
    df = nulls(spark.createDataFrame(skewed)).where("v is not null")
    got = RK.ranked(df, "v", ["g"], "id", r=RK.descending_rank()).toPandas().set_index("id")["r"].sort_index()
    want = skewed.dropna().groupby("g")["v"].rank(ascending=False).astype(int)
    assert (got.to_numpy() == want.to_numpy()).all()


def test_quantiles_are_linear(spark, skewed):
    df = nulls(spark.createDataFrame(skewed))
    got = RK.quantiles(df, "v", ["g"], {"a": 0.1, "m": 0.5, "z": 0.9}).toPandas().set_index("g").sort_index()
    want = skewed.groupby("g")["v"].quantile([0.1, 0.5, 0.9]).unstack()
    np.testing.assert_allclose(got[["a", "m", "z"]].to_numpy(float), want.to_numpy(), atol=1e-9)


def test_no_cut_holds_a_whole_group(spark):
    """The hot group of distinct values is cut like the rest."""
    df = spark.range(20000).select(F.lit("hot").alias("g"), F.rand(1).alias("v"))
    t = RK.ordered_counts(df, "v", ["g"])
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "_cut" in plan
    assert t.count() == 20000
    last = t.agg(F.max(F.col(RK.N_BEFORE) + F.col(RK.N_TIES)), F.max(RK.N_GROUP)).first()
    assert last[0] == last[1] == 20000


def test_robust_scale_and_zscore(spark, skewed):
    d = skewed.dropna()
    df = spark.createDataFrame(d)
    z = RK.robust_scale(df, "id", ["v"]).toPandas().sort_values("id")["v_z"].to_numpy()
    med, iqr = d.v.median(), d.v.quantile(0.75) - d.v.quantile(0.25)
    np.testing.assert_allclose(z, np.clip((d.v - med) / iqr, -5, 5), atol=1e-9)
    p = RK.zscores(df, ["v"], ["g"]).toPandas().sort_values("id")["v_z"].to_numpy()
    want = d.groupby("g")["v"].transform(lambda s: (s - s.mean()) / s.std()).fillna(0)
    np.testing.assert_allclose(p, want, atol=1e-9)


def test_salted_join_loses_nothing(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    table = spark.range(50).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    rows = rows.withColumn("k", F.col("k").cast("int"))
    hot = hot_keys(rows.groupBy("k").count(), ["k"], "count")
    assert hot is not None and [r["h_k"] for r in hot.collect()] == [7]
    out = salted_join(rows, table, ["k"], hot, ["id"])
    assert out.count() == 5000
    assert out.where("v <> k * 2").count() == 0


def test_hierarchical_ids_keep_long_numbers_and_large_keys(spark):
    """More children than the width has digits for, keys above 2^53, and text keys."""
    from geodemand.sources.tables import hierarchical_ids

    many = spark.range(100_005).selectExpr("'p' AS parent", "id + 9007199254740992 AS k")
    few = spark.range(7).selectExpr("'q' AS parent", "id AS k")
    out = hierarchical_ids(many.unionByName(few), "parent", "k", "V", 5, "hid")
    assert out.select("hid").distinct().count() == out.count() == 100_012
    rows = {r.k: r.hid for r in out.where("k >= 9007199254840992 OR parent = 'q'").collect()}
    assert rows[9007199254740992 + 100_000] == "pV100001" and rows[6] == "qV00007"
    names = hierarchical_ids(spark.createDataFrame([("p", "b"), ("p", "a"), ("r", "c")], "parent string, k string"), "parent", "k", "-", 2, "hid")
    assert {r.k: r.hid for r in names.collect()} == {"a": "p-01", "b": "p-02", "c": "r-01"}


def test_finder_refuses_a_limit_it_cannot_keep(spark):
    from geodemand.operators.insights import find

    with pytest.raises(ValueError):
        find(spark.range(1), {}, limit=5000)


def test_ranks_of_many_metrics_and_scopes(spark):
    """Ties, null and NaN values, rows without a scope and repeated keys, in both scopes."""
    rng = np.random.default_rng(5)
    n = 4000
    t = pd.DataFrame({
        "id": np.r_[np.arange(n - 5), np.arange(5)], "g": rng.choice(["a", "b", "c", None], n),
        "u": np.where(rng.random(n) < 0.4, 0.0, rng.normal(0, 1, n)), "v": rng.integers(0, 3, n) * -1.0, "w": np.full(n, np.nan),
    })
    t.loc[::50, "u"] = np.nan
    df = spark.createDataFrame(t).withColumn("row", F.monotonically_increasing_id()).withColumn("u", F.when(F.col("id") % 100 != 0, F.col("u")))
    back = df.toPandas()
    got = RK.pct_ranks(df, "row", ["u", "v", "w"], {"all": None, "inside": "g"}).toPandas().set_index(["metric", "scope", "row"])["pct"]
    assert len(got) == 6 * n and got.index.is_unique
    for m in ("u", "v", "w"):
        s = back.set_index("row")[m]
        np.testing.assert_array_equal(got[m, "all"][s.index].to_numpy(float), (s.rank(pct=False) / s.count() * 100).to_numpy(float))
        by = back.set_index("row").groupby("g")[m]
        want = (by.rank() / by.transform("count") * 100).reindex(s.index)
        np.testing.assert_allclose(got[m, "inside"][s.index].to_numpy(float), want.to_numpy(float), rtol=0, atol=1e-12)


def test_cells_of_ranks_move_once_and_those_of_a_hot_value_not_at_all(spark, tmp_path):
    df = spark.range(20_000).select("id", (F.col("id") % 4).alias("g"), F.when(F.col("id") % 2 == 0, 7.0).otherwise(F.col("id")).alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        r = RK.scope_ranks(df, "id", ["v"], {"all": None, "state": "g"})
        plan = r._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("hashpartitioning(_m") == 1 and plan.count("SortMergeJoin") == 0
    assert r.where("id % 2 = 0").agg(F.countDistinct("pct_all")).first()[0] == 1


def test_place_without_any_value_keeps_its_row(spark):
    from geodemand.operators import indices as I

    f = spark.createDataFrame([(1, 1, 2.0, 5.0), (2, 1, 3.0, None), (3, None, 4.0, 5.0), (4, 2, None, None)], "id long, s int, a double, b double")
    got = {r.id: r for r in I.factor_index(f, "id", "s", {"F": [("a", 0.75, "positive"), ("b", 0.25, "negative")]}).collect()}
    assert got[4].F is None and got[4].F_state is None and got[3].F_state is None
    assert got[1].F == pytest.approx(0.75 * 100 / 3 + 0.25 * 25) and got[2].F_state == pytest.approx(75.0)


def test_ranked_rows_move_once(spark, skewed):
    """Ties, null and infinite values, rows without a group and repeated keys; one move of the rows, and no table as long as they are."""
    t = pd.concat([skewed, skewed.head(300)], ignore_index=True)
    t["g"] = t["g"].where(t.index % 17 != 0, None)
    t.loc[::41, "v"] = np.inf
    t.loc[::43, "v"] = -np.inf
    t.loc[::47, "v"] = -0.0
    t.loc[::9, "v"] = np.nan
    t["row"] = np.arange(len(t))
    df = nulls(spark.createDataFrame(t))
    got = RK.ranked(df, "v", ["g"], "id", r=RK.average_rank(), n=F.col(RK.N_GROUP), t=F.col(RK.N_TIES)).toPandas().set_index("row").sort_index()
    t = t.set_index("row")
    by = t.dropna(subset=["g", "v"]).groupby("g")["v"]
    assert len(got) == len(t)
    np.testing.assert_array_equal(got["r"].to_numpy(float), by.rank().reindex(t.index).to_numpy(float))
    np.testing.assert_array_equal(got["n"].to_numpy(float), by.transform("count").reindex(t.index).to_numpy(float))
    ties = t.assign(v=t["v"] + 0.0).dropna(subset=["g", "v"]).groupby(["g", "v"])["v"].transform("count")
    np.testing.assert_array_equal(got["t"].to_numpy(float), ties.reindex(t.index).to_numpy(float))

    many = spark.range(30_000).select("id", (F.col("id") % 5).alias("g"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id")).alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = RK.ranked(many, "v", ["g"], "id", r=RK.average_rank())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("REPARTITION_BY_NUM" in line for line in moved) == 1 and len(moved) <= 3

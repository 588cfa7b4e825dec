"""Many k-means fits in the same rounds."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from geodemand.operators import many_means as M
from geodemand.operators import segments as G


def blobs(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, f"g{i % 3}", [float(v) for v in rng.normal(0, 0.3, 2) + (np.array([[0, 0], [8, 0], [0, 8], [8, 8]])[i % 7 % 4] + 20 * (i % 3))]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, grp string, x array<double>").repartition(4)


def test_groups_are_fitted_apart_and_numbered_by_size(spark):
    rows, df = blobs(spark)
    points = M.points_of(df, "id", F.col("x"), "grp")
    models = [M.Model(f"g{i}", 4, group=f"g{i}") for i in range(3)] + [M.Model("all", 3)]
    centres = M.fit(points, models)
    labels = {(r.id, r.model): r.cluster for r in M.assign(points, models, centres).collect()}
    assert len(labels) == 2 * len(rows)
    for i, g, x in rows:
        for name, c in ((g, centres[int(g[1])]), ("all", centres[3])):
            assert labels[i, name] == int(((c - np.array(x)) ** 2).sum(1).argmin())
    for g in range(3):
        mine = [np.array(x) for i, h, x in rows if h == f"g{g}"]
        at = np.array([labels[i, h] for i, h, _ in rows if h == f"g{g}"])
        sizes = np.bincount(at)
        assert len(sizes) == 4 and (np.diff(sizes) <= 0).all()
        assert np.allclose([np.mean([x for x, a in zip(mine, at) if a == j], 0) for j in range(4)], centres[g], atol=1e-6)


def test_quality_agrees_with_the_library(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator

    _, df = blobs(spark, 200)
    points, models = M.points_of(df, "id", F.col("x")), [M.Model("a", 5), M.Model("b", 3)]
    centres = M.fit(points, models)
    found = M.quality(points, models, centres)
    for m, q in zip(models, found):
        p = M.assign(points, models, centres).where(F.col("model") == m.name).join(df, "id").select("cluster", array_to_vector("x").alias("features"))
        assert q[0] == pytest.approx(ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(p))
        assert q[4] == pytest.approx(1.0)


def test_resamples_have_poisson_weights_and_a_rerun_draws_the_same(spark):
    df = spark.range(20_000).select("id", F.array(F.col("id").cast("double")).alias("x"))
    w = M.points_of(df, "id", F.col("x"), resamples=3).select(F.explode("_w").alias("w")).groupBy("w").count().collect()
    n = {r["w"]: r["count"] / 60_000 for r in w}
    assert sum(k * v for k, v in n.items()) == pytest.approx(1.0, abs=0.02) and n[0] == pytest.approx(np.exp(-1), abs=0.01)


def test_stability_of_clear_and_of_no_segments(spark):
    _, df = blobs(spark)
    vec = df.where("grp = 'g0'").select("id", array_to_vector("x").alias("features"))
    assert min(r.ari for r in G.stability(vec, 4, 3).collect()) > 0.99
    noise = spark.range(400).select("id", array_to_vector(F.array(*[(F.xxhash64("id", F.lit(j)) % 1000).cast("double") for j in range(6)])).alias("features"))
    assert max(r.ari for r in G.stability(noise, 8, 3).collect()) < 0.9


def test_jobs_do_not_grow_with_the_models(spark):
    _, df = blobs(spark)
    points = M.points_of(df, "id", F.col("x"), "grp", resamples=8)
    jobs = []
    for models in ([M.Model("r0", 2, resample=0)], [M.Model(f"r{b}", 2 + b, resample=b) for b in range(8)]):
        group = f"jobs of {len(models)}"
        spark.sparkContext.setJobGroup(group, group)
        M.fit(points, models, max_iter=3, tolerance=-1.0)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1]


def test_few_points(spark):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, "a", [1.0]), (3, "b", [2.0])], "id long, grp string, x array<double>")
    points, models = M.points_of(df, "id", F.col("x"), "grp"), [M.Model("a", 3, group="a"), M.Model("b", 2, group="b"), M.Model("none", 2, group="c")]
    centres = M.fit(points, models)
    assert [len(c) for c in centres] == [1, 1, 0]
    assert {r.id: r.cluster for r in M.assign(points, models, centres).collect()} == {1: 0, 2: 0, 3: 0}

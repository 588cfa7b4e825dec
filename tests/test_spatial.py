"""Spatial joins against brute force, with co-located points and a crowded corner."""

import numpy as np
import pandas as pd
import pytest

from geodemand.operators import spatial as S


def points(n, seed, crowd=0.0, twins=0):
    rng = np.random.default_rng(seed)
    lon, lat = 70 + rng.random(n) * 20, 10 + rng.random(n) * 25
    dense = rng.random(n) < crowd
    lon[dense], lat[dense] = 75 + rng.random(dense.sum()) * 0.01, 20 + rng.random(dense.sum()) * 0.01
    lon[:twins], lat[:twins] = 80.0, 22.0
    return pd.DataFrame({"id": np.arange(n), "g": rng.integers(0, 3, n), "lon": lon, "lat": lat, "val": rng.normal(size=n)})


def dist(a, b):
    dx = a[:, None, 0] * 95.0 - b[None, :, 0] * 95.0
    dy = a[:, None, 1] * 111.0 - b[None, :, 1] * 111.0
    return np.sqrt(dx * dx + dy * dy)


def brute_lists(df, k):
    out = {}
    for _, g in df.groupby("g"):
        d = dist(g[["lon", "lat"]].to_numpy(), g[["lon", "lat"]].to_numpy())
        ids = g["id"].to_numpy()
        for i, row in enumerate(d):
            order = np.lexsort((ids, row))[: k + 1]
            out[ids[i]] = [(round(row[j], 6), ids[j]) for j in order]
    return out


@pytest.mark.parametrize("crowd,twins", [(0.0, 0), (0.5, 40)])
def test_knn_lists(spark, crowd, twins):
    df = points(900, 5, crowd, twins)
    got = S.knn_lists(spark.createDataFrame(df), "id", ["g"], 6, ["val"]).toPandas()
    want = brute_lists(df, 6)
    assert len(got) == len(df)
    for r in got.itertuples():
        assert [(round(n["d"], 6), n["id"]) for n in r.near] == want[r.id]


def test_knn_with_small_segments(spark, monkeypatch):
    """Many curve segments give the same neighbours."""
    monkeypatch.setattr(S, "SEGMENT_ROWS", 20)
    df = points(800, 9, 0.3)
    got = S.knn_lists(spark.createDataFrame(df), "id", ["g"], 4, []).toPandas()
    want = brute_lists(df, 4)
    assert all([(round(n["d"], 6), n["id"]) for n in r.near] == want[r.id] for r in got.itertuples())


def test_neighbour_mean_drops_zero_distance(spark):
    df = points(400, 2, 0, 25)
    got = S.neighbour_mean(spark.createDataFrame(df), "id", ["g"], ["val"], 5).toPandas().set_index("id")["peer_val"]
    val = df.set_index("id")["val"]
    for i, near in brute_lists(df, 5).items():
        far = [val[j] for d, j in near if d > 0]
        assert got[i] == pytest.approx(np.mean(far) if far else val.mean())


@pytest.mark.parametrize("cap", [None, 65.0])
def test_nearest(spark, cap):
    p, t = points(500, 1, 0.4), points(60, 8)
    t = t[t.g != 2] if cap else t
    got = S.nearest(spark.createDataFrame(p), "id", spark.createDataFrame(t.rename(columns={"id": "tid"})), "tid", ["g"], cap).toPandas()
    assert len(got) == len(p)
    for r in got.itertuples():
        c = t[t.g == r.g]
        if not len(c):
            assert r.near_km == cap and pd.isna(r.near_id)
            continue
        d = dist(np.array([[r.lon, r.lat]]), c[["lon", "lat"]].to_numpy())[0]
        if cap is not None and d.min() > cap:
            assert r.near_km == cap and pd.isna(r.near_id)
        else:
            assert r.near_km == pytest.approx(d.min()) and r.near_id == c["id"].to_numpy()[np.lexsort((c["id"], d))[0]]


def test_point_in_concave_polygon_with_hole(spark):
    p = points(600, 4)
    outer = [[70.0, 10.0], [90.0, 10.0], [90.0, 35.0], [80.0, 20.0], [70.0, 35.0]]
    hole = [[75.0, 12.0], [85.0, 12.0], [85.0, 15.0], [75.0, 15.0]]
    shapes = spark.createDataFrame([("a", [outer, hole])], "shape string, rings array<array<array<double>>>")
    got = set(S.in_polygon(spark.createDataFrame(p), shapes, "shape").toPandas()["id"])

    def inside(x, y):
        odd = False
        for ring in (outer, hole):
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                    odd = not odd
        return odd

    assert got == {r.id for r in p.itertuples() if inside(r.lon, r.lat)}


def test_ring_area(spark):
    shapes = spark.createDataFrame([("sq", [[[0.0, 0.0], [2.0, 0.0], [2.0, 3.0], [0.0, 3.0]]])], "shape string, rings array<array<array<double>>>")
    r = S.ring_measures(shapes, "shape").first()
    assert r["area"] == pytest.approx(6.0) and (r["x_max"], r["y_max"]) == (2.0, 3.0) and r["centre_x"] == pytest.approx(1.0)

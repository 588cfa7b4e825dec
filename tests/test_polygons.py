"""Points in polygons by clipped cells are those of the even-odd rule over all edges."""

import random

import pytest
from pyspark.sql import functions as F

from geodemand.operators import spatial as S


def inside(x, y, rings):
    odd = 0
    for r in rings:
        for i in range(len(r)):
            (x1, y1), (x2, y2) = r[i], r[(i + 1) % len(r)]
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd ^= 1
    return bool(odd)


def shapes_of(seed, n=14):
    """Stars, boxes with holes, self-crossing rings, several parts; corners on whole numbers among them."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y, size = r.uniform(-20, 20), r.uniform(-20, 20), r.choice([0.5, 3, 15])
        whole = r.random() < 0.4
        point = lambda: [float(round(v)) if whole else v for v in (x + r.uniform(-size, size), y + r.uniform(-size, size))]
        rings = [[point() for _ in range(r.choice([3, 4, 9, 60]))] for _ in range(r.choice([1, 1, 2, 3]))]
        if r.random() < 0.3:
            rings[0].append(list(rings[0][0]))
        out.append((i, [[[float(a) for a in p] for p in ring] for ring in rings]))
    return out


@pytest.mark.parametrize("seed,cell", [(1, None), (2, None), (3, 1.0), (4, 0.37), (5, 50.0)])
def test_points_in_polygons(spark, seed, cell):
    shapes, r = shapes_of(seed), random.Random(seed)
    corners = [p for _, rings in shapes for ring in rings for p in ring]
    points = [(i, r.uniform(-40, 40), r.uniform(-40, 40)) for i in range(300)] + [(1000 + i, *r.choice(corners)) for i in range(60)]
    points += [(2000 + i, r.choice(corners)[0], r.uniform(-30, 30)) for i in range(40)] + [(3000 + i, float(r.randint(-20, 20)), float(r.randint(-20, 20))) for i in range(80)]
    p = spark.createDataFrame(points, "id long, lon double, lat double").repartition(3)
    s = spark.createDataFrame(shapes, "shape int, rings array<array<array<double>>>")
    got = sorted((a.id, a["shape"]) for a in S.in_polygon(p, s, "shape", cell=cell).collect())
    assert got == sorted((i, k) for i, x, y in points for k, rings in shapes if inside(x, y, rings)) and len(got) > 50


def test_a_cell_holds_the_edges_that_reach_it_only(spark):
    """A round shape of 20,000 edges: cells on its border hold a few, those inside none, and none holds the list."""
    import math

    n = 20_000
    ring = [[100 * math.cos(2 * math.pi * i / n), 100 * math.sin(2 * math.pi * i / n)] for i in range(n)]
    cells = S.clipped_cells(spark.createDataFrame([(1, [ring])], "shape int, rings array<array<array<double>>>"), "shape")
    c = cells.agg(F.sum(F.size("_edges")).alias("listed"), F.max(F.size("_edges")).alias("most"), F.sum((F.size("_edges") == 0).cast("int")).alias("inner")).first()
    assert c.listed < 1.2 * n and c.most < n / 50 and c.inner > 2000


def test_no_shapes_and_no_points(spark):
    p = spark.createDataFrame([(1, 0.5, 0.5)], "id long, lon double, lat double")
    s = spark.createDataFrame([], "shape int, rings array<array<array<double>>>")
    out = S.in_polygon(p, s, "shape")
    assert out.count() == 0 and out.columns == ["id", "lon", "lat", "shape"]
    box = spark.createDataFrame([(1, [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]])], s.schema)
    assert S.in_polygon(p.limit(0), box, "shape").count() == 0 and S.in_polygon(p, box, "shape").count() == 1

"""Spatial joins: nearest, k nearest, point in polygon, neighbourhood aggregates.

Exact results without pairing every two points of a group. Each distinct location first gets an
upper bound on the radius it has to search, from its neighbours along a space-filling curve; the
disc of that radius is then covered by grid cells of its own scale and joined by cell key.
Co-located points are folded into one location beforehand, and cells that hold many locations
are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geodemand.config import KM_LAT, KM_LON
from geodemand.operators.ranking import top_n
from geodemand.operators.skew import hot_keys, salted_join
from geodemand.session import parallelism, save_table

# Locations per curve segment below which a group is not cut further.
SEGMENT_ROWS = 512


def planar(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Kilometre coordinates."""
    return df.withColumn("_x", F.col(lon) * KM_LON).withColumn("_y", F.col(lat) * KM_LAT)


def sq_dist(x1, y1, x2, y2) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return dx * dx + dy * dy


def _spread(v: Column) -> Column:
    """Space the low 24 bits of a number out to every second bit."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def curve_position(x: str = "_x", y: str = "_y") -> Column:
    """Position on a Z-order curve over +-20,000 km at 2.5 m resolution."""
    q = lambda c: F.floor((F.col(c) + 20000.0) * 400.0).cast("bigint")
    return _spread(q(x)).bitwiseOR(F.shiftleft(_spread(q(y)), 1))


def _segments(loc: DataFrame, by: list[str]) -> DataFrame:
    """Cut the curve of each group into segments of similar size; adds _seg and the group's extent."""
    ways = parallelism(loc.sparkSession)
    probs = [i / ways for i in range(1, ways)]
    g = loc.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_z", probs, max(10000, 100 * ways)).alias("_b"),
        F.min("_x").alias("_x0"), F.max("_x").alias("_x1"), F.min("_y").alias("_y0"), F.max("_y").alias("_y1"),
    )
    parts = F.greatest(F.lit(1), F.least(F.lit(ways), F.floor(F.col("_n") / SEGMENT_ROWS).cast("int")))
    g = g.withColumn("_parts", parts).withColumn(
        "_b",
        F.expr(f"CASE WHEN _parts > 1 THEN transform(sequence(1, _parts - 1), i -> _b[int(i * {ways} / _parts) - 1]) END"),
    )
    cut = loc.join(g, by)
    seg = F.coalesce(F.size(F.filter("_b", lambda b: b < F.col("_z"))), F.lit(0))
    return cut.withColumn("_seg", F.when(F.col("_b").isNull(), 0).otherwise(seg)).drop("_b", "_parts", "_n")


def _whole_extent() -> Column:
    """Squared distance to the farthest corner of the group's extent: a bound that always holds."""
    far = lambda v, a, b: F.greatest(F.abs(F.col(v) - F.col(a)), F.abs(F.col(v) - F.col(b)))
    dx, dy = far("_x", "_x0", "_x1"), far("_y", "_y0", "_y1")
    return (dx * dx + dy * dy) * (1 + 1e-9)


def _scale(r2: Column) -> Column:
    """Exponent of the cell side (a power of four kilometres) that matches a radius."""
    return F.ceil(F.log2(F.greatest(F.sqrt(r2), F.lit(0.001))) / 2).cast("int")


def _cell(v: Column, e: Column) -> Column:
    return F.floor(v / F.pow(F.lit(4.0), e)).cast("bigint")


def _disc_cells(q: DataFrame) -> DataFrame:
    """One row per grid cell that the search disc of a location touches."""
    r = F.sqrt("_r2") * (1 + 1e-9)
    e = F.col("_e")
    for v, c in (("_x", "_cx"), ("_y", "_cy")):
        q = q.withColumn(c, F.explode(F.sequence(_cell(F.col(v) - r, e), _cell(F.col(v) + r, e))))
    side = F.pow(F.lit(4.0), e)
    gap = lambda v, c: F.greatest(F.lit(0.0), F.col(c) * side - F.col(v), F.col(v) - (F.col(c) + 1) * side)
    dx, dy = gap("_x", "_cx"), gap("_y", "_cy")
    return q.where(dx * dx + dy * dy <= r * r * (1 + 1e-9))


def _within_disc(q: DataFrame, p: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of a search location and a target location inside its disc.

    q: by, _x, _y, _r2, _e. p: by, _px, _py and payload. Targets are keyed only at the scales
    that searches of their group use.
    """
    scales = q.groupBy(*by).agg(F.collect_set("_e").alias("_es"))
    t = p.join(scales, by).withColumn("_e", F.explode("_es"))
    t = t.withColumn("_cx", _cell(F.col("_px"), F.col("_e"))).withColumn("_cy", _cell(F.col("_py"), F.col("_e")))
    t = t.drop("_es")
    key = [*by, "_e", "_cx", "_cy"]
    crowded = hot_keys(t.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")), key, "_n")
    pairs = salted_join(t, _disc_cells(q), key, crowded, ["_px", "_py"])
    d = F.sqrt(sq_dist(F.col("_x"), F.col("_y"), F.col("_px"), F.col("_py")))
    return pairs.withColumn("_d", d).where(F.col("_d") <= F.sqrt("_r2")).drop("_cx", "_cy", "_e")


def knn_lists(points: DataFrame, key: str, by: list[str], k: int, payload: list[str]) -> DataFrame:
    """The k+1 nearest points of every point inside its group, itself and co-located ones included.

    Adds `near`: array of (d, id, payload...) sorted by distance then id.
    """
    n = k + 1
    pts = planar(points)
    at = [*by, "_x", "_y"]
    counts = pts.groupBy(*at).agg(F.count(F.lit(1)).alias("_here"))
    # A location never contributes more than its k+1 first points to anyone, itself included.
    members = (
        top_n(pts.select(*at, F.col(key).alias("id"), *payload), at, [F.col("id")], n)
        .groupBy(*at)
        .agg(F.collect_list(F.struct("id", *payload)).alias("_members"))
    )
    loc = counts.join(members, at).withColumn("_m", F.size("_members")).withColumn("_z", curve_position())
    seg = _segments(loc, by)
    w = Window.partitionBy(*by, "_seg").orderBy("_z", "_x", "_y").rowsBetween(-k, k)
    seg = seg.withColumn("_around", F.collect_list(F.struct("_x", "_y", "_m")).over(w))
    ordered = F.array_sort(
        F.transform(
            "_around",
            lambda s: F.struct(sq_dist(F.col("_x"), F.col("_y"), s["_x"], s["_y"]).alias("d"), s["_m"].alias("m")),
        )
    )
    reach = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("c"), F.lit(None).cast("double").alias("r")),
        lambda a, s: F.when(a["c"] >= n, a).otherwise(F.struct((a["c"] + s["m"]).alias("c"), s["d"].alias("r"))),
    )
    bound = F.when(reach["c"] >= n, reach["r"]).otherwise(_whole_extent())
    q = seg.withColumn("_r2", bound).withColumn("_e", _scale(F.col("_r2")))
    q = save_table(q.select(*at, "_here", "_members", "_r2", "_e"), "knn")

    p = q.select(*by, F.col("_x").alias("_px"), F.col("_y").alias("_py"), "_members")
    pairs = _within_disc(q.select(*at, "_r2", "_e"), p, by)
    cand = pairs.select(*at, "_d", F.explode("_members").alias("_c")).select(*at, "_d", "_c.*")
    best = top_n(cand, at, [F.col("_d"), F.col("id")], n)
    near = best.groupBy(*at).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_d").alias("d"), "id", *payload))).alias("near")
    )
    hot = hot_keys(q.select(*at, "_here"), at, "_here")
    return salted_join(pts, near, at, hot, [key]).select(*points.columns, "near")


def neighbour_mean(points: DataFrame, key: str, by: list[str], values: list[str], k: int = 12, prefix: str = "peer_") -> DataFrame:
    """Mean of each value over the nearest neighbours; points at zero distance count as self.

    A point without a neighbour takes the mean of all points.
    """
    near = knn_lists(points, key, by, k, values)
    out = near
    for v in values:
        peers = F.filter("near", lambda s: (s["d"] > 0) & s[v].isNotNull())
        total = F.aggregate(peers, F.lit(0.0), lambda a, s: a + s[v])
        everyone = points.agg(F.avg(v).alias("m")).scalar()
        out = out.withColumn(f"{prefix}{v}", F.when(F.size(peers) > 0, total / F.size(peers)).otherwise(everyone))
    return out.drop("near")


def coherence(points: DataFrame, key: str, by: list[str], label: str, k: int = 8) -> DataFrame:
    """Share of the k nearest other points that carry the same label, over all points."""
    near = knn_lists(points, key, by, k, [label])
    others = F.slice(F.filter("near", lambda s: s["id"] != F.col(key)), 1, k)
    same = F.size(F.filter(others, lambda s: s[label] == F.col(label)))
    return near.agg(F.sum(same).alias("same"), F.sum(F.size(others)).alias("pairs")).withColumn(
        "coherence", F.col("same") / F.greatest(F.col("pairs"), F.lit(1))
    )


def majority(points: DataFrame, key: str, by: list[str], label: str, k: int = 10, out: str = "label_smooth") -> DataFrame:
    """Label of more than half of the point and its k nearest; the own label where there is none."""
    near = knn_lists(points, key, by, k, [label])
    votes = F.concat(
        F.array(F.col(label)),
        F.transform(F.slice(F.filter("near", lambda s: s["id"] != F.col(key)), 1, k), lambda s: s[label]),
    )
    tally = F.transform(
        F.array_distinct(votes),
        lambda v: F.struct(F.size(F.filter(votes, lambda u: u == v)).alias("n"), v.alias("v")),
    )
    best = F.array_max(tally)
    return near.withColumn(
        out, F.when(best["n"] > F.size(votes) / 2, best["v"]).otherwise(F.col(label))
    ).drop("near")


def nearest(
    points: DataFrame, key: str, targets: DataFrame, target: str, by: list[str], max_km: float | None = None
) -> DataFrame:
    """Nearest target inside the same group: adds `near_id` and `near_km`.

    With `max_km`, a point without a target in reach gets that distance and no id.
    """
    at = [*by, "_x", "_y"]
    pts = planar(points)
    q = pts.groupBy(*at).agg(F.count(F.lit(1)).alias("_here"))
    t = planar(targets).groupBy(*at).agg(F.min(target).alias("_id"))
    both = q.select(*at, "_here", F.lit(None).cast("double").alias("_tx"), F.lit(None).cast("double").alias("_ty")).unionByName(
        t.select(*at, F.lit(None).cast("bigint").alias("_here"), F.col("_x").alias("_tx"), F.col("_y").alias("_ty"))
    )
    seg = _segments(both.withColumn("_z", curve_position()), by)
    w = Window.partitionBy(*by, "_seg").orderBy("_z", "_x", "_y")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    spot = F.when(F.col("_tx").isNotNull(), F.struct("_tx", "_ty"))
    seg = save_table(seg.withColumn("_a", F.last(spot, True).over(before)).withColumn("_b2", F.first(spot, True).over(after)), "segments")
    # A segment without targets takes the last one before it and the first one after it on the curve.
    at_curve = F.struct("_z", "_x", "_y")
    ends = seg.groupBy(*by, "_seg").agg(F.min_by(spot, F.when(spot.isNotNull(), at_curve)).alias("_first"), F.max_by(spot, F.when(spot.isNotNull(), at_curve)).alias("_last"))
    steps = Window.partitionBy(*by).orderBy("_seg")
    ends = ends.select(
        *by, "_seg", F.last("_last", True).over(steps.rowsBetween(Window.unboundedPreceding, -1)).alias("_p"),
        F.first("_first", True).over(steps.rowsBetween(1, Window.unboundedFollowing)).alias("_n"),
    )
    seg = seg.join(ends, [*by, "_seg"])
    d = lambda c: sq_dist(F.col("_x"), F.col("_y"), F.col(f"{c}._tx"), F.col(f"{c}._ty"))
    bound = F.coalesce(F.least(d("_a"), d("_b2"), d("_p"), d("_n")), _whole_extent())
    if max_km is not None:
        bound = F.least(bound, F.lit(max_km * max_km))
    s = seg.where(F.col("_here").isNotNull()).withColumn("_r2", bound).withColumn("_e", _scale(F.col("_r2")))
    s = save_table(s.select(*at, "_here", "_r2", "_e"), "nearest")
    pairs = _within_disc(s.select(*at, "_r2", "_e"), t.select(*by, F.col("_x").alias("_px"), F.col("_y").alias("_py"), "_id"), by)
    best = pairs.groupBy(*at).agg(F.min(F.struct("_d", "_id")).alias("_m"))
    hot = hot_keys(s.select(*at, "_here"), at, "_here")
    out = salted_join(pts, best, at, hot, [key], "left")
    km = F.col("_m._d")
    return out.select(
        *points.columns,
        F.col("_m._id").alias("near_id"),
        (F.coalesce(km, F.lit(max_km)) if max_km is not None else km).alias("near_km"),
    )


# ---------------------------------------------------------------- polygons


def _all_edges(shapes: DataFrame, shape: str, rings: str) -> DataFrame:
    """One row per edge of every ring, each ring closed on itself, with the leftmost x of the edge that follows."""
    at = lambda r, i: F.element_at(r, (i % F.size(r) + 1).cast("int"))
    edge = lambda r: F.transform(
        r, lambda p, i: F.struct(
            p[0].alias("x1"), p[1].alias("y1"), at(r, i + 1)[0].alias("x2"), at(r, i + 1)[1].alias("y2"), F.least(at(r, i + 1)[0], at(r, i + 2)[0]).alias("next")
        )
    )
    return shapes.select(shape, F.explode(rings).alias("_r")).select(shape, F.inline(edge(F.col("_r"))))


def cell_size(edges: DataFrame, shape: str) -> float:
    """Cells twice as wide as an average edge, at most 16 to the longest edge and 64 to the widest shape."""
    reach = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    per = edges.groupBy(shape).agg(
        F.sum(reach).alias("s"), F.count(F.lit(1)).alias("n"), F.max(reach).alias("m"),
        F.greatest(F.max("x1") - F.min("x1"), F.max("y1") - F.min("y1")).alias("w"),
    )
    s, n, longest, widest = per.agg(F.sum("s"), F.sum("n"), F.max("m"), F.max("w")).first()
    return max(2 * s / n, longest / 16, widest / 64) or 1.0 if n else 1.0


def clipped_cells(shapes: DataFrame, shape: str, rings: str = "rings", cell: float | None = None) -> DataFrame:
    """What a point of a grid cell needs to know of a shape: shape, _cx, _cy, _edges, _ys, _odd.

    A ray to the right crosses three kinds of edges. Those that reach into the cell's column are
    looked at one by one; a cell holds the ones that also reach into its row. Those to the left are never
    crossed. Of those to the right, a run along the ring is crossed an odd number of times if its
    two ends lie on different sides of the ray; so the ends are all that is kept. The ends in the
    cell's own row stay with the cell, those in the rows above are one parity.
    """
    edges = _all_edges(shapes, shape, rings)
    if cell is None:
        edges = save_table(edges, "edges")
        cell = cell_size(edges, shape)
    grid = lambda c: F.floor(c / F.lit(float(cell))).cast("bigint")
    e = edges.withColumn("_c", grid(F.least("x1", "x2"))).withColumn("_n", grid(F.col("next")))
    listed = e.where("y1 != y2").select(
        shape, F.struct("x1", "y1", "x2", "y2").alias("_edge"), F.explode(F.sequence("_c", grid(F.greatest("x1", "x2")))).alias("_cx"),
        grid(F.least("y1", "y2")).alias("_lo"), grid(F.greatest("y1", "y2")).alias("_hi"),
    ).select(shape, "_cx", F.explode(F.sequence("_lo", "_hi")).alias("_cy"), "_edge")
    ends = e.where("_c != _n").select(
        shape, F.explode(F.sequence(F.least("_c", "_n"), F.greatest("_c", "_n") - 1)).alias("_cx"), grid(F.col("y2")).alias("_cy"), F.col("y2").alias("_y")
    )
    # Rows with an odd number of ends above them: from the second end up to below the first, and so on.
    down = F.reverse(F.array_sort(F.collect_list("_cy")))
    spans = ends.groupBy(shape, "_cx").agg(down.alias("_d")).select(
        shape, "_cx", F.explode(F.filter(F.transform("_d", lambda d, i: F.struct(F.get("_d", i + 1).alias("lo"), (d - 1).alias("hi"), (i % 2).alias("i"))), lambda s: (s["i"] == 0) & (s["lo"] <= s["hi"]))).alias("s")
    )
    odd = spans.select(shape, "_cx", F.explode(F.sequence(F.col("s.lo"), F.col("s.hi"))).alias("_cy"), F.lit(1).alias("_odd"))
    parts = listed.unionByName(ends, allowMissingColumns=True).unionByName(odd, allowMissingColumns=True)
    return parts.groupBy(shape, "_cx", "_cy").agg(
        F.collect_list("_edge").alias("_edges"), F.collect_list("_y").alias("_ys"), F.coalesce(F.max("_odd"), F.lit(0)).alias("_odd")
    ).withColumn("_cell", F.lit(float(cell)))


def in_polygon(points: DataFrame, shapes: DataFrame, shape: str, rings: str = "rings", cell: float | None = None) -> DataFrame:
    """Points with the shapes that contain them, by the even-odd rule over all rings.

    Points meet the cells of a grid whose size is taken from the shapes, and look at the edges of their
    own cell only.
    """
    s = save_table(clipped_cells(shapes, shape, rings, cell), "cells")
    size = s.select(F.max("_cell")).first()[0]
    if size is None:
        return points.limit(0).withColumn(shape, F.lit(None).cast(shapes.schema[shape].dataType))
    grid = lambda c: F.floor(c / F.lit(size)).cast("bigint")
    p = points.withColumn("_cx", grid(F.col("lon"))).withColumn("_cy", grid(F.col("lat")))
    key = ["_cx", "_cy"]
    crowded = hot_keys(p.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")), key, "_n")
    pairs = salted_join(p, s, key, crowded, points.columns)
    x, y = F.col("lon"), F.col("lat")
    above = F.aggregate("_ys", F.col("_odd"), lambda a, v: a + (v > y).cast("int"))
    crossings = F.aggregate(
        "_edges",
        F.lit(0),
        lambda a, e: a
        + F.when(
            ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]), 1
        ).otherwise(0),
    )
    return pairs.where((above + crossings) % 2 == 1).select(*points.columns, shape)


def ring_measures(shapes: DataFrame, shape: str, rings: str = "rings", min_area: float = 0.0) -> DataFrame:
    """Area, extent and vertex mean of each ring; rings under the minimum area are left out."""
    r = shapes.select(shape, F.posexplode(rings).alias("ring", "_r"))
    n = F.size("_r")
    cross = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0.0),
        lambda a, i: a
        + F.element_at("_r", i.cast("int"))[0] * F.element_at("_r", (i % n + 1).cast("int"))[1]
        - F.element_at("_r", (i % n + 1).cast("int"))[0] * F.element_at("_r", i.cast("int"))[1],
    )
    axis = lambda i: F.transform("_r", lambda p: p[i])
    mean = lambda i: F.aggregate(axis(i), F.lit(0.0), lambda a, v: a + v) / n
    return r.select(
        shape, "ring", n.alias("n_vertices"), (F.abs(cross) / 2).alias("area"),
        F.array_min(axis(0)).alias("x_min"), F.array_max(axis(0)).alias("x_max"),
        F.array_min(axis(1)).alias("y_min"), F.array_max(axis(1)).alias("y_max"),
        mean(0).alias("centre_x"), mean(1).alias("centre_y"),
    ).where(F.col("area") >= min_area)


def lookalike(df: DataFrame, key: str, metrics: list[str], target, n: int) -> DataFrame:
    """The n rows nearest to one row in standardised (population) feature space."""
    stats = df.agg(
        F.struct(*[F.struct(F.avg(m).alias("m"), F.stddev_pop(m).alias("s")).alias(m) for m in metrics]).alias("s")
    ).scalar()
    row = df.where(F.col(key) == target).select(F.struct(*metrics).alias("t")).limit(1).scalar()
    d = F.lit(0.0)
    for m in metrics:
        sd = F.when(stats[m]["s"] < 1e-9, 1.0).otherwise(stats[m]["s"])
        z = (F.col(m) - row[m]) / sd
        d = d + z * z
    return df.where(F.col(key) != target).withColumn("distance", F.sqrt(d)).orderBy("distance", key).limit(n)

"""Many k-means fits advancing together: every round is one job, whatever the number of fits.

A model is a number of centres over all points, over the points of one group, or over all points with
the weights of one bootstrap resample. The centres of all models go to the tasks; each batch of points
is dealt to its nearest centre in every model it belongs to, and what leaves a task is one sum per
(model, centre). To the driver come these sums only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 2000  # points of a group that the first centres are drawn from


@dataclass(frozen=True)
class Model:
    """k centres; of one group of points, or of all; with the weights of one resample, or each point once."""

    name: str
    k: int
    group: str | None = None
    resample: int | None = None
    seed: int = 7


def poisson_weight(key: str, resample: int) -> Column:
    """How often a bootstrap resample holds a row: Poisson(1) from a hash, so a rerun draws the same."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(resample)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    steps = [sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) for i in range(9)]
    return sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))


def points_of(df: DataFrame, key: str, features: Column, group: str | None = None, resamples: int = 0) -> DataFrame:
    """What the passes read: key, _x, _g, _w."""
    weights = F.array(*[poisson_weight(key, b) for b in range(resamples)]).cast("array<int>")
    g = F.col(group).cast("string") if group else F.lit(None).cast("string")
    return df.select(key, features.cast("array<double>").alias("_x"), g.alias("_g"), weights.alias("_w"))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    n = len(column)
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1) if n else np.zeros((0, 0), kind)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def _members(b: pa.RecordBatch, models: list[Model]):
    """For every model with points in the batch: its number, their rows, vectors and weights."""
    x, w = _matrix(b.column("_x"), float), _matrix(b.column("_w"), float)
    groups = np.array(b.column("_g").to_pylist(), object)
    rows = {g: np.flatnonzero(groups == g) for g in {m.group for m in models if m.group is not None}}
    every = np.arange(len(x))
    for i, m in enumerate(models):
        at = every if m.group is None else rows[m.group]
        weight = np.ones(len(at)) if m.resample is None else w[at, m.resample]
        if len(at):
            yield i, at, x[at], weight


def _start(points: DataFrame, models: list[Model]) -> list[np.ndarray]:
    """k-means++ over the points of lowest hash, at most SAMPLE of a group, and a few rounds over these."""
    key = points.columns[0]
    drawn = points.withColumn("_h", F.xxhash64(F.col(key), F.lit(17))).select(key, "_g", "_h", "_x")
    got: dict[str | None, list] = {}
    if any(m.group is None for m in models):
        got[None] = [(r["_h"], r["_x"]) for r in drawn.orderBy("_h", key).limit(SAMPLE).collect()]
    if any(m.group is not None for m in models):
        order = Window.partitionBy("_g").orderBy("_h", key)
        few = drawn.where(F.col("_g").isNotNull()).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= SAMPLE)
        for r in few.collect():
            got.setdefault(r["_g"], []).append((r["_h"], r["_x"]))
    starts = []
    for m in models:
        x = np.array([v for _, v in sorted(got.get(m.group, []))], float)
        starts.append(_plus_plus(x, m.k, m.seed) if len(x) else np.zeros((0, 0)))
    return starts


def _plus_plus(x: np.ndarray, k: int, seed: int, rounds: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[[rng.integers(len(x))]]
    while len(c) < k:
        d = _distances(x, c).min(1)
        if d.sum() <= 1e-12:
            break
        c = np.vstack((c, x[rng.choice(len(x), p=d / d.sum())]))
    for _ in range(rounds):
        at = _distances(x, c).argmin(1)
        c = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
    return c


def sums(points: DataFrame, models: list[Model], centres: list[np.ndarray]) -> dict[int, dict[int, tuple]]:
    """Per model and centre: weight, sum, sum of squares, and sum of distances of its points. One job."""

    def run(batches):
        held: dict[tuple[int, int], list] = {}
        for b in batches:
            for i, _, x, w in _members(b, models):
                d = _distances(x, centres[i])
                at = d.argmin(1)
                near = np.sqrt(d[np.arange(len(at)), at])
                for j in np.unique(at):
                    mine = at == j
                    v = w[mine]
                    new = [v.sum(), (x[mine] * v[:, None]).sum(0), float((v * (x[mine] ** 2).sum(1)).sum()), float((v * near[mine]).sum())]
                    old = held.get((i, int(j)))
                    held[i, int(j)] = new if old is None else [p + q for p, q in zip(old, new, strict=True)]
        if held:
            ks = list(held)
            columns = [[k[0] for k in ks], [k[1] for k in ks], *[[held[k][c] for k in ks] for c in range(4)]]
            types = [pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.float64(), pa.float64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["m", "c", "n", "s", "q", "d"])

    found = points.mapInArrow(run, "m int, c int, n double, s array<double>, q double, d double")
    dims = max((c.shape[1] for c in centres if c.size), default=0)
    total = found.groupBy("m", "c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(dims)]).alias("s"), F.sum("q").alias("q"), F.sum("d").alias("d"))
    out: dict[int, dict[int, tuple]] = {i: {} for i in range(len(models))}
    for r in total.collect():
        out[r["m"]][r["c"]] = (r["n"], np.array(r["s"]), r["q"], r["d"])
    return out


def fit(points: DataFrame, models: list[Model], max_iter: int = 20, tolerance: float = 1e-4) -> list[np.ndarray]:
    """Centres of every model, largest cluster first; all models advance in the same rounds."""
    centres = _start(points, models)
    for _ in range(max_iter):
        moved, stats = 0.0, sums(points, models, centres)
        for i, c in enumerate(centres):
            new = np.array([stats[i][j][1] / stats[i][j][0] if j in stats[i] and stats[i][j][0] > 0 else c[j] for j in range(len(c))]).reshape(c.shape)
            moved = max(moved, float(np.abs(new - c).max(initial=0)))
            centres[i] = new
        if moved <= tolerance:
            break
    stats = sums(points, models, centres)
    size = lambda i, j: stats[i][j][0] if j in stats[i] else 0.0
    return [c[sorted(range(len(c)), key=lambda j, i=i, c=c: (-size(i, j), tuple(c[j])))] if len(c) else c for i, c in enumerate(centres)]


def assign(points: DataFrame, models: list[Model], centres: list[np.ndarray]) -> DataFrame:
    """key, model, cluster and weight: a row for every point and model it belongs to."""
    key = points.columns[0]

    def run(batches):
        for b in batches:
            for i, rows, x, w in _members(b, models):
                at = _distances(x, centres[i]).argmin(1).astype(np.int32)
                names = pa.array([models[i].name] * len(rows), pa.string())
                yield pa.record_batch([b.column(key).take(pa.array(rows)), names, pa.array(at), pa.array(w)], [key, "model", "cluster", "weight"])

    kind = points.schema[key].dataType.simpleString()
    return points.mapInArrow(run, f"`{key}` {kind}, model string, cluster int, weight double")


def agreement(points: DataFrame, models: list[Model], centres: list[np.ndarray], reference: int = 0) -> dict[int, list[tuple]]:
    """Per model the weighted counts (cluster of the reference model, cluster, n) over its points. One job."""

    def run(batches):
        held: dict[tuple[int, int, int], float] = {}
        for b in batches:
            found = {i: (rows, x, w) for i, rows, x, w in _members(b, models)}
            if reference not in found:
                continue
            ref = np.full(b.num_rows, -1)
            rows, x, _ = found[reference]
            ref[rows] = _distances(x, centres[reference]).argmin(1)
            for i, (rows, x, w) in found.items():
                pair = np.stack((ref[rows], _distances(x, centres[i]).argmin(1)), 1)
                kinds, at = np.unique(pair, axis=0, return_inverse=True)
                for (r, c), n in zip(kinds.tolist(), np.bincount(at.ravel(), w, len(kinds)).tolist(), strict=True):
                    held[i, r, c] = held.get((i, r, c), 0.0) + n
        ks = list(held)
        yield pa.record_batch([pa.array([k[j] for k in ks], pa.int32()) for j in range(3)] + [pa.array(list(held.values()), pa.float64())], ["m", "r", "c", "n"])

    out: dict[int, list[tuple]] = {i: [] for i in range(len(models))}
    for r in points.mapInArrow(run, "m int, r int, c int, n double").groupBy("m", "r", "c").agg(F.sum("n").alias("n")).collect():
        out[r["m"]].append((r["r"], r["c"], r["n"]))
    return out


def quality(points: DataFrame, models: list[Model], centres: list[np.ndarray]) -> list[tuple[float, float, float, float, float]]:
    """Silhouette (squared distances), Davies-Bouldin, Calinski-Harabasz, inertia and explained plus
    inertia over the total, for every model; two jobs."""
    stats = sums(points, models, centres)
    sent = [{j: (v[0], v[1] / v[0], v[2] / v[0]) for j, v in s.items() if v[0] > 0} for s in stats.values()]

    def run(batches):
        total = np.zeros((len(models), 2))
        for b in batches:
            for i, _, x, w in _members(b, models):
                js = sorted(sent[i])
                at = _distances(x, centres[i]).argmin(1)
                far = np.stack([(x * x).sum(1) + sent[i][j][2] - 2 * x @ sent[i][j][1] for j in js], 1)
                own = np.searchsorted(js, at)
                n = np.array([sent[i][j][0] for j in js])[own]
                rows = np.arange(len(x))
                a = far[rows, own] * n / np.maximum(n - 1, 1)
                far[rows, own] = np.inf
                o = far.min(1)
                s = np.where((n > 1) & np.isfinite(o), (o - a) / np.maximum(np.maximum(a, o), 1e-300), 0.0)
                total[i] += [(s * w).sum(), w.sum()]
        yield pa.record_batch([pa.array(np.arange(len(models))), pa.array(total[:, 0]), pa.array(total[:, 1])], ["m", "s", "n"])

    sil = {r["m"]: r["s"] / r["n"] if r["n"] else 0.0 for r in points.mapInArrow(run, "m long, s double, n double").groupBy("m").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    out = []
    for i, c in enumerate(centres):
        s = {j: v for j, v in stats[i].items() if v[0] > 0}
        n = sum(v[0] for v in s.values())
        mean = sum(v[1] for v in s.values()) / n
        within = sum(v[2] - (v[1] @ v[1]) / v[0] for v in s.values())
        between = sum(v[0] * ((v[1] / v[0] - mean) ** 2).sum() for v in s.values())
        total = sum(v[2] for v in s.values()) - n * (mean @ mean)
        spread = {j: v[3] / v[0] for j, v in s.items()}
        db = [max(((spread[a] + spread[b]) / max(math.dist(c[a], c[b]), 1e-12) for b in s if b != a), default=0.0) for a in s]
        ch = (between / max(len(s) - 1, 1)) / max(within / max(n - len(s), 1), 1e-12)
        out.append(tuple(map(float, (sil.get(i, 0.0), sum(db) / len(s), ch, within, (between + within) / total if total else 1.0))))
    return out

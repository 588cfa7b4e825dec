"""Hard negatives by slot-decomposed selection.

An anchor's positives are its best rows of the same label. Each positive asks for the best rows of other
labels whose score lies in a window below its own. The upper limits of the windows cut the scores into
disjoint slots. One pass over the rows keeps the best k of every slot, combined in every block of rows
and then across blocks; going down the slots, the lists are merged into the best k at or under each
limit, and these answer all windows, however they overlap.

Anchors against rows is a stated query set against all rows: rows are dealt into blocks, and every block
streams all anchors past its rows as matrix products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geodemand.llm.common import written
from geodemand.session import parallelism

BLOCK_BYTES = 64 << 20  # a block of rows as 8-byte numbers
LEAST_ROWS = 2000  # a block has so many rows on average at least
TILE_ROWS, TILE_ANCHORS = 8192, 256
_MOST, _LEAST = 2**63 - 1, -(2**63)


def usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of whole numbers; missing components are 0."""
    flat, n = pc.list_flatten(column).to_numpy(), pc.list_value_length(column).to_numpy()
    out = np.zeros((len(n), dims), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows, in the narrowest type that holds every partial sum.

    By Cauchy-Schwarz no partial sum is above the product of the lengths. Scores beyond 64 bits are
    set to the nearest limit.
    """
    most = np.sqrt((a.astype(float) ** 2).sum(1).max(initial=0)) * np.sqrt((b.astype(float) ** 2).sum(1).max(initial=0))
    if most < 2**23:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if most < 2**52:
        return a.astype(float) @ b.astype(float).T
    exact = np.array(a.astype(object) @ b.astype(object).T, dtype=object).reshape(len(a), len(b))
    return np.minimum(np.maximum(exact, _LEAST), _MOST)


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of each row's k highest, equal ones from left to right; -inf where there are fewer."""
    scores = scores.copy()
    rows = np.arange(len(scores))
    at = np.zeros((len(scores), k), np.int64)
    got = np.full((len(scores), k), -np.inf, scores.dtype)
    for j in range(min(k, scores.shape[1])):
        at[:, j] = scores.argmax(1)
        got[:, j] = scores[rows, at[:, j]]
        if (got[:, j] == -np.inf).all():
            break
        scores[rows, at[:, j]] = -np.inf
    return at, got


class Best:
    """The best k of each of some lists so far, over tiles that come in the order of ties."""

    def __init__(self, lists: int, k: int):
        self.at, self.score, self.k = np.zeros((lists, k), np.int64), np.full((lists, k), -np.inf, object), k

    def add(self, rows: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        at, score = np.hstack((self.at[rows], at)), np.hstack((self.score[rows], score.astype(object)))
        order = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
        self.at[rows], self.score[rows] = np.take_along_axis(at, order, 1), np.take_along_axis(score, order, 1)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, place and score of everything kept."""
        which, j = np.nonzero(self.score != -np.inf)
        return which, self.at[which, j], np.array([int(x) for x in self.score[which, j]], np.int64)


def positives_of(block: dict, anchors: dict, k: int) -> tuple:
    """Best rows of the anchors' labels; rows lie label by label, so each label is one product."""
    best = Best(len(anchors["row"]), k)
    for label in np.unique(anchors["label"]):
        some = np.flatnonzero(anchors["label"] == label)
        lo, hi = np.searchsorted(block["label"], [label, label + 1]) if label < _MOST else (np.searchsorted(block["label"], label), len(block["label"]))
        for first in range(lo, hi, TILE_ROWS):
            tile = slice(first, min(first + TILE_ROWS, hi))
            s = products(anchors["x"][some], block["x"][tile])
            s[anchors["row"][some][:, None] == block["row"][tile][None, :]] = -np.inf
            at, got = best_of(s, k)
            best.add(some, at + first, got)
    which, at, score = best.found()
    return which, np.zeros(len(which), np.int32), at, score


def slots_of(block: dict, anchors: dict, k: int) -> tuple:
    """Best rows of other labels in every slot of the anchors."""
    uppers, lowest = anchors["uppers"], anchors["lowest"]
    n_slots = max(map(len, uppers), default=0)
    high = np.array([[u[j] if j < len(u) else _LEAST for j in range(n_slots)] for u in uppers], object).reshape(len(uppers), n_slots)
    low = np.array([[u[j + 1] if j + 1 < len(u) else lo - 1 for j in range(n_slots)] for u, lo in zip(uppers, lowest, strict=True)], object)
    low = low.reshape(len(uppers), n_slots)
    best = Best(len(uppers) * n_slots, k)
    for first in range(0, len(block["row"]), TILE_ROWS):
        tile = slice(first, min(first + TILE_ROWS, len(block["row"])))
        s = products(anchors["x"], block["x"][tile])
        s[anchors["label"][:, None] == block["label"][tile][None, :]] = -np.inf
        for j in range(n_slots):
            hi, lo = (limit_type(x[:, j], s.dtype)[:, None] for x in (high, low))
            inside = (s <= hi) & (s > lo)
            some = np.flatnonzero(inside.any(1))
            if len(some):
                at, got = best_of(np.where(inside[some], s[some], -np.inf), k)
                best.add(some * n_slots + j, at + first, got)
    which, at, score = best.found()
    return which // max(n_slots, 1), (which % max(n_slots, 1)).astype(np.int32), at, score


def limit_type(limits: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Limits in the type of the scores; those outside its exact range lie beyond every score anyway."""
    return limits if kind == object else np.clip(limits.astype(float), -(2.0**53), 2.0**53).astype(kind)


def over_blocks(rows: DataFrame, anchors: DataFrame, work, order: list, dims: int, blocks: int, k: int, key: str) -> DataFrame:
    """What `work` finds for all anchors in every block of rows: _anchor, _slot, score and key.

    A block is one run of a sorted stream: its rows, in the order of `order`, then all anchors.
    """
    kind = rows.schema[key].dataType.simpleString()
    names = ["_block", "_kind", "_row", key, "label", "x", "uppers", "lowest"]
    none = [F.lit(None).cast("array<long>").alias("uppers"), F.lit(None).cast("long").alias("lowest")]
    left = rows.select("_block", F.lit(0).alias("_kind"), "_row", key, "label", "x", *none)
    right = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), F.lit(1).alias("_kind"), "_row", key, "label", "x", "uppers", "lowest")
    dealt = left.unionByName(right.select(*names)).repartition(blocks, "_block").sortWithinPartitions("_block", "_kind", *order)

    def parts(batches):
        """Batches cut where the block or the kind changes."""
        for b in batches:
            if b.num_rows == 0:
                continue
            code = b.column("_block").to_numpy().astype(np.int64) * 2 + b.column("_kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                for s in range(i, j, TILE_ANCHORS if code[i] % 2 else j - i):
                    yield divmod(int(code[i]), 2), b.slice(s, min(TILE_ANCHORS, j - s) if code[i] % 2 else j - i)

    def arrays(b) -> dict:
        return {"row": b.column("_row").to_numpy(), "label": b.column("label").to_numpy(), "x": matrix(b.column("x"), dims)}

    def run(batches):
        now, held, block = None, [], None
        for (number, is_anchor), b in parts(batches):
            if number != now:
                now, held, block = number, [], None
            if not is_anchor:
                held.append(b)
                continue
            if not held:
                continue
            if block is None:
                tables = [arrays(x) for x in held]
                block = {n: np.concatenate([t[n] for t in tables]) for n in ("row", "label", "x")}
                keys = pa.chunked_array([x.column(key) for x in held])
            a = arrays(b) | {"uppers": [x or [] for x in b.column("uppers").to_pylist()], "lowest": [x or 0 for x in b.column("lowest").to_pylist()]}
            which, slot, at, score = work(block, a, k)
            if len(which):
                found = keys.take(pa.array(at)).combine_chunks()
                yield pa.record_batch([pa.array(a["row"][which]), pa.array(slot), pa.array(score), found], ["_anchor", "_slot", "score", key])

    return dealt.mapInArrow(run, f"_anchor long, _slot int, score long, `{key}` {kind}")


def best_in(found: DataFrame, by: list[str], k: int, key: str) -> DataFrame:
    """The best k of each group, best first, from the best k of the blocks."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last(F.col(key)))
    return found.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k)


def share(score: Column, percent: int, up: bool) -> Column:
    """score * percent / 100 of a score from 0 on, rounded down or up, without leaving 64 bits."""
    div = lambda a: F.call_function("div", a, F.lit(100))
    return div(score) * percent + div(score % 100 * percent + (99 if up else 0))


def windows_of(found: DataFrame, positives: int, low: int, high: int, key: str) -> DataFrame:
    """Per anchor its positives with a window that some whole number lies in, best first, and the windows' limits."""
    best = best_in(found, ["_anchor"], positives, key).where("score >= 0")
    score = F.col("score")
    entry = F.struct("_place", F.col(key).alias("id"), "score", share(score, high, False).alias("upper"), share(score, low, True).alias("lower"))
    asked = best.groupBy("_anchor").agg(F.array_sort(F.collect_list(entry)).alias("windows"))
    asked = asked.withColumn("windows", F.filter("windows", lambda w: w["lower"] <= w["upper"])).where(F.size("windows") > 0)
    return asked.select("_anchor", "windows", F.array_distinct("windows.upper").alias("uppers"), F.array_min("windows.lower").alias("lowest"))


def merged(slots: str, n_slots: Column, k: int) -> Column:
    """For every slot the best k of it and all slots below, merged from the lowest slot up."""
    none = F.filter(F.array(slots), lambda x: F.lit(False))

    def step(lists, j):
        below = F.when(F.size(lists) > 0, F.get(lists, F.lit(0))).otherwise(F.slice(slots, 1, 0))
        here = F.filter(slots, lambda e: e["_slot"] == j)
        return F.concat(F.array(F.slice(F.concat(here, below), 1, k)), lists)

    return F.aggregate(F.reverse(F.sequence(F.lit(0), n_slots - 1)), none, step)


def mine(
    rows: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "vector", positives: int = 5, k: int = 3,
    low: int = 50, high: int = 95, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vector` is an array of whole numbers; a score is the inner product with the anchor. For each of an
    anchor's best `positives` other rows of its label, the best k rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score (whole percents, low <= high).
    Higher scores come first, equal ones by smaller key, null last. Positives under 0 have no window.

    Rows with a null label, a null vector or a null component take no part. Rows are told apart by a row
    number: rows with equal or null keys are rows of their own, and as anchors have results of their own.
    Components that a shorter vector lacks count as 0; scores beyond 64 bits stand at the limit. Other
    columns are not read; empty tables, and anchors without positives or negatives, give no rows.
    """
    spark = rows.sparkSession
    kept = rows.where(rows[label].isNotNull()).select(rows[key].alias(key), rows[label].cast("long").alias("label"), rows[vector].alias("x"), is_anchor.alias("_is_anchor"))
    kept = written(kept.where(usable("x")).withColumn("_row", F.monotonically_increasing_id()), "vectors")
    n, dims = kept.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    dims = max(dims, 1)
    blocks = max(-(-n // max(1, block_bytes // (8 * dims))), min(parallelism(spark), -(-n // LEAST_ROWS)), 1)
    kept = kept.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int"))
    anchors = kept.where("_is_anchor")
    no_limits = [F.lit(None).cast("array<long>").alias("uppers"), F.lit(None).cast("long").alias("lowest")]
    by_key = [F.asc_nulls_last(F.col(key)), F.col("_row")]
    near = over_blocks(kept, anchors.select("*", *no_limits), positives_of, ["label", *by_key], dims, blocks, positives, key)
    asked = written(windows_of(near, positives, low, high, key), "windows")
    limited = anchors.join(asked.select(F.col("_anchor").alias("_row"), "uppers", "lowest"), "_row")
    far = best_in(over_blocks(kept, limited, slots_of, by_key, dims, blocks, k, key), ["_anchor", "_slot"], k, key)
    entry = F.struct("_slot", "_place", F.col("score"), F.col(key).alias("id"))
    slots = far.groupBy("_anchor").agg(F.array_sort(F.collect_list(entry)).alias("slots"))
    answered = asked.join(slots, "_anchor").withColumn("lists", merged("slots", F.size("uppers"), k)).select("_anchor", "uppers", "lists", F.explode("windows").alias("w"))
    inside = F.filter(F.get("lists", F.array_position("uppers", F.col("w.upper")).cast("int") - 1), lambda e: e["score"] >= F.col("w.lower"))
    out = answered.select("_anchor", "w", F.posexplode(inside).alias("at", "e"))
    return out.join(anchors.select(F.col("_row").alias("_anchor"), F.col(key).alias("anchor_id")), "_anchor").select(
        "anchor_id", F.col("w.id").alias("positive_id"), (F.col("at") + 1).alias("rank"), F.col("e.id").alias("negative_id"),
        F.col("w.score").alias("positive_score"), F.col("e.score").alias("negative_score"),
    )

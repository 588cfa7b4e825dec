"""Removal of repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes.

Not every suffix has to be sorted. Any two equal strings of 100 bytes hold the same 24 bytes with
the smallest hash at the same offset; such a place is an anchor, and all strings that have it as
theirs make one context of at most 176 bytes. Contexts equal as a whole are settled at once: all but
the earliest repeat it. What remains are anchors whose 24 bytes occur in different contexts. Their
suffixes are sorted into runs where they are, front-coded (length of the prefix shared with the entry
before, and the rest), exchanged by ranges of suffixes, and combined by loser trees that compare two
suffixes only behind the prefix known to be shared. The merged order comes with the shared prefixes
of neighbours, as does the order of the reversed bytes before the anchors; cut at 100 - o and o they
give the groups of equal strings that start o bytes before an anchor.
"""

from __future__ import annotations

import bisect
import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodemand.llm.common import Rolling, block_count, columns_only, mixed, small_slices, text_bytes, written
from geodemand.session import parallelism

LENGTH = 100
GRAM = 24
SPLIT_SAMPLE = 2_000  # documents whose anchors give the ranges of suffixes
RUN_BYTES = 6_000_000
_ROLLING = Rolling(97)
_PIECE = 1 << 22


def contexts(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Contexts of texts laid end to end: doc, gram hash, context hash, first and last start, anchor (in `data`)."""
    n, span = len(data), length - GRAM + 1
    found: dict[str, list] = {c: [] for c in ("doc", "h", "c", "lo", "hi", "a")}
    if n >= length:
        sums = _ROLLING.prefix(data)
        place = np.arange(n - GRAM + 1)
        grams = _ROLLING.ranges(sums, place, place + GRAM)
        for base in range(0, n - length + 1, _PIECE):
            count = min(_PIECE, n - length + 1 - base)
            part = grams[base : base + count + span - 1]
            least = (part & ~np.uint64((1 << 24) - 1)) | np.arange(len(part), dtype=np.uint64)
            width = 1
            while 2 * width <= span:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            rest = span - width
            least = np.minimum(least[: count], least[rest : rest + count])
            anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64) + base
            p = np.arange(base, base + count)
            doc = np.searchsorted(offsets, p, side="right") - 1
            whole = p + length <= offsets[doc + 1]
            fresh = whole.copy()
            fresh[1:] &= (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            cut = fresh | ~whole
            at = np.flatnonzero(fresh)
            ends = np.append(np.flatnonzero(cut), count)
            hi = p[ends[np.searchsorted(ends, at, side="right")] - 1]
            lo, a = p[at], anchor[at]
            shape = ((hi - lo) * 128 + (a - lo)).astype(np.uint64)
            for name, x in zip(found, (doc[at], grams[a], _ROLLING.ranges(sums, lo, hi + length) ^ mixed(shape), lo, hi, a), strict=True):
                found[name].append(x)
    return {name: np.concatenate(x) if x else np.zeros(0, np.uint64 if name in "hc" else np.int64) for name, x in found.items()}


def _folded(h: np.ndarray, c: np.ndarray, k: np.ndarray, x: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts that repeat an earlier one of the same batch are settled here: v turns to -1 - v.

    They travel under hashes of their own, so that a context repeated very often meets in one task
    only once for each batch that has it.
    """
    order = np.lexsort((v, x, k, c, h))
    h, c, k, x, v = h[order], c[order], k[order], x[order], v[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    again = (k != k[head]) | (x != x[head]) | (v != v[head])
    own = mixed((k ^ x).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + v.view(np.uint64))
    return np.where(again, own, h), np.where(again, np.uint64(0), c), k, x, np.where(again, -1 - v, v)


def _anchors(docs: DataFrame) -> DataFrame:
    """(h, c, k, x, v): every context; v packs its first start, number of further starts, and anchor offset, below 0 if settled."""

    def run(batches):
        for b in batches:
            for s, e in small_slices(b, "t"):
                part = b.slice(s, e - s)
                data, offsets = text_bytes(part.column("t"))
                found = contexts(data, offsets)
                v = ((found["lo"] - offsets[found["doc"]]) << 14) | ((found["hi"] - found["lo"]) << 7) | (found["a"] - found["lo"])
                k, x = (part.column(name).to_numpy(zero_copy_only=False)[found["doc"]].astype(np.int64) for name in "kx")
                h, c, k, x, v = _folded(found["h"], found["c"], k, x, v)
                columns = [pa.array(y) for y in (h.view(np.int64), c.view(np.int64), k, x, v)]
                yield pa.record_batch(columns, ["h", "c", "k", "x", "v"])

    return docs.mapInArrow(run, "h long, c long, k long, x long, v long")


def _settle(anchors: DataFrame) -> DataFrame:
    """(k, x, v, open): contexts equal to an earlier one, and (open) the first of each where a gram has several."""

    def run(batches):
        last, kinds, held = None, 0, None  # the last row, contexts of its gram so far, the gram's first row if not given out
        for b in batches:
            h, c, k, x, v = (b.column(name).to_numpy() for name in "hckxv")
            done = v < 0
            if done.any():
                settled = [pa.array(k[done]), pa.array(x[done]), pa.array(-1 - v[done]), pa.array(np.zeros(done.sum(), bool))]
                yield pa.record_batch(settled, ["k", "x", "v", "open"])
                h, c, k, x, v = h[~done], c[~done], k[~done], x[~done], v[~done]
            if not len(h):
                continue
            new_h, new_c = np.ones(len(h), bool), np.ones(len(h), bool)
            new_h[1:] = h[1:] != h[:-1]
            new_c[1:] = new_h[1:] | (c[1:] != c[:-1])
            if last is not None:
                new_h[0] = h[0] != last[0]
                new_c[0] = new_h[0] or c[0] != last[1]
            head = np.maximum.accumulate(np.where(new_c, np.arange(len(h)), -1))
            rk, rx, rv = (np.where(head >= 0, y[head], last[i] if last is not None else 0) for i, y in ((2, k), (3, x), (4, v)))
            repeat = ~new_c & ((k != rk) | (x != rx) | (v != rv))
            group = np.cumsum(new_h)  # 0: the gram carried over
            per = np.bincount(group, weights=new_c, minlength=group[-1] + 1).astype(int)
            per[0] += kinds
            opened = new_c & (per[group] > 1)
            out = [(k[which], x[which], v[which], np.full(which.sum(), first)) for which, first in ((repeat, False), (opened, True))]
            if held is not None and per[0] > 1:
                out.append((*(np.array([y]) for y in held), np.ones(1, bool)))
                held = None
            if group[-1]:
                held = None
                kinds = per[group[-1]]
                first = int(np.flatnonzero(new_h)[-1])
                if kinds == 1:
                    held = (k[first], x[first], v[first])
            else:
                kinds = per[0]
            last = (h[-1], c[-1], rk[-1], rx[-1], rv[-1])
            yield pa.record_batch([pa.array(np.concatenate([o[i] for o in out])) for i in range(4)], ["k", "x", "v", "open"])

    ways = parallelism(anchors.sparkSession)
    return anchors.repartition(ways, "h").sortWithinPartitions("h", "c", "k", "x", "v").mapInArrow(run, "k long, x long, v long, open boolean")


def shared_prefix(x: bytes, y: bytes, start: int) -> int:
    """Length of the common prefix of two strings that agree up to `start`."""
    n = min(len(x), len(y))
    if x[start:n] == y[start:n]:
        return n
    return start + len(os.path.commonprefix((x[start:n], y[start:n])))


def front_coded(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of a sorted list: the prefix shared with the string before, and the rest."""
    shared, rest, last = [], [], b""
    for s in strings:
        n = shared_prefix(last, s, 0)
        shared.append(n)
        rest.append(s[n:])
        last = s
    return shared, rest


def merge_runs(runs: list[tuple[list[int], list[bytes]]]) -> list[tuple[int, int, int, bytes]]:
    """(run, entry, prefix shared with the one before, string) of front-coded sorted runs, in order.

    A loser tree whose nodes remember the prefix that the loser shares with the last winner. Of two
    candidates the one that shares more with it is smaller; only at a draw are bytes compared, and
    only those behind the known prefix.
    """
    n = len(runs)
    text: list[bytes | None] = [b""] * n
    entry, known = [-1] * n, [0] * n

    def advance(r: int) -> None:
        entry[r] += 1
        shared, rest = runs[r]
        if entry[r] < len(shared):
            known[r] = shared[entry[r]]
            text[r] = text[r][: known[r]] + rest[entry[r]]
        else:
            text[r], known[r] = None, -1

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix is then that with the winner."""
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = text[a], text[b]
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        m = shared_prefix(x, y, known[a])
        if (x[m : m + 1], a) <= (y[m : m + 1], b):
            known[b] = m
            return a, b
        known[a] = m
        return b, a

    size = 1
    while size < n:
        size *= 2
    for r in range(n):
        advance(r)
        known[r] = 0 if text[r] is not None else -1
    loser = [-1] * size
    level = [r if r < n else -1 for r in range(size)]
    node = size
    while len(level) > 1:
        node //= 2
        above = []
        for i in range(0, len(level), 2):
            a, b = level[i], level[i + 1]
            if a < 0 or b < 0:
                winner, loser[node + i // 2] = (b, a) if a < 0 else (a, b)
            else:
                winner, loser[node + i // 2] = play(a, b)
            above.append(winner)
        level = above
    winner, out = level[0], []
    while winner >= 0 and text[winner] is not None:
        out.append((winner, entry[winner], known[winner], text[winner]))
        advance(winner)
        at = (winner + size) // 2
        while at:
            if loser[at] >= 0:
                winner, loser[at] = play(winner, loser[at])
            at //= 2
    return out


RUN_SCHEMA = pa.schema(
    [("part", pa.int32()), ("shared", pa.list_(pa.int32())), ("rest", pa.list_(pa.binary())), ("left", pa.list_(pa.binary())),
     ("k", pa.list_(pa.int64())), ("x", pa.list_(pa.int64())), ("a", pa.list_(pa.int64()))]
)


def _runs(rows: DataFrame, cuts: list[bytes], length: int) -> DataFrame:
    """Sorted front-coded runs of the open contexts of rows (k, x, t, found), cut at the ranges of suffixes."""
    sent = rows.sparkSession.sparkContext.broadcast(cuts)

    def out(entries: list) -> pa.RecordBatch:
        entries.sort()
        made, at = [], 0
        bounds = [bisect.bisect_left(entries, (cut,)) for cut in sent.value] + [len(entries)]
        for part, end in enumerate(bounds):
            if end > at:
                piece = entries[at:end]
                shared, rest = front_coded([e[0] for e in piece])
                made.append({"part": part, "shared": shared, "rest": rest, "left": [e[4] for e in piece], "k": [e[1] for e in piece], "x": [e[2] for e in piece], "a": [e[3] for e in piece]})
            at = end
        return pa.RecordBatch.from_pylist(made, RUN_SCHEMA)

    def run(batches):
        entries, held = [], 0
        for b in batches:
            for s, e in small_slices(b, "t"):
                for r in b.slice(s, e - s).to_pylist():
                    t = r["t"].encode()
                    for v in r["found"]:
                        if v & 1:
                            lo, more, offset = v >> 15, v >> 8 & 127, v >> 1 & 127
                            a = lo + offset
                            entries.append((t[a : lo + more + length], r["k"], r["x"], a, t[lo:a][::-1]))
                            held += more + length
                if held > RUN_BYTES:
                    yield out(entries)
                    entries, held = [], 0
        if entries:
            yield out(entries)

    return rows.mapInArrow(run, "part int, shared array<int>, rest array<binary>, left array<binary>, k array<long>, x array<long>, a array<long>")


def repeated_spans(runs: list[tuple[list[int], list[bytes]]], left: list[bytes], k: np.ndarray, x: np.ndarray, a: np.ndarray, entry_of: list[list[int]], length: int) -> list[tuple[int, int, int, int]]:
    """(k, x, first byte, end) covered, per context, by strings that start earlier in another; contexts numbered by `entry_of`."""
    merged = merge_runs(runs)
    order = np.array([entry_of[r][i] for r, i, _, _ in merged])
    n = len(order)
    shared = np.array([m[2] for m in merged])
    right_size = np.array([len(m[3]) for m in merged])
    lefts = [left[i] for i in order]
    by_left = sorted(range(n), key=lefts.__getitem__)
    shared_left = np.array(front_coded([lefts[i] for i in by_left])[0])
    rank_left = np.empty(n, np.int64)
    rank_left[by_left] = np.arange(n)
    left_size = np.array([len(x) for x in lefts])
    kk, xx, aa = k[order], x[order], a[order]
    age = np.lexsort((aa, xx, kk))
    rank_age = np.empty(n, np.int64)
    rank_age[age] = np.arange(n)
    low, high = np.full(n, length), np.full(n, -1)
    for o in range(length - GRAM + 1):
        has = np.flatnonzero((left_size >= o) & (right_size >= length - o))
        if len(has) < 2:
            continue
        right_group = np.cumsum(shared < length - o)[has]
        left_group = np.cumsum(shared_left < o)[rank_left[has]]
        at = np.lexsort((rank_age[has], left_group, right_group))
        these = has[at]
        start = np.ones(len(these), bool)
        start[1:] = (right_group[at][1:] != right_group[at][:-1]) | (left_group[at][1:] != left_group[at][:-1])
        head = these[np.maximum.accumulate(np.where(start, np.arange(len(these)), 0))]
        again = these[(kk[these] != kk[head]) | (xx[these] != xx[head]) | (aa[these] != aa[head])]
        low[again] = np.minimum(low[again], o)
        high[again] = o
    hit = np.flatnonzero(high >= 0)
    return list(zip(kk[hit].tolist(), xx[hit].tolist(), (aa[hit] - high[hit]).tolist(), (aa[hit] - low[hit] + length).tolist(), strict=True))


def _merge(runs: DataFrame, length: int) -> DataFrame:
    """(k, x, s, e): bytes of open contexts that repeat an earlier string."""

    def merge(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        left, k, x, a, entry_of = [], [], [], [], []
        for r in rows:
            entry_of.append(list(range(len(k), len(k) + len(r["k"]))))
            left += r["left"]
            k += r["k"]
            x += r["x"]
            a += r["a"]
        spans = repeated_spans([(r["shared"], r["rest"]) for r in rows], left, np.array(k), np.array(x), np.array(a), entry_of, length)
        columns = list(zip(*spans, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["k", "x", "s", "e"])

    return runs.groupBy("part").applyInArrow(merge, "k long, x long, s long, e long")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of `docs`: key, n_bytes, kept (binary), removed (list of first byte and end).

    Keys are integers. Null texts are empty. Texts shorter than `length` lose nothing. Rows with a
    null key are left whole and take nothing from others. Rows equal in key and text count as one
    document and get equal results. Rows with equal keys and different texts are documents of their
    own, in the order of a 64-bit hash of their texts. Extra columns are not read.
    """
    spark = docs.sparkSession
    d = columns_only(docs, key, text).select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.select("k", F.xxhash64("t").alias("x"), "t")
    keyed = d.where("k is not null")
    settled = _settle(_anchors(keyed))
    packed = F.shiftleft("v", 1) + F.col("open").cast("long")
    found = written(settled.select("k", "x", packed.alias("v")).groupBy("k", "x").agg(F.collect_set("v").alias("found")), "contexts")

    # Ranges of suffixes: quantiles of the anchored suffixes of a few documents.
    n_docs = d.count()
    sample = keyed.where(F.pmod(F.xxhash64(F.lit(2), "k"), F.lit(1 << 30)) < int(min(1.0, SPLIT_SAMPLE / max(n_docs, 1)) * (1 << 30)) + 1)

    def starts(batches):
        for b in batches:
            for s, e in small_slices(b, "t"):
                data, offsets = text_bytes(b.column("t").slice(s, e - s))
                raw = data.tobytes()
                yield pa.record_batch([pa.array([raw[i : i + GRAM] for i in np.unique(contexts(data, offsets)["a"]).tolist()], pa.binary())], ["g"])

    parts = block_count(d, "t", 16_000_000)
    grams = sorted({bytes(r["g"]) for r in sample.mapInArrow(starts, "g binary").collect()})
    cuts = [grams[i * len(grams) // parts] for i in range(1, parts)] if grams else []
    cuts = sorted(set(cuts))

    joined = d.join(found, ["k", "x"], "left")
    spans = _merge(_runs(joined.where("exists(found, v -> v % 2 = 1)").select("k", "x", "t", "found"), cuts, length), length)
    spans = spans.groupBy("k", "x").agg(F.collect_set(F.struct("s", "e")).alias("spans"))

    def cut_out(batches):
        for b in batches:
            for s, e in small_slices(b, "t"):
                keys, sizes, kept, removed = [], [], [], []
                for r in b.slice(s, e - s).to_pylist():
                    t = r["t"].encode()
                    ranges = [(x["s"], x["e"]) for x in r["spans"] or ()]
                    ranges += [(v >> 15, (v >> 15) + (v >> 8 & 127) + length) for v in r["found"] or () if not v & 1]
                    merged: list[list[int]] = []
                    for lo, hi in sorted(ranges):
                        if merged and lo <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], hi)
                        else:
                            merged.append([lo, hi])
                    at, pieces = 0, []
                    for lo, hi in merged:
                        pieces.append(t[at:lo])
                        at = hi
                    pieces.append(t[at:])
                    keys.append(r["k"])
                    sizes.append(len(t))
                    kept.append(b"".join(pieces))
                    removed.append([{"first": lo, "end": hi} for lo, hi in merged])
                yield pa.record_batch(
                    [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()),
                     pa.array(removed, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))], ["k", "n_bytes", "kept", "removed"],
                )

    out = joined.join(spans, ["k", "x"], "left").select("k", "t", "found", "spans")
    return out.mapInArrow(cut_out, "k long, n_bytes long, kept binary, removed array<struct<first: long, end: long>>").withColumnRenamed("k", key)

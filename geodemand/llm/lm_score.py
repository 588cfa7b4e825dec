"""Language-model scores by a backoff automaton up to three words.

Counts come from all training texts. Words count from one occurrence on, pairs and triples from two
on, whatever the corpus. The kept n-grams are the states and arcs of an automaton: an arc carries
the discounted log-probability of a word after a history, a failure arc the weight of backing off
to the next shorter history. A text is one walk from left to right that adds up the weights; it ends
with the end token.

No task holds the automaton. Texts are coded into blocks; each block asks for the counts of its own
words, pairs and triples and for the backoff weights of its own histories. Asks are dealt by
64-bit hashes to slots whose number grows with the input, and come back in the asker's order. A
triple is asked for only where both of its pairs are kept, as no other can be. What a kept n-gram
takes from its history is reported by one block of those that hold it; the slot of the history adds
it up. So a frequent word or history is a row per block, never a group of all its occurrences.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodemand.llm.common import blank_words, block_count, columns_only, fold_of, mixed, written
from geodemand.session import parallelism, shared_dir

FOLDS = 10
HELD_OUT = 0
ADDED = 0.1
ORDER = 3
DISCOUNT = 0.75
#: Occurrences from which a pair or triple is kept.
LEAST = 2
BLOCK_BYTES = 6_000_000
WORDS, PAIRS, TRIPLES, AFTER_WORD, AFTER_PAIR = range(5)  # kinds of asks
START, END = b" s", b" e"  # no word holds a blank


@dataclass
class Automaton:
    """The model in one place, for small tables. States are histories; state 0 is the empty one."""

    ids: dict[bytes, int]
    arcs: dict[int, tuple[float, int]] = field(default_factory=dict)  # state * len(ids) + word: weight, next state
    fail: list[int] = field(default_factory=lambda: [-1])
    back: list[float] = field(default_factory=lambda: [0.0])
    to_root: list[float] = field(default_factory=lambda: [0.0])  # sum of the weights down to state 0
    start: int = 0

    def walk(self, words: list[bytes], rest: list[float]) -> float:
        """Log-probability of words and end; `rest` has each word's own for words without arcs."""
        arcs, n, fail, back = self.arcs, len(self.ids), self.fail, self.back
        state, total = self.start, 0.0
        for i, w in enumerate(map(self.ids.get, words)):
            if w is None:
                total += self.to_root[state] + rest[i]
                state = 0
                continue
            arc = arcs.get(state * n + w)
            while arc is None:
                total += back[state]
                state = fail[state]
                arc = arcs.get(state * n + w)
            total += arc[0]
            state = arc[1]
        w = self.ids[END]
        arc = arcs.get(state * n + w)
        while arc is None:
            total += back[state]
            state = fail[state]
            arc = arcs.get(state * n + w)
        return total + arc[0]


def build(ids: dict[bytes, int], unigrams: dict[int, tuple[int, float]], ngrams: list[dict[tuple[int, ...], int]], discount: float = DISCOUNT) -> Automaton:
    """Automaton from kept counts: unigrams {word: (count, probability)}, then one dict for each longer order."""
    a = Automaton(ids)
    n = len(ids)
    state_of: dict[tuple[int, ...], int] = {(): 0}
    followers: dict[tuple[int, ...], dict[int, int]] = {}
    for table in ngrams:
        for gram, count in table.items():
            followers.setdefault(gram[:-1], {})[gram[-1]] = count
    for history in sorted(followers, key=lambda h: (len(h), h)):
        state_of[history] = len(a.fail)
        a.fail.append(0)
        a.back.append(0.0)
        a.to_root.append(0.0)

    def longest(words: tuple[int, ...]) -> int:
        while words not in state_of:
            words = words[1:]
        return state_of[words]

    for w, (_, p) in unigrams.items():
        a.arcs[w] = (log10(p), longest((w,)))
    counts = {(w,): c for w, (c, _) in unigrams.items()}
    for table in ngrams:
        counts |= table

    def probability(history: tuple[int, ...], w: int) -> float:
        state, total = longest(history), 0.0
        while (arc := a.arcs.get(state * n + w)) is None:
            total += a.back[state]
            state = a.fail[state]
        return 10.0 ** (total + arc[0])

    for history, after in sorted(followers.items(), key=lambda x: (len(x[0]), x[0])):
        state = state_of[history]
        a.fail[state] = longest(history[1:])
        seen = max(counts[history], sum(after.values()))
        own = {w: (c - discount) / seen for w, c in after.items()}
        lower = sum(probability(history[1:], w) for w in after)
        a.back[state] = log10(max(1.0 - sum(own.values()), 1e-12) / max(1.0 - lower, 1e-12))
        a.to_root[state] = a.back[state] + a.to_root[a.fail[state]]
        for w, p in own.items():
            a.arcs[state * n + w] = (log10(p), longest((*history, w)))
    a.start = longest((ids[START],))
    return a


def _packed(values: np.ndarray) -> bytes:
    """Counts in a byte each, large ones at the end."""
    return np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype(np.int64).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    values = np.frombuffer(data, np.uint8, n).astype(np.int64)
    large = values == 255
    values[large] = np.frombuffer(data, np.int64, int(large.sum()), n)
    return values


def _packed_hashes(h: np.ndarray) -> bytes:
    """Sorted hashes as differences in as few bytes as the largest one needs."""
    steps = np.diff(h, prepend=np.uint64(0))
    width = max(1, -(-int(steps[1:].max()).bit_length() // 8)) if len(h) > 1 else 1
    return bytes([width]) + steps[:1].tobytes() + np.ascontiguousarray(steps[1:]).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked_hashes(data: bytes, n: int) -> np.ndarray:
    steps = np.zeros((n, 8), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 8, 1)
    steps[1:, : data[0]] = np.frombuffer(data, np.uint8, (n - 1) * data[0], 9).reshape(n - 1, data[0])
    return np.cumsum(steps.view(np.uint64)[:, 0], dtype=np.uint64)


_ASKS = "block long, slot int, n int, hashes binary, data binary"
_REPLIES = "block long, slot int, data binary, owned binary, total long, kinds long"


def _asks(block: int, kind: int, bits: int, hashes: np.ndarray, data) -> Iterator[tuple]:
    """Rows of asks for sorted hashes; data(start, end) packs what goes along."""
    cut = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    ends = np.append(cut[1:], len(hashes))
    for i in np.flatnonzero(ends > cut).tolist():
        s, e = int(cut[i]), int(ends[i])
        yield block, (kind << bits) + i, e - s, _packed_hashes(hashes[s:e]), data(s, e)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _answer(bits: int, least: int):
    """Function that answers the asks of one slot: counts of all blocks and who reports them, or backoff weights."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block"])
        slot, sizes = rows[0]["slot"], [r["n"] for r in rows]
        h = np.concatenate([_unpacked_hashes(r["hashes"], r["n"]) for r in rows])
        order = np.argsort(h, kind="stable")
        new = np.append(True, h[order][1:] != h[order][:-1])
        starts, run_of = np.flatnonzero(new), np.cumsum(new) - 1
        out, cuts = [], np.cumsum([0, *sizes]).tolist()
        if slot >> bits in (WORDS, PAIRS, TRIPLES):
            total = np.add.reduceat(np.concatenate([_unpacked(r["data"], r["n"]) for r in rows])[order], starts)
            told = total if slot >> bits == WORDS else np.where(total >= least, total, 0)
            back, owned = np.empty(len(h), np.int64), np.zeros(len(h), bool)
            back[order] = told[run_of]
            owned[order[starts]] = True
            for i, r in enumerate(rows):
                s, e = cuts[i], cuts[i + 1]
                sums = (int(total.sum()), int((total > 0).sum())) if i == 0 else (0, 0)
                out.append((r["block"], slot, _packed(back[s:e]), np.packbits(owned[s:e]).tobytes(), *sums))
        else:
            taken = np.zeros((2, len(h)))
            for i, r in enumerate(rows):
                n = r["n"]
                own = cuts[i] + np.flatnonzero(np.unpackbits(np.frombuffer(r["data"], np.uint8, -(-n // 8)), count=n))
                taken[:, own] = np.frombuffer(r["data"], np.float64, 2 * len(own), -(-n // 8)).reshape(2, -1)
            mass, lower = (np.add.reduceat(x[order], starts) for x in taken)
            weight = np.log10(np.maximum(1 - mass, 1e-12) / np.maximum(1 - lower, 1e-12))
            back = np.empty(len(h))
            back[order] = weight[run_of]
            out = [(r["block"], slot, back[cuts[i] : cuts[i + 1]].tobytes(), b"", 0, 0) for i, r in enumerate(rows)]
        return _table(out, _REPLIES)

    return run


def _code(texts: list[bytes]) -> tuple[bytes, bytes]:
    """Word numbers of texts end to end, each with start and end, by byte planes; and the words' hashes."""
    ids: dict[bytes, int] = {START: 0, END: 1}
    flat: list[int] = []
    for t in texts:
        flat.append(0)
        flat += [ids.setdefault(w, len(ids)) for w in blank_words(t)]
        flat.append(1)
    planes = np.array(flat, np.int32).view(np.uint8).reshape(-1, 4).T
    return planes.tobytes(), b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in ids)


class _Block:
    """A coded block: at each place its word, and the pair and triple that end there, with what is known of them."""

    def __init__(self, ids: bytes, words: bytes, held_out: list[bool], replies: list[dict], bits: int, order: int):
        planes = np.frombuffer(ids, np.uint8).reshape(4, -1).T
        self.flat = np.ascontiguousarray(planes).view(np.int32)[:, 0].astype(np.int64)
        self.hash = np.frombuffer(words, np.uint64)
        self.train = ~np.array(held_out, bool)[np.cumsum(self.flat == 0) - 1]
        self.order, self.bits = order, bits
        self.of: dict[int, list[dict]] = {}
        for r in sorted(replies, key=lambda r: r["slot"]):
            self.of.setdefault(r["slot"] >> bits, []).append(r)
        self.by_hash = np.argsort(self.hash[1:]) + 1  # words without the start
        self.pair_at = np.flatnonzero(self.flat != 0) if order >= 2 else np.zeros(0, np.int64)
        pair = mixed(self.hash[self.flat[self.pair_at - 1]] * np.uint64(0x9E3779B97F4A7C15) + self.hash[self.flat[self.pair_at]])
        self.pairs, first, inverse = np.unique(pair, return_index=True, return_inverse=True)
        self.first_pair = self.pair_at[first]
        self.pair_of = np.full(len(self.flat), -1)
        self.pair_of[self.pair_at] = inverse

    def count(self, kind: int, n: int) -> np.ndarray:
        """Counts of the words, pairs or triples in the order of their hashes."""
        sizes = self._sizes(kind)
        found = [_unpacked(r["data"], m) for r, m in zip(self.of.get(kind, []), sizes, strict=True)]
        return np.concatenate([np.zeros(0, np.int64), *found]) if n else np.zeros(0, np.int64)

    def owned(self, kind: int) -> np.ndarray:
        bits = [np.unpackbits(np.frombuffer(r["owned"], np.uint8), count=m).astype(bool) for r, m in zip(self.of.get(kind, []), self._sizes(kind), strict=True)]
        return np.concatenate([np.zeros(0, bool), *bits])

    def _sizes(self, kind: int) -> list[int]:
        h = {WORDS: lambda: self.hash[self.by_hash], PAIRS: lambda: self.pairs, TRIPLES: lambda: self.triples}[kind]()
        return np.unique(h >> np.uint64(64 - self.bits), return_counts=True)[1].tolist()

    def weights(self, kind: int, n: int, asked: np.ndarray) -> np.ndarray:
        """Backoff weights of histories; 0 for those not asked for."""
        out = np.zeros(n)
        if len(asked):
            out[asked] = np.concatenate([np.frombuffer(r["data"], np.float64) for r in self.of[kind]])
        return out

    def learn(self, below: float) -> None:
        """What the replies on words and pairs tell."""
        self.words = np.zeros(len(self.hash), np.int64)
        self.words[self.by_hash] = self.count(WORDS, len(self.by_hash))
        self.rate = (self.words + ADDED) / below
        self.words[0] = self.words[1]  # a start for every end
        self.kept = self.count(PAIRS, len(self.pairs))
        here = np.where(self.pair_of >= 0, self.kept[self.pair_of], 0) if len(self.kept) else np.zeros(len(self.flat), np.int64)
        self.here = here
        self.triple_at = np.flatnonzero((here[1:] > 0) & (here[:-1] > 0)) + 1 if self.order >= 3 else np.zeros(0, np.int64)
        h = mixed(self.pairs[self.pair_of[self.triple_at - 1]] * np.uint64(0xD1342543DE82EF95) + self.hash[self.flat[self.triple_at]])
        self.triples, first, self.triple_of = np.unique(h, return_index=True, return_inverse=True)
        self.first_triple = self.triple_at[first]
        many = np.flatnonzero(self.words >= 1)
        self.word_histories = many[np.argsort(self.hash[many])] if self.order >= 2 else many[:0]
        self.pair_histories = np.flatnonzero((self.kept > 0) & (self.flat[self.first_pair] != 1)) if self.order >= 3 else self.word_histories[:0]

    def counted(self, at: np.ndarray, inverse: np.ndarray, n: int):
        times = np.bincount(inverse[self.train[at]], minlength=n)
        return lambda s, e: _packed(times[s:e])

    def taken(self, asked: np.ndarray, history: np.ndarray, own: np.ndarray, lower: np.ndarray, n: int):
        """What this block reports of the histories it asks for."""
        sums = np.stack([np.bincount(history, x, n)[asked] for x in (own, lower)])
        some = sums[0] > 0
        return lambda s, e: np.packbits(some[s:e]).tobytes() + sums[:, s:e][:, some[s:e]].tobytes()

    def first_asks(self, block: int) -> Iterator[tuple]:
        place = np.zeros(len(self.hash), np.int64)
        place[self.by_hash] = np.arange(len(self.by_hash))
        at = np.flatnonzero(self.flat != 0)
        yield from _asks(block, WORDS, self.bits, self.hash[self.by_hash], self.counted(at, place[self.flat[at]], len(self.by_hash)))
        yield from _asks(block, PAIRS, self.bits, self.pairs, self.counted(self.pair_at, self.pair_of[self.pair_at], len(self.pairs)))

    def second_asks(self, block: int) -> Iterator[tuple]:
        yield from _asks(block, TRIPLES, self.bits, self.triples, self.counted(self.triple_at, self.triple_of, len(self.triples)))
        mine = self.owned(PAIRS) & (self.kept > 0)
        at = self.first_pair[mine]
        history = self.flat[at - 1]
        own = (self.kept[mine] - DISCOUNT) / self.words[history]
        told = self.taken(self.word_histories, history, own, self.rate[self.flat[at]], len(self.hash))
        yield from _asks(block, AFTER_WORD, self.bits, self.hash[self.word_histories], told)

    def third_asks(self, block: int) -> Iterator[tuple]:
        kept = self.count(TRIPLES, len(self.triples))
        mine = self.owned(TRIPLES) & (kept > 0)
        at = self.first_triple[mine]
        history = self.pair_of[at - 1]
        own = (kept[mine] - DISCOUNT) / self.kept[history]
        told = self.taken(self.pair_histories, history, own, (self.here[at] - DISCOUNT) / self.words[self.flat[at - 1]], len(self.pairs))
        yield from _asks(block, AFTER_PAIR, self.bits, self.pairs[self.pair_histories], told)

    def scores(self) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score and score of each text."""
        at = np.flatnonzero(self.flat != 0)
        text = (np.cumsum(self.flat == 0) - 1)[at]
        n = int(text[-1]) + 1
        word, last, here = self.flat[at], self.flat[at - 1], self.here[at]
        base = np.log10(self.rate[word])
        total = np.where(
            here > 0, np.log10((np.maximum(here, 1) - DISCOUNT) / np.maximum(self.words[last], 1)),
            self.weights(AFTER_WORD, len(self.hash), self.word_histories)[last] + base,
        )
        if self.order >= 3 and len(self.pairs):
            kept = np.zeros(len(self.flat), np.int64)
            if len(self.triples):
                kept[self.triple_at] = self.count(TRIPLES, len(self.triples))[self.triple_of]
            back = self.weights(AFTER_PAIR, len(self.pairs), self.pair_histories)
            back = np.where(last != 0, back[self.pair_of[at - 1]], 0.0)
            total = np.where(kept[at] > 0, np.log10((np.maximum(kept[at], 1) - DISCOUNT) / np.maximum(self.here[at - 1], 1)), back + total)
        sums = lambda x: np.bincount(text, x, n)
        return np.bincount(text, minlength=n), np.bincount(text[self.words[word] > 0], minlength=n), sums(base), sums(total)


def _in_buckets(df: DataFrame, key: str, name: str) -> DataFrame:
    """Write to the shared folder by hash of a key, so that later rounds meet it without moving it again."""
    spark = df.sparkSession
    table = f"llm_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(parallelism(spark), key).option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only, the files stay
    return out


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs`: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The end token counts as a token everywhere. Null and empty texts are the end token alone.
    Without training texts every word has the added count only. Repeated rows count as often as
    they stand; a null key counts as empty text for its fold; extra columns are not read. Pairs and
    triples of fewer than `least` occurrences are not kept.
    """
    d = columns_only(docs, key, text).select(
        F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), (fold_of(F.col(key), FOLDS) == HELD_OUT).alias("held_out")
    )
    kind = docs.schema[key].dataType.simpleString()
    bits = max(1, int(block_count(d, "t", block_bytes) - 1).bit_length())

    def code(batches):
        held: list[pa.RecordBatch] = []
        size, made = 0, 0

        def out():
            nonlocal made
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, words = _code(rows.column("t").to_pylist())
            block = (TaskContext.get().partitionId() << 32) + made
            made += 1
            ends = pa.array([0, len(rows)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.concat_arrays(rows.column(c).chunks)) for c in ("k", "held_out")]
            return pa.record_batch([pa.array([block]), *lists, pa.array([ids], pa.binary()), pa.array([words], pa.binary())], ["block", "k", "held_out", "ids", "words"])

        for b in batches:
            start = 0
            for i, n in enumerate(pc.binary_length(b.column("t")).to_pylist()):
                size += n
                if size >= block_bytes:
                    held.append(b.slice(start, i + 1 - start))
                    yield out()
                    held.clear()
                    start, size = i + 1, 0
            if start < len(b):
                held.append(b.slice(start))
        if held:
            yield out()

    # Written once, so that every round sees the same blocks however the rows of `docs` come.
    coded = _in_buckets(d.mapInArrow(code, f"block long, k array<{kind}>, held_out array<boolean>, ids binary, words binary"), "block", "coded")

    def first(batches):
        for b in batches:
            for r in b.to_pylist():
                rows = list(_Block(r["ids"], r["words"], r["held_out"], [], bits, order).first_asks(r["block"]))
                yield from _table(rows, _ASKS).to_batches()

    def answered(asks: DataFrame, name: str) -> DataFrame:
        return written(asks.groupBy("slot").applyInArrow(_answer(bits, least), _REPLIES), name)

    known = answered(coded.select("block", "held_out", "ids", "words").mapInArrow(first, _ASKS), "counts")
    n_all, v_all = known.where(F.shiftright("slot", bits) == WORDS).agg(F.sum("total"), F.sum("kinds")).first()
    n_all, v_all = n_all or 0, v_all or 0
    below = n_all + ADDED * (v_all + 1)

    def met(texts: pa.Table, replies: pa.Table) -> tuple[_Block, dict]:
        r = texts.to_pylist()[0]
        block = _Block(r["ids"], r["words"], r["held_out"], replies.to_pylist(), bits, order)
        block.learn(below)
        return block, r

    def second(texts: pa.Table, replies: pa.Table) -> pa.Table:
        block, r = met(texts, replies)
        return _table(list(block.second_asks(r["block"])), _ASKS)

    def third(texts: pa.Table, replies: pa.Table) -> pa.Table:
        block, r = met(texts, replies)
        return _table(list(block.third_asks(r["block"])), _ASKS)

    def last(texts: pa.Table, replies: pa.Table) -> pa.Table:
        block, _ = met(texts, replies)
        n_tokens, n_known, base, total = block.scores()
        keys, out = (pa.concat_arrays([c.flatten() for c in texts.column(x).chunks]) for x in ("k", "held_out"))
        return pa.table([keys, out, pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(total)], ["k", "held_out", "n_tokens", "n_known", "base_score", "score"])

    def meet(run, schema: str, *columns: str) -> DataFrame:
        told = known.select("block", "slot", "data", "owned")
        return coded.select("block", *columns, "held_out", "ids", "words").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)

    for run, name in ((second, "triples"), (third, "backoff")):
        known = known.unionAll(answered(meet(run, _ASKS), name))
    scored = meet(last, f"k {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double", "k")
    return scored.select(F.col("k").alias(key), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")

"""Best-fit packing of documents into sequences of a fixed number of tokens, large items first.

Lengths are whole numbers up to the capacity, so how many documents of each length go where is
decided from the counts per length alone: at most `capacity` numbers, whatever the corpus.

1. Documents above a third of the capacity stand at most twice in a sequence. They are matched
   greedily: the longest left takes the longest left that still fits beside it.
2. The smaller ones follow, longest first, each into the smallest gap that holds it (best fit),
   and into fresh sequences when none does.

Sequences with equal gaps are handled as runs, and every step that fills a run at least halves its
gap, so the plan is a short table: for a range of documents of one length, the sequences they go
to and the place inside. Documents are numbered among those of their length (long lists split into
buckets that are numbered apart and shifted), and look their place up in the plan.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geodemand.llm import bpe
from geodemand.llm.common import by_slices, columns_only, written

CAPACITY = 4096
END = 1  # the token behind every document
BUCKET_ROWS = 4_000  # documents of one length that are numbered in one group
KEPT_PIECES = 600_000  # encoded pieces and words a worker keeps; beyond, the older half goes


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids of texts by the library's own model, with every piece between white space encoded once.

    White space ends a piece for every step of the vocabulary, so a text is its pieces in order.
    """

    def __init__(self, vocabulary: bpe.Vocabulary):
        self.vocabulary, self.model = vocabulary, vocabulary.tokenizer.model
        self.letters = {i: c for i, c in enumerate(bpe._byte_letters())}
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def word(self, word: str | int) -> bytes:
        got = self.words.get(word)
        if got is None:
            if isinstance(word, int):  # a special token
                return word.to_bytes(4, "little")
            text = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
            got = self.words[word] = _packed([t.id for t in self.model.tokenize(text)])
        return got

    def piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            words = self.vocabulary.words_of(piece)
            got = self.pieces[piece] = self.word(words[0]) if len(words) == 1 else b"".join(map(self.word, words))
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit integers."""
        for kept in (self.pieces, self.words):
            if len(kept) > KEPT_PIECES:
                for k in list(kept)[: len(kept) // 2]:
                    del kept[k]
        out, known = [], self.pieces.get
        for t in texts:
            pieces = self.vocabulary.pieces_of(t)
            got = list(map(known, pieces))
            if None in got:
                got = [self.piece(p) if g is None else g for p, g in zip(pieces, got, strict=True)]
            out.append(b"".join(got))
        return out


_ENCODERS: dict[int, Encoder] = {}


def encoder(text: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    v = bpe.vocabulary(text)
    return _ENCODERS.setdefault(id(v), Encoder(v))


class Plan:
    """Runs of sequences, and the ranges of documents of one length that go into them.

    A range says: the documents numbered from `rank` on go to the sequences from `first` on,
    `each` to a sequence, one behind the other from `offset` on.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.sequences = capacity, 0
        self.ranges: list[tuple[int, int, int, int, int]] = []  # length, rank, first, each, offset
        self.next = dict.fromkeys(counts, 0)
        self.gaps: list[int] = []  # gaps that some run has, ascending
        self.runs: dict[int, list[tuple[int, int]]] = {}  # gap: runs as (first sequence, number)
        self._match({n: c for n, c in counts.items() if 3 * n > capacity and c})
        for n in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
            self._best_fit(n, counts[n])

    def _put(self, length: int, first: int, each: int, offset: int, documents: int) -> None:
        self.ranges.append((length, self.next[length], first, each, offset))
        self.next[length] += documents

    def _run(self, gap: int, first: int, number: int) -> None:
        if number:
            if gap not in self.runs:
                self.runs[gap] = []
                insort(self.gaps, gap)
            self.runs[gap].append((first, number))

    def _take(self, gap: int) -> tuple[int, int]:
        run = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap]
            self.gaps.pop(bisect_left(self.gaps, gap))
        return run

    def _match(self, left: dict[int, int]) -> None:
        """Pairs of large documents, the longest first with the longest that fits beside it."""
        lengths = sorted(left)
        while lengths:
            n = lengths[-1]
            at = bisect_left(lengths, self.capacity - n + 1) - 1
            partner = lengths[at] if at >= 0 else None
            if partner is None:
                number = left[n]
            else:
                number = left[n] // 2 if partner == n else min(left[n], left[partner])
                if number == 0:  # a single one of a length that fits with itself
                    partner = lengths[at - 1] if at > 0 else None
                    number = min(left[n], left[partner]) if partner is not None else left[n]
            first, self.sequences = self.sequences, self.sequences + number
            self._put(n, first, 1, 0, number)
            left[n] -= number
            if partner is not None:
                self._put(partner, first, 1, n, number)
                left[partner] -= number
            self._run(self.capacity - n - (partner or 0), first, number)
            lengths = [x for x in lengths if left[x]]

    def _best_fit(self, n: int, documents: int) -> None:
        while documents:
            at = bisect_left(self.gaps, n)
            if at < len(self.gaps):
                gap = self.gaps[at]
                first, number = self._take(gap)
            else:
                gap, first, number = self.capacity, self.sequences, -(-documents // (self.capacity // n))
                self.sequences += number
            each = gap // n
            full = min(number, documents // each)
            if full:
                self._put(n, first, each, self.capacity - gap, full * each)
                self._run(gap - n * each, first, full)
                documents -= full * each
                first, number = first + full, number - full
            if number and 0 < documents < each:
                self._put(n, first, documents, self.capacity - gap, documents)
                self._run(gap - n * documents, first, 1)
                documents, first, number = 0, first + 1, number - 1
            self._run(gap, first, number)

    def table(self) -> np.ndarray:
        """The ranges by length and rank."""
        return np.array(sorted(self.ranges), np.int64).reshape(-1, 5)


def cut_pieces(docs: DataFrame, path: str, capacity: int, end: int, key: str, text: str, with_ids: bool) -> DataFrame:
    """Key, piece, start, length, ids_crc32 and, if asked for, ids of every piece."""
    with open(path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    tail = int(end).to_bytes(4, "little")

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        at, number, crcs, lengths, ids = [], [], [], [], []
        for i, got in enumerate(encoder(sent.value).encode([t or "" for t in b.column(text).to_pylist()])):
            got += tail
            for j, s in enumerate(range(0, len(got), 4 * capacity)):
                piece = got[s : s + 4 * capacity]
                at.append(i)
                number.append(j)
                lengths.append(len(piece) // 4)
                crcs.append(zlib.crc32(piece))
                if with_ids:
                    ids.append(np.frombuffer(piece, "<u4").astype(np.int64))
        number = np.array(number, np.int64)
        columns = [
            b.column(key).take(pa.array(at, pa.int64())), pa.array(number.astype(np.int32)), pa.array(number * capacity),
            pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()),
        ]
        return pa.record_batch(columns + [pa.array(ids, pa.list_(pa.int64()))] * with_ids, names)

    names = [key, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return columns_only(docs, key, text).mapInArrow(by_slices(work, text), schema)


def numbered(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """`pieces` with _rank, a number from 0 among the pieces of the same length.

    Lengths with many pieces are split into buckets by a hash of the row; each bucket is numbered
    by itself and shifted by the sizes of those before.
    """
    spark = pieces.sparkSession
    ways = spark.createDataFrame([(n, -(-c // BUCKET_ROWS)) for n, c in counts.items()], "length long, _ways long")
    dealt = pieces.join(F.broadcast(ways), "length").withColumn("_bucket", F.pmod(F.xxhash64("_row"), "_ways")).drop("_ways")
    sizes = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket")
    shift = sizes.select("length", "_bucket", (F.sum("_n").over(before) - F.col("_n")).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_row")) - 1
    return dealt.withColumn("_in", inside).join(shift, ["length", "_bucket"]).withColumn("_rank", F.col("_in") + F.col("_shift")).drop("_in", "_shift", "_bucket")


def place(pieces: DataFrame, counts: dict[int, int], capacity: int) -> DataFrame:
    """Numbered pieces with sequence_id and offset, looked up in the plan of the counts."""
    spark = pieces.sparkSession
    sent = spark.sparkContext.broadcast(Plan(counts, capacity).table())

    def run(batches):
        t = sent.value
        keys = t[:, 0] << 44 | t[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            _, start, first, each, offset = t[at].T
            n = rank - start
            yield pa.record_batch(
                [*b.columns, pa.array(first + n // each), pa.array(offset + n % each * length)], [*b.schema.names, "sequence_id", "offset"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return pieces.mapInArrow(run, schema)


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, key: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset, and the ids if asked for.

    A document is its ids by the vocabulary file at `path` and the id `end`; null and empty texts
    are the end alone. Only documents of more than `capacity` ids are cut, into pieces of that
    many; the last may be shorter. Sequences hold at most `capacity` ids, their pieces stand
    gapless from 0 on. Rows are told apart by a row number, so null and repeated keys and repeated
    rows are documents of their own; other columns are not read. An empty table gives no rows.

    To the driver come the number of pieces of each length, at most `capacity` numbers; the plan
    made of them is sent to the tasks. Its size depends on the capacity only.
    """
    cut = cut_pieces(docs, path, capacity, end, key, text, with_ids)
    names = cut.columns
    cut = written(cut.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    out = place(numbered(cut, counts), counts, capacity)
    return out.select(*names[:5], "sequence_id", "offset", *names[5:])


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of every sequence of pieces that were packed with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))

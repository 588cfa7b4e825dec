"""BPE encoding and decoding with an index of pair occurrences.

White space ends a piece of text for every step of the vocabulary (normalization, splitting,
merging), so a text is the sequence of its pieces, and each task encodes every distinct piece once.
The distinct words of the pieces new to a task are laid out in one array of symbols. An index maps
each pair's rank to all positions in the array where the pair stands; ranks are applied in ascending
order at all positions at once, and the lists of the neighbouring pairs are updated. A pair that a
merge makes always ranks after it, so one ascending pass is enough.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geodemand.llm.common import by_slices, columns_only

REMEMBERED = 300_000  # pieces and words that a task keeps; beyond, the older half goes
_SPACE = regex.compile(r"\s+")
_PYTHON_ONLY_SPACE = re.compile("[\x1c-\x1f]")
# Pieces of ASCII and Latin letters that no step but lower-casing changes, and their words.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]*")
_PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017e]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017e]+")


def _byte_letters() -> list[str]:
    """Visible stand-ins of the 256 bytes: printable Latin-1 stays, the rest follow from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(shifted)) for b in range(256)]


class Vocabulary:
    """Tables of a BPE vocabulary file with word ends, and the pieces encoded so far."""

    def __init__(self, text: str):
        model = json.loads(text)["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.tokenizer = Tokenizer.from_str(text)
        self.special = {t["content"]: t["id"] for t in json.loads(text)["added_tokens"]}
        self.token = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[a] << 20 | self.ids[b]] = (rank, self.ids[a + b])
        self.pair_of = {rank: (key >> 20, key & 0xFFFFF, new) for key, (rank, new) in self.merges.items()}
        letters, end = _byte_letters(), model["end_of_word_suffix"]
        self.first = [self.ids[c] for c in letters]
        self.last = [self.ids[c + end] for c in letters]
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words: dict[str, tuple[bytes, str]] = {}
        self.pieces: dict[str, tuple[bytes, str]] = {}

    def words_of(self, piece: str) -> list[str | int]:
        """Words of a piece in order; special tokens as their ids."""
        if piece.isascii() and piece.isalpha():
            return [piece.lower()]
        if _PLAIN.fullmatch(piece) and "<|" not in piece:
            return _PLAIN_WORDS.findall(piece.lower())
        out: list[str | int] = []
        for part in self.split_special.split(piece) if self.split_special else [piece]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                clear = self.tokenizer.normalizer.normalize_str(part)
                out += [clear[s:e] for _, (s, e) in self.tokenizer.pre_tokenizer.pre_tokenize_str(clear)]
        return out

    def merge(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word, merging in all of them at once through the pair occurrence index."""
        symbols: list[int] = []
        starts = []
        for w in words:
            starts.append(len(symbols))
            raw = w.encode()
            symbols += [self.first[b] for b in raw[:-1]]
            symbols += (self.last[raw[-1]], -1)
        n, merges = len(symbols), self.merges
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for i in range(n - 1):
            m = merges.get(symbols[i] << 20 | symbols[i + 1]) if symbols[i] >= 0 <= symbols[i + 1] else None
            if m:
                index.setdefault(m[0], []).append(i)
        ranks = list(index)
        heapq.heapify(ranks)
        while ranks:
            rank = heapq.heappop(ranks)
            left, right, new = self.pair_of[rank]
            positions = index.pop(rank)
            positions.sort()
            for i in positions:
                j = after[i]
                if symbols[i] != left or symbols[j] != right:
                    continue  # a neighbour has been merged since
                symbols[i], symbols[j] = new, -2
                k = after[j]
                after[i], before[k] = k, i
                h = before[i]
                for at, key in ((h, symbols[h] << 20 | new if h >= 0 and symbols[h] >= 0 else -1), (i, new << 20 | symbols[k] if symbols[k] >= 0 else -1)):
                    m = merges.get(key)
                    if m:
                        if m[0] in index:
                            index[m[0]].append(at)
                        else:
                            index[m[0]] = [at]
                            heapq.heappush(ranks, m[0])
        out = []
        for s in starts:
            ids, i = [], s
            while symbols[i] != -1:
                ids.append(symbols[i])
                i = after[i]
            out.append(tuple(ids))
        return out

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that are not remembered yet."""
        for kept in (self.pieces, self.words):
            if len(kept) > REMEMBERED:
                for k in list(kept)[: len(kept) // 2]:
                    del kept[k]
        new = [p for p in pieces if p not in self.pieces]
        split = {p: self.words_of(p) for p in new}
        missing = list({w for ws in split.values() for w in ws if isinstance(w, str) and w not in self.words})
        self.words.update((w, self.both(ids)) for w, ids in zip(missing, self.merge(missing), strict=True))
        for p, ws in split.items():
            got = [self.both((w,)) if isinstance(w, int) else self.words[w] for w in ws]
            self.pieces[p] = got[0] if len(got) == 1 else (b"".join([g[0] for g in got]), " ".join([g[1] for g in got]))

    def both(self, ids) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and their text."""
        return struct.pack(f"<{len(ids)}I", *ids), self.decode(ids)

    def decode(self, ids) -> str:
        """Tokens by single blanks, as for a vocabulary file that names no decoder."""
        return " ".join([self.token[i] for i in ids])

    @staticmethod
    def pieces_of(text: str) -> list[str]:
        """What stands between white space."""
        return [p for p in _SPACE.split(text) if p] if _PYTHON_ONLY_SPACE.search(text) else text.split()

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit integers, and the decoded text."""
        cut = [self.pieces_of(t) for t in texts]
        self.learn({p for ps in cut for p in ps})
        out = []
        for ps in cut:
            got = [self.pieces[p] for p in ps]
            out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]])))
        return out


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(text: str) -> Vocabulary:
    """One set of tables for each worker process and file."""
    name = hashlib.sha256(text.encode()).hexdigest()
    if name not in _LOADED:
        _LOADED[name] = Vocabulary(text)
    return _LOADED[name]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of `docs`: key, n_tokens, ids_sha256, decoded_sha256, and the ids if asked for.

    `path` is the vocabulary file on the driver; its text (a few MB) is sent to the tasks. Null and
    empty texts have no tokens. Repeated rows give repeated results; other columns are not read.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        found = vocabulary(sent.value).encode([t or "" for t in b.column(text).to_pylist()])
        columns = [
            b.column(key),
            pa.array([len(i) // 4 for i, _ in found], pa.int64()),
            pa.array([hashlib.sha256(i).hexdigest() for i, _ in found], pa.string()),
            pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in found], pa.string()),
        ]
        if with_ids:
            columns.append(pa.array([memoryview(i).cast("I").tolist() for i, _ in found], pa.list_(pa.int64())))
        return pa.record_batch(columns, names + ["ids"] * with_ids)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids
    return columns_only(docs, key, text).mapInArrow(by_slices(work, text), schema)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Key and text of rows of ids; a null list gives empty text."""
    with open(path, encoding="utf-8") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        for b in batches:
            v = vocabulary(sent.value)
            yield pa.record_batch([b.column(key), pa.array([v.decode(x or []) for x in b.column(ids).to_pylist()], pa.string())], [key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {kind}, text string")

"""Ranked lexical search, term at a time with a limit on accumulators.

Every task holds an inverted index over a run of documents and answers all items against it. The
terms of an item come rarest first. As long as a document that no earlier term has named could still
reach the k-th best score, its terms open an accumulator for it; once the bounds of the terms left add up
to less than the k-th partial score (or the k-th score of the runs before), no accumulator is opened any
more, and the terms left only update those that exist, exactly. What a run gives is its best k; the best
k of all runs are the answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geodemand.llm.common import ALNUM, alnum_words, by_slices, columns_only, text_bytes, written

BLOCK_BYTES = 8 << 20  # text of the items that are answered in one pass over the documents
RUN_DOCS = 20_000  # documents in one index
RUN_POSTINGS = 4_000_000  # and postings in it


def postings(docs: DataFrame, terms: dict[bytes, int], key: str, text: str) -> DataFrame:
    """Per document its key, number of terms, and the ids and counts of the given terms it holds."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)
    table = bytes(ALNUM)

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        get, sizes, found, at = sent.value.get, [], [], []
        data, offsets = text_bytes(b.column(text))
        data, n = data.tobytes(), len(offsets) - 1
        for i in range(n):
            words = data[offsets[i] : offsets[i + 1]].translate(table).split()
            sizes.append(len(words))
            ids = [t for t in map(get, words) if t is not None]
            found += ids
            at.append(len(found))
        owner = np.repeat(np.arange(n), np.diff(np.array([0, *at], np.int64)))
        both, count = np.unique(owner << 32 | np.array(found, np.int64), return_counts=True)
        ends = np.concatenate(([0], np.cumsum(np.bincount(both >> 32, minlength=n))))
        lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (both & 0xFFFFFFFF, count)]
        return pa.record_batch([b.column(key), pa.array(sizes, pa.int64()), *lists], [key, "n", "terms", "tfs"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.mapInArrow(by_slices(work, text), f"`{key}` {kind}, n long, terms array<int>, tfs array<int>")


def statistics(found: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and in how many documents each given term is."""

    def run(batches):
        held = np.zeros(n_terms, np.int64)
        for b in batches:
            held += np.bincount(pc.list_flatten(b.column("terms")).to_numpy(), minlength=n_terms)
        at = np.flatnonzero(held)
        yield pa.record_batch([pa.array(at), pa.array(held[at])], ["term", "df"])

    n, words = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(n_terms, np.int64)
    for r in found.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    return n, words, df


def norm(n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """100 - 90 + ((90 * n * documents) div words), in whole numbers."""
    if 90 * int(n.max(initial=0)) * documents < 1 << 63:
        return 10 + 90 * n * documents // words
    return np.array([10 + 90 * int(x) * documents // words for x in n], np.int64)


class Run:
    """Inverted index over some documents: term to their places and impacts, both as array slices."""

    def __init__(self, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, documents: int, words: int):
        self.size = len(n)
        doc = np.repeat(np.arange(self.size), np.diff(ends))
        order = np.argsort(terms, kind="stable")
        self.docs = doc[order]
        tf = tfs[order].astype(np.int64)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * norm(n, documents, words)[self.docs])
        self.terms, first = np.unique(terms[order], return_index=True)
        self.ends = np.append(first, len(order))
        self.most = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0, np.int64)

    def best(self, wanted: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best k documents for terms given rarest first; none under `least`."""
        at = np.searchsorted(self.terms, wanted)
        here = np.flatnonzero((at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == wanted)) if len(self.terms) else []
        at, weights = at[here], weights[here]
        rest = int((weights * self.most[at]).sum())
        score = np.zeros(self.size, np.int64)
        opening, opened = True, []
        for t, w in zip(at.tolist(), weights.tolist(), strict=True):
            s = slice(self.ends[t], self.ends[t + 1])
            docs = self.docs[s]
            if opening and rest < max(least, kth(score, opened, k, rest)):
                opening = False
            if opening:
                score[docs] += w * self.impact[s]
                opened.append(docs)
            else:
                old = score[docs] > 0
                score[docs[old]] += w * self.impact[s][old]
            rest -= w * int(self.most[t])
        return top(score, k, max(least, 1))


def kth(score: np.ndarray, opened: list[np.ndarray], k: int, rest: int) -> int:
    """The k-th best partial score, or 0 where it can't be above `rest`."""
    if not opened or int(score.max()) <= rest or np.count_nonzero(score > rest) < k:
        return 0
    return int(np.partition(score, len(score) - k)[len(score) - k])


def top(score: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the best k that have `least`, equal scores by place."""
    at = np.flatnonzero(score >= least)
    if len(at) > k:
        edge = np.partition(score[at], len(at) - k)[len(at) - k]
        above, equal = at[score[at] > edge], at[score[at] == edge]
        at = np.concatenate((above, equal[: k - len(above)]))
    at = at[np.lexsort((at, -score[at]))]
    return at, score[at]


def joined(batches: list[pa.RecordBatch], key: str) -> pa.RecordBatch:
    """One batch in the order of the key, nulls last."""
    t = pa.Table.from_batches(batches).combine_chunks()
    t = t.take(pc.sort_indices(t, sort_keys=[(key, "ascending")], null_placement="at_end"))
    return t.combine_chunks().to_batches()[0]


def answers(found: DataFrame, asked: list[tuple[int, np.ndarray, np.ndarray]], documents: int, words: int, k: int, key: str) -> DataFrame:
    """The best k of every task for every item: _item, score and key.

    `asked` has the number of an item, its terms rarest first, and their weights.
    """
    sent = found.sparkSession.sparkContext.broadcast(asked)
    kind = found.schema[key].dataType.simpleString()

    def search(run: pa.RecordBatch, least: dict[int, list[int]]):
        lists = [run.column(c) for c in ("terms", "tfs")]
        terms, tfs = (pc.list_flatten(x).to_numpy() for x in lists)
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists[0]).to_numpy())))
        index = Run(run.column("n").to_numpy(), ends, terms, tfs, documents, words)
        items, places, scores = [], [], []
        for item, wanted, weights in sent.value:
            known = least.setdefault(item, [])
            at, got = index.best(wanted, weights, k, known[0] if len(known) == k else 0)
            least[item] = sorted([*known, *got.tolist()])[-k:]
            items += [item] * len(at)
            places.append(at)
            scores.append(got)
        at, got = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (places, scores))
        return pa.record_batch([pa.array(items, pa.int64()), pa.array(got), run.column(key).take(pa.array(at))], ["_item", "score", key])

    def work(batches):
        least: dict[int, list[int]] = {}
        held, docs, size = [], 0, 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                docs, size = docs + b.num_rows, size + len(pc.list_flatten(b.column("terms")))
            if docs >= RUN_DOCS or size >= RUN_POSTINGS:
                yield search(joined(held, key), least)
                held, docs, size = [], 0, 0
        if held:
            yield search(joined(held, key), least)

    return found.mapInArrow(work, f"_item long, score long, `{key}` {kind}")


def weight_of(documents: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """item key, rank, document key and score of the best k documents of every item.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, only A-Z lower-cased. A document
    scores the sum over the item's distinct terms of w * ((10^9 * tf) div (1000 * tf + 8 * m)), with
    w = floor(1000 * ln((2N + 2) / (2df + 1))) and m = 10 + (90 * n * N) div L; rows without a term are
    not counted in N. Equal scores rank by key, null last. Documents at 0 are not returned; items without
    terms, or with null text, have no rows. Every row is a document, and every row of `items` an item, of
    its own, so repeated rows and keys give repeated results. Other columns are not read.

    Items are taken in blocks of about `block_bytes` of text, all of them, with one pass over the
    documents per block: the terms of one block are sent to the tasks. Postings keep those terms only.
    """
    spark = docs.sparkSession
    docs, items = columns_only(docs, key, text), columns_only(items, item_key, item_text)
    items = written(items.withColumn("_item", F.monotonically_increasing_id()), "items")
    total = items.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    out = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == block).select("_item", item_text).collect()
        wanted = {r[0]: set(alnum_words(r[1])) for r in rows}
        terms = {t: i for i, t in enumerate(sorted(set().union(*wanted.values())))}
        found = written(postings(docs, terms, key, text), "postings")
        n, words, df = statistics(found, len(terms))
        weights = weight_of(n, df)
        asked = []
        for item, ws in wanted.items():
            ids = np.array(sorted(terms[w] for w in ws), np.int64)
            ids = ids[(df[ids] > 0) & (weights[ids] > 0)]
            ids = ids[np.argsort(df[ids], kind="stable")]
            asked.append((item, ids, weights[ids]))
        some = answers(found, asked, n, words, k, key)
        out = some if out is None else out.unionByName(some)
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last(F.col(key)))
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best = best.select("_item", "rank", F.col(key).alias("_key"), "score")
    return best.join(items.select("_item", F.col(item_key).alias("_asked")), "_item").select(
        F.col("_asked").alias(item_key), "rank", F.col("_key").alias(key), "score"
    )

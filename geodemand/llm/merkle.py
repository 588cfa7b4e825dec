"""Document fingerprints: Merkle trees over sections, paragraphs and phrases.

A phrase is up to six words, ending at punctuation or the end of its line; a paragraph is a line; a
section ends after a paragraph whose own digest says so (one in eight), so that an edit moves no
border but near itself. Roots are equal exactly if texts are; comparing two trees from the root
down finds the paragraphs that differ. The fingerprint is text: the root, then for each section its
digest and its paragraphs with their phrases, so that two fingerprints can be compared alone.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geodemand.llm.common import by_slices, columns_only, small_slices
from geodemand.session import parallelism

_PHRASE = re.compile(r"(?:[^\n.!?,;:|\s]+[^\S\n]*){1,6}[.!?,;:|]*[^\S\n]*|[.!?,;:|\s]+")
SHORT = 8  # hex digits that a node below the root keeps in the fingerprint


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def fingerprint(text: str) -> str:
    """root|section:paragraph,phrase,phrase;paragraph,...|section:..."""
    sections, current, held = [], [], b""
    paragraphs = text.split("\n")
    for i, line in enumerate(paragraphs):
        leaves = [_digest(p.encode()) for p in _PHRASE.findall(line)]
        node = _digest(b"p" + b"".join(leaves))
        current.append(",".join([node.hex()[:SHORT], *[x.hex()[:SHORT] for x in leaves]]))
        held += node
        if node[-1] % 8 == 0 or i == len(paragraphs) - 1:
            section = _digest(b"s" + held)
            sections.append((section, f"{section.hex()[:SHORT]}:{';'.join(current)}"))
            current, held = [], b""
    root = hashlib.sha256(b"r" + b"".join(s for s, _ in sections)).hexdigest()
    return "|".join([root, *[s for _, s in sections]])


def _leaves(print_: str) -> Counter:
    found: Counter = Counter()
    for section in print_.split("|")[1:]:
        for paragraph in section.partition(":")[2].split(";"):
            found.update(paragraph.split(",")[1:])
    return found


def likeness(a: str, b: str) -> float:
    """Share of phrases that two fingerprints have in common (Dice); 1 for equal roots."""
    if a[:64] == b[:64]:
        return 1.0
    return _likeness(_leaves(a), _leaves(b))


def _likeness(x: Counter, y: Counter) -> float:
    total = x.total() + y.total()
    return 2 * sum(min(n, y[k]) for k, n in x.items() if k in y) / total if total else 0.0


def differing_paragraphs(a: str, b: str) -> tuple[list[int], list[int]]:
    """Paragraph numbers (from 0) on either side that the other lacks, found by descending from the roots.

    Branches with equal digests are left out without looking inside.
    """
    if a[:64] == b[:64]:
        return [], []

    def branches(f):
        at, out = 0, []
        for s in f.split("|")[1:]:
            name, _, rest = s.partition(":")
            nodes = [p.split(",")[0] for p in rest.split(";")]
            out.append((name, at, nodes))
            at += len(nodes)
        return out

    left, right = branches(a), branches(b)

    def rest(mine, others):
        same = Counter(n for n, _, _ in others)
        out = []
        for s in mine:
            if same[s[0]]:
                same[s[0]] -= 1
            else:
                out.append(s)
        return out

    def lacking(mine, others):
        there = Counter(n for _, _, nodes in others for n in nodes)
        out = []
        for _, at, nodes in mine:
            for i, n in enumerate(nodes):
                if there[n]:
                    there[n] -= 1
                else:
                    out.append(at + i)
        return out

    l, r = rest(left, right), rest(right, left)
    return lacking(l, r), lacking(r, l)


def edited_text(text: str, following: str) -> str:
    """The last floor(n/2) characters give way to the first as many (or all) of the next text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and fingerprint of every row; null text counts as empty."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        prints = [fingerprint(t or "") for t in b.column(text).to_pylist()]
        return pa.record_batch([b.column(key), pa.array(prints, pa.string())], [key, "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return columns_only(docs, key, text).mapInArrow(by_slices(work, text), f"`{key}` {kind}, fingerprint string")


def _range_of(k: Column, cuts: list[int], base: int = 0) -> Column:
    """Number of cuts at or below k, by binary decisions."""
    if not cuts:
        return F.lit(base)
    m = len(cuts) // 2
    return F.when(k < F.lit(cuts[m]), _range_of(k, cuts[:m], base)).otherwise(_range_of(k, cuts[m + 1 :], base + m + 1))


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form, and the likeness to both that and the next text.

    Rows are dealt once, by ranges of the integer key; the first row of a range is also sent to the
    range before, so that each task streams its rows in order and has the next of each at hand.
    Null texts count as empty; null keys come first; rows with equal keys follow one another in the
    order of their texts. One row alone is its own next.
    """
    spark = docs.sparkSession
    d = columns_only(docs, key, text).select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ways = parallelism(spark)
    # Cut points by approximate quantiles of the keys, at most one for each shuffle partition.
    cuts = sorted(set(d.agg(F.percentile_approx("k", [i / ways for i in range(1, ways)], 20 * ways)).first()[0] or []))
    part = F.when(F.col("k").isNull(), 0).otherwise(_range_of(F.col("k"), cuts)).cast("int")
    firsts = d.select("k", part.alias("part")).groupBy("part").agg(F.min("k"), F.max(F.col("k").isNull())).collect()
    heads = sorted((p, None if null else k) for p, k, null in firsts)
    rows = d.withColumn("part", part)
    if heads:
        # The head of each range goes to the range before; that of the first range to the last.
        targets = spark.createDataFrame([(p, h, heads[i - 1][0]) for i, (p, h) in enumerate(heads)], "at int, head long, to int")
        found = rows.join(F.broadcast(targets), (rows["part"] == targets["at"]) & rows["k"].eqNullSafe(targets["head"]))
        tails = found.groupBy("to").agg(F.min("t").alias("t")).select(F.col("to").alias("part"), F.lit(1).alias("tail"), F.lit(None).cast("long").alias("k"), "t")
        rows = rows.select("part", F.lit(0).alias("tail"), "k", "t").unionByName(tails)
    else:
        rows = rows.select("part", F.lit(0).alias("tail"), "k", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            for start, end in small_slices(b, "t"):
                out = []
                for r in b.slice(start, end - start).to_pylist():
                    print_ = fingerprint(r["t"])
                    if last is not None:
                        out.append(_row(last, r["t"], print_))
                    last = None if r["tail"] else (r["k"], r["t"], print_)
                yield pa.RecordBatch.from_pylist(out, SCHEMA)

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    dealt = rows.repartitionById(ways, "part").sortWithinPartitions("part", "tail", F.col("k").asc_nulls_first(), "t")
    return dealt.mapInArrow(run, kinds).withColumnRenamed("doc_id", key)


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _row(own: tuple, following: str, next_print: str) -> dict:
    k, t, print_ = own
    changed = edited_text(t, following)
    changed_print = fingerprint(changed)
    leaves = _leaves(print_)
    near = [1.0 if f[:64] == print_[:64] else _likeness(leaves, _leaves(f)) for f in (changed_print, next_print)]
    return {
        "doc_id": k, "n_chars": len(t), "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(), "fingerprint": print_,
        "edited_fingerprint": changed_print, "near_edited": near[0], "near_next": near[1],
    }

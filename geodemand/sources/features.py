"""The features of GeoJSON files of any size, each file read by many tasks.

A file is cut after every closing brace, which Spark's reader can do from the middle of a file. Whether
a cut ends a feature depends on what stands before it: how deep the brackets are, and whether a string is
open. So a first pass notes per split, for a start inside and outside a string, how these change and how
often each depth is met after a cut; these few numbers are added up over the splits of a file. The second
pass starts every split with the right state and gives out its features. Only a feature that lies across
splits is put together in a shuffle.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
_REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)
_BEFORE_FIRST = re.compile(r'"features"\s*:\s*\[\s*(?=\{)')
INSIDE = 2  # brackets that are open between two features: those of the collection and of the list


def scan(text: str, in_string: bool) -> tuple[int, bool]:
    """Change in depth over a text that a closing brace follows, and whether a string is open behind it."""
    if in_string:
        end = _REST_OF_STRING.match(text)
        if not end:
            return 0, True
        text = text[end.end() :]
    plain = _STRING.sub("", text)
    open_ = plain.find('"')
    if open_ >= 0:
        plain = plain[:open_]
    depth = plain.count("{") + plain.count("[") - plain.count("}") - plain.count("]")
    return (depth, True) if open_ >= 0 else (depth - 1, False)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.text(path, lineSep="}")
    return t.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def _splits(batches):
    """(path, start, values) of the rows of each split, in order."""
    now, values = None, []
    for b in batches:
        for value, path, start in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
            if (path, start) != now:
                if now:
                    yield *now, values
                now, values = (path, start), []
            values.append(value)
    if now:
        yield *now, values


def _notes(batches):
    """Per split and kind of start: depth and string at its end, and how often each depth stands after a cut."""
    out = []
    for path, start, values in _splits(batches):
        for begins in (False, True):
            depth, inside, seen = 0, begins, Counter()
            for v in values:
                change, inside = scan(v, inside)
                depth += change
                if not inside:
                    seen[depth] += 1
            out.append((path, start, begins, depth, inside, list(seen), list(seen.values())))
    if out:
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["path", "start", "begins", "depth", "inside", "depths", "times"])


def _starts(notes) -> dict[tuple[str, int], tuple[int, bool, int]]:
    """Depth, open string and number of features cut so far at the start of every split."""
    by = {(r["path"], r["start"], r["begins"]): r for r in notes}
    out, depth, inside, cut, now = {}, 0, False, 0, None
    for path, start in sorted({k[:2] for k in by}):
        if path != now:
            now, depth, inside, cut = path, 0, False, 0
        out[path, start] = depth, inside, cut
        r = by[path, start, inside]
        cut += sum(n for d, n in zip(r["depths"], r["times"], strict=True) if depth + d == INSIDE)
        depth, inside = depth + r["depth"], r["inside"]
    return out


def feature_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, number and JSON text of every feature of the FeatureCollections at `path` (a file or a folder).

    A feature that is no JSON is an error; what stands before and behind the list of features is left out.
    """
    rows = _rows(spark, path)
    notes = rows.mapInArrow(_notes, "path string, start long, begins boolean, depth int, inside boolean, depths array<int>, times array<int>")
    starts = spark.sparkContext.broadcast(_starts(notes.collect()))

    def pieces(batches):
        for path, start, values in _splits(batches):
            depth, inside, number = starts.value[path, start]
            out, held, whole = [], [], start == 0
            for v in values:
                held.append(v)
                change, inside = scan(v, inside)
                depth += change
                if depth == INSIDE and not inside:
                    out.append((path, number, start, "}".join(held) + "}", whole))
                    held, number, whole = [], number + 1, True
            if held:  # goes on in the next split, or is the end of the file
                out.append((path, number, start, "}".join(held) + "}", False))
            if out:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["path", "number", "start", "text", "whole"])

    def features(batches):
        for b in batches:
            found = [_feature(t) for t in b.column("text").to_pylist()]
            keep = pa.array([f is not None for f in found], pa.bool_())
            kept = [b.column("path").filter(keep), b.column("number").filter(keep), pa.array([f for f in found if f is not None], pa.string())]
            yield pa.record_batch(kept, ["path", "number", "feature"])

    p = rows.mapInArrow(pieces, "path string, number long, start long, text string, whole boolean")
    # A feature that begins in one split and ends in another: its pieces in the order of the splits.
    parts = F.array_sort(F.collect_list(F.struct("start", "text")))
    across = p.where("not whole").groupBy("path", "number").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))
    out = p.where("whole").select("path", "number", "text").unionByName(across)
    return out.mapInArrow(features, "path string, number long, feature string")


def _feature(text: str) -> str | None:
    """The feature in a piece of a file, None where it holds none."""
    follows = text.lstrip().startswith(",")
    text = text.lstrip(" \t\r\n,")
    first = None if follows else _BEFORE_FIRST.search(text)
    if first:
        text = text[first.end() :]
    try:
        value = json.loads(text)
    except json.JSONDecodeError:
        if follows or first:
            raise ValueError(f"not a feature: {text[:80]}") from None
        return None
    return text if isinstance(value, dict) and "geometry" in value else None

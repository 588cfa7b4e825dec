"""Removal of lines that many documents share, in DataFrame functions only.

Each document gives one row per line with a key: its 128-bit hash, the document and the position, and
whether it is the key's first in the document, which a sort inside the document tells. The rows are
dealt by ranges of (hash, document), so a very common line spreads over several tasks; counts of
documents per hash are a grouped sum of the first ones. What comes back to a document is its keep bitmap, run-length coded; texts
are not moved to find lines, only once to apply the bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geodemand.llm.common import ascii_lower, columns_only, written
from geodemand.session import parallelism

STRIPPED = " \t\n\x0b\x0c\r"
MIN_LENGTH = 1
MIN_DOCS = 10
ROW = "_line_dedup_row"


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH) -> DataFrame:
    """(key, runs): lengths of alternating runs of kept and dropped lines, starting with kept ones.

    Only documents that lose lines are returned. Keys must be unique.
    """
    stripped = F.transform(
        F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), "\n", -1), lambda x, i: F.struct(F.btrim(x, F.lit(STRIPPED)).alias("line"), i.alias("pos"))
    )
    hashed = F.transform(
        F.filter(stripped, lambda x: F.char_length(x["line"]) >= min_length),
        lambda x: F.struct(F.xxhash64(x["line"]).alias("h1"), F.xxhash64(F.lit(1), x["line"]).alias("h2"), x["pos"].alias("pos")),
    )
    ways = parallelism(docs.sparkSession)
    # Sorted inside the document, a key's first occurrence there is the one that differs from the entry before.
    inside = columns_only(docs, key, text).select(F.col(key).alias("doc"), F.sort_array(hashed).alias("keys"))
    marked = inside.select(
        "doc",
        F.explode(
            F.zip_with(
                "keys", F.concat(F.array(F.lit(None).cast("struct<h1:bigint,h2:bigint,pos:int>")), F.slice("keys", 1, F.greatest(F.size("keys") - 1, F.lit(0)))),
                lambda x, last: F.struct(x["h1"], x["h2"], x["pos"], (last.isNull() | (x["h1"] != last["h1"]) | (x["h2"] != last["h2"])).alias("first")),
            )
        ).alias("x"),
    ).select("x.h1", "x.h2", "doc", "x.pos", "x.first")
    rows = written(marked.repartitionByRange(ways, "h1", "h2", "doc", "pos").sortWithinPartitions("h1", "h2", "doc", "pos"), "lines")
    common = written(
        rows.groupBy("h1", "h2").agg(F.sum(F.col("first").cast("long")).alias("n_docs")).where(F.col("n_docs") >= min_docs).select("h1", "h2"), "common"
    )
    dropped = rows.join(common, ["h1", "h2"]).groupBy("doc").agg(F.sort_array(F.collect_list("pos")).alias("dropped"))
    return dropped.select(F.col("doc").alias(key), _runs("dropped").alias("runs"))


def _runs(dropped: str) -> Column:
    """Sorted dropped positions to alternating run lengths; the kept tail is left open."""
    start = F.struct(F.array().cast("array<int>").alias("runs"), F.lit(0).alias("at"))

    def step(acc, p):
        n = F.size(acc["runs"])
        longer = F.concat(F.slice(acc["runs"], 1, n - 1), F.array(F.element_at(acc["runs"], -1) + 1))
        fresh = F.concat(acc["runs"], F.array(p - acc["at"], F.lit(1)))
        return F.struct(F.when((n > 0) & (p == acc["at"]), longer).otherwise(fresh).alias("runs"), (p + 1).alias("at"))

    return F.aggregate(F.col(dropped), start, step, lambda acc: acc["runs"])


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH) -> DataFrame:
    """Rows of `docs` with n_lines, n_dropped and kept_text.

    Null and empty texts are one empty line, which has no key and stays. Lines of white space only
    have an empty key and stay. A line repeated inside one document counts that document once.
    Every row is a document of its own, told apart by a row number that is written first: rows with
    a null or repeated key lose the lines of theirs that are common, and no others. `key` is not read.
    Other columns, clashing names included, are carried through.
    """
    rows = written(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    b = keep_bitmaps(rows, ROW, text, min_docs, min_length).select(F.col(ROW).alias("_bk"), F.col("runs").alias("_runs"))
    joined = rows.join(b, rows[ROW] == b["_bk"], "left")
    lines = _lines(text)
    flags = F.flatten(F.transform("_runs", lambda n, i: F.array_repeat(i % 2 == 1, n)))
    kept = F.filter(F.col("_lines"), lambda x, i: ~F.coalesce(F.get(F.col("_gone"), i), F.lit(False)))
    return (
        joined.withColumn("_lines", lines)
        .withColumn("_gone", flags)
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dropped", F.when(F.col("_gone").isNull(), 0).otherwise(F.size(F.filter("_gone", lambda x: x))).cast("long"))
        .withColumn("kept_text", F.when(F.col("_gone").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(kept, "\n")))
        .drop("_bk", "_runs", "_lines", "_gone", ROW)
    )

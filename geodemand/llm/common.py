"""Shared pieces of the text operators: word rules, folds, table access, vectorised byte hashing."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geodemand.session import parallelism, shared_dir, spread

# ASCII white space, and the words between it.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Byte translation that lower-cases A-Z and nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def fold_of(key: Column, ways: int) -> Column:
    """crc32 of the key's text, modulo `ways`; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(ways))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like `written`, stored by hash of the key, so that joins by it do not move the rows again."""
    spark, table = df.sparkSession, f"llm_{name}_{uuid.uuid4().hex}".replace("-", "_")
    rows = spread(df, key).write.bucketBy(parallelism(spark), key)
    rows.option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def columns_only(df: DataFrame, *names: str) -> DataFrame:
    """Just the columns an operator reads, so that extra columns with clashing names do no harm."""
    return df.select(*[df[n] for n in names])


def block_count(df: DataFrame, text: str, block_bytes: int) -> int:
    """How many blocks of about `block_bytes` the texts make."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(parallelism(df.sparkSession), -(-total // block_bytes))


def small_slices(batch: pa.RecordBatch, column: str, limit: int = 2_000_000):
    """Cut a batch into row ranges of about `limit` bytes of text, to bound what numpy holds."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if sizes:
        yield start, len(sizes)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string array end to end as bytes, and the n+1 offsets; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    return data, offsets - lo


class Rolling:
    """Hashes of byte ranges by a polynomial over Z/2^64 with a random coefficient per byte value.

    One instance serves texts of up to its capacity; it grows as needed.
    """

    def __init__(self, seed: int = 20260817):
        rng = np.random.default_rng(seed)
        self.coefficient = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = 0x9E3779B97F4A7C15 | 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) > n:
            return
        n = max(n + 1, 2 * len(self.up))
        for name, b in (("up", self.base), ("down", self.inverse)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            setattr(self, name, np.multiply.accumulate(p))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Running sums; the hash of [s, e) is read off them with `ranges`."""
        self._powers(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.coefficient[data] * self.up[: len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[start])


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def by_slices(work, column: str, limit: int = 2_000_000):
    """Wrap work(slice of a record batch) -> record batch for mapInArrow, bounding what is held at once."""

    def run(batches):
        for batch in batches:
            for start, end in small_slices(batch, column, limit):
                yield work(batch.slice(start, end - start))

    return run


# Byte translation to lower-cased words of letters, digits and everything beyond ASCII, apart by blanks.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z, as UTF-8."""
    return (text or "").encode().translate(ALNUM).split()


def blank_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space after lower-casing A-Z, as UTF-8."""
    return (text or "").encode().translate(LOWER).split()

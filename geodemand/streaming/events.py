"""Incremental forms of the event roll-up and of the idle-session rule.

A batch is folded to rows by itself, merged with the stored rows of the parts it touches (days, or
buckets of users), and only those parts are written anew, under the number of the batch. The stream
keeps no state, so none grows, and a late event of any age still counts. A batch that is run again
after a failure reads what was there before it and replaces what it left, so it counts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geodemand.session import save_table, shared_dir

BUCKETS = 64  # parts of the session table; a batch rewrites those whose users it holds


@dataclass(frozen=True)
class Keyed:
    """A table kept up to date by parts: what a batch gives, and how stored rows take it in."""

    schema: str
    part: Callable[[], Column]  # the part of a stored row, as text, never null
    fold: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """Event files of a folder as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_rollup() -> Keyed:
    """Count and sum per day and kind of event; events without time are left out."""
    return Keyed(
        "day timestamp, event_type string, n long, value double",
        lambda: F.date_format("day", "yyyy-MM-dd"),
        lambda events: events.where("ts is not null").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("double").alias("value")),
        lambda rows: rows.groupBy("day", "event_type").agg(F.sum("n").alias("n"), F.sum("value").alias("value")),
    )


def idle_sessions(gap: str = "12 hours", buckets: int = BUCKETS) -> Keyed:
    """Sessions of each user, parted by silence of the gap; the last may still be open, and a late event may join two."""

    def joined(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("user_id").orderBy("started", "expired", "n")
        before = F.max("expired").over(order.rowsBetween(Window.unboundedPreceding, -1))
        fresh = F.when(before.isNull() | (F.col("started") > before), 1).otherwise(0)
        number = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        marked = rows.withColumn("_new", fresh).withColumn("_number", number)
        return marked.groupBy("user_id", "_number").agg(
            F.min("started").alias("started"), F.max("expired").alias("expired"), F.sum("n").alias("n")
        ).drop("_number")

    return Keyed(
        "user_id long, started timestamp, expired timestamp, n long",
        lambda: F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("string"),
        lambda events: events.where("ts is not null").groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("user_id").cast("long").alias("user_id"), F.col("w.start").alias("started"), F.col("w.end").alias("expired"), "n"),
        joined,
    )


def latest(spark: SparkSession, base: str, table: Keyed, before: int | None = None) -> DataFrame:
    """The rows of each part as its newest batch left them; with `before`, of the batches before that one."""
    rows = spark.read.schema(f"{table.schema}, batch long, part string").parquet(f"{base}/rows")
    rows = rows if before is None else rows.where(F.col("batch") < before)
    newest = rows.groupBy("part").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["part", "batch"], "left_semi").drop("batch")


def run_once(stream: DataFrame, table: Keyed, name: str, base: str | None = None) -> DataFrame:
    """Take in what is there and read the whole table.

    Rows and progress stay in `base` (a fresh place in the shared folder if none is given); called
    again with the same one it takes in what has come since.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    columns = [c.split()[0] for c in table.schema.split(", ")]
    # No rows, so that the folder is there before the first batch.
    spark.createDataFrame([], f"{table.schema}, batch long, part string").write.mode("ignore").partitionBy("batch", "part").parquet(f"{base}/rows")

    def write(batch: DataFrame, number: int) -> None:
        fresh = save_table(table.fold(batch).withColumn("part", table.part()), f"{name}-fresh")
        touched = fresh.select("part").distinct()
        stored = latest(batch.sparkSession, base, table, number).join(touched, "part", "left_semi")
        merged = table.merge(stored.select(*columns).unionByName(fresh.select(*columns)))
        merged.withColumn("part", table.part()).write.mode("overwrite").partitionBy("part").parquet(f"{base}/rows/batch={number}")

    q = stream.writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", f"{base}/progress").start()
    q.awaitTermination()
    return latest(spark, base, table).select(*columns)

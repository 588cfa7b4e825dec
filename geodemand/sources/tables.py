"""Readers: parquet tables, views, CSV dimensions, configuration rows, GeoJSON, source priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geodemand.functions.scalars import letters_and_digits
from geodemand.session import parallelism, save_table
from geodemand.sources.features import feature_texts


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, path: str, produced_by: str | None = None) -> DataFrame:
    """Read a parquet table; say which step makes it when it is not there."""
    if not exists(spark, path):
        hint = f"; run {produced_by} first" if produced_by else ""
        raise FileNotFoundError(f"table {path} does not exist{hint}")
    return spark.read.parquet(path)


def register_views(spark: SparkSession, paths: dict[str, str]) -> list[str]:
    """Temp views over the parquet tables that exist; the absent ones are left out."""
    made = []
    for name, path in paths.items():
        if exists(spark, path):
            spark.read.parquet(path).createOrReplaceTempView(name)
            made.append(name)
    return made


def read_dimension_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")


def config_table(spark: SparkSession, entries: list[dict], schema: T.StructType) -> DataFrame:
    """Rows of a keyed configuration list; lists in a field become arrays."""
    return spark.createDataFrame([tuple(e.get(f.name) for f in schema) for e in entries], schema)


def season_text(months: str | Column) -> Column:
    """Month list as comma-joined text."""
    m = F.col(months) if isinstance(months, str) else months
    return F.concat_ws(",", F.transform(m, lambda x: x.cast("string")))


_RING = "array<array<double>>"


def read_geojson(
    spark: SparkSession, path: str, state_keys: list[str], district_keys: list[str], source: str
) -> DataFrame:
    """Features of a GeoJSON file as state key, district key, and their rings.

    Property names differ by publisher, so the first present name of each list is taken,
    ignoring case. Polygon and MultiPolygon both come out as a flat list of rings. A large file is
    read by many tasks.
    """
    schema = "properties map<string,string>, geometry struct<type:string,coordinates:string>"
    f = feature_texts(spark, path).select(F.from_json("feature", schema).alias("f")).select(
        F.map_from_entries(
            F.transform(
                F.map_entries("f.properties"),
                lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")),
            )
        ).alias("p"),
        F.col("f.geometry.type").alias("kind"),
        F.col("f.geometry.coordinates").alias("c"),
    )
    rings = F.when(F.col("kind") == "Polygon", F.from_json("c", f"array<{_RING}>")).when(
        F.col("kind") == "MultiPolygon", F.flatten(F.from_json("c", f"array<array<{_RING}>>"))
    )
    return (
        f.select(
            F.coalesce(*[F.col("p")[k] for k in state_keys]).alias("state"),
            F.coalesce(*[F.col("p")[k] for k in district_keys]).alias("district"),
            rings.alias("rings"),
        )
        .where("state is not null and district is not null and size(rings) > 0")
        .select(
            letters_and_digits("state").alias("state_key"),
            letters_and_digits("district").alias("district_key"),
            "rings",
            F.lit(source).alias("source"),
        )
    )


def first_source_wins(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the first source that has each key; later ones only fill gaps.

    The best row per key is found by aggregation, so one key's copies never have to sit in
    one task together.
    """
    columns = sources[0].columns
    stacked = None
    for i, s in enumerate(sources):
        part = s.select(*columns).withColumn("_p", F.lit(i))
        stacked = part if stacked is None else stacked.unionByName(part)
    rest = [c for c in columns if c not in keys]
    best = stacked.groupBy(*keys).agg(F.min(F.struct("_p", *rest)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def primary_or_fallback(
    primary: DataFrame | None, fallback: DataFrame, real: str = "real", stand_in: str = "simulated"
) -> DataFrame:
    """The primary input where it has rows, else the fallback; the mode is on every row."""
    if primary is not None and primary.limit(1).count():
        return primary.withColumn("provenance", F.lit(real)).withColumn("mode", F.lit("real"))
    return fallback.withColumn("provenance", F.lit(stand_in)).withColumn("mode", F.lit("synthetic"))


def latest_per_source(log: DataFrame, source: str, order: list[Column]) -> DataFrame:
    """Last record of each source in an append-only log, by aggregation."""
    cols = [c for c in log.columns if c != source]
    key = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    g = log.groupBy(source).agg(F.max_by(F.struct(*cols), key).alias("_r"))
    return g.select(source, *[F.col(f"_r.{c}").alias(c) for c in cols]).orderBy(source)


def hierarchical_ids(
    df: DataFrame, parent: str, order: str, tag: str, width: int, out: str
) -> DataFrame:
    """Parent id + tag + sequence inside the parent, zero-padded to `width` digits and longer where it needs more.

    The sequence is the rank of the (unique) order column of any ordered type, taken without a
    whole-parent window: rows are dealt by ranges of (parent, order), numbered inside each range,
    and shifted by what the ranges before hold of the parent a range begins with.
    """
    spark = df.sparkSession
    dealt = save_table(df.repartitionByRange(parallelism(spark), parent, order).withColumn("_pid", F.spark_partition_id()), "ids")
    # Only a range's first parent can have rows in ranges before: one count per range and such parent.
    heads = dealt.groupBy("_pid").agg(F.min(parent).alias(parent))
    per = dealt.join(F.broadcast(heads.select(F.col(parent).alias("_head")).distinct()), F.col(parent).eqNullSafe(F.col("_head")), "left_semi")
    per = sorted((r["_pid"], r[parent], r["n"]) for r in per.groupBy("_pid", parent).agg(F.count("*").alias("n")).collect())
    shifts = [(r["_pid"], sum(n for pid, p, n in per if p == r[parent] and pid < r["_pid"])) for r in heads.collect()]
    shift = F.broadcast(spark.createDataFrame(shifts, "_pid int, _shift bigint").join(heads.withColumnRenamed(parent, "_head"), "_pid"))
    seq = F.row_number().over(Window.partitionBy("_pid", parent).orderBy(order)) + F.when(F.col(parent).eqNullSafe(F.col("_head")), F.col("_shift")).otherwise(0)
    text = seq.cast("string")
    return (
        dealt.join(shift, "_pid", "left").withColumn(out, F.concat(F.col(parent).cast("string"), F.lit(tag), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)))
        .select(*df.columns, out)
    )

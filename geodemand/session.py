"""Session defaults and the shared folder that stage tables are written to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Stage tables already written by this driver: {(application, name, inputs): path}.
_STAGES: dict[tuple, str] = {}


def build_session(app: str = "geodemand", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution, skew splitting and UTC time."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only on a single machine may there be none; then a fresh folder is made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not path and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not path:
        path = _STAGES.get((spark.sparkContext.applicationId, "local"))
        if not path:
            path = tempfile.mkdtemp(prefix="geodemand-")
            _STAGES[(spark.sparkContext.applicationId, "local")] = path
    return path.rstrip("/")


def parallelism(spark: SparkSession) -> int:
    """How many ways a stage is cut; drives bucket and salt counts."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Even out the rows before a step that multiplies them, so no task carries the product alone."""
    return df.repartition(parallelism(df.sparkSession), *keys)


def spread_scan(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a plain scan that has fewer splits than there are slots, e.g. one small file.

    A scan of many files already has its splits and is left alone, so large texts stay put.
    """
    if df.rdd.getNumPartitions() >= parallelism(df.sparkSession):
        return df
    return spread(df, *keys)


def save_table(df: DataFrame, name: str = "t") -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts lineage in a way that survives the loss of executors and gives the
    optimizer real sizes for its join choice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _fingerprint(spark: SparkSession, paths: list[str]) -> tuple:
    """Size and modification time of the inputs, so a changed input is never served stale."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        st = fs.getFileStatus(hp)
        out.append((p, fs.getContentSummary(hp).getLength(), st.getModificationTime()))
    return tuple(out)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stage(
    spark: SparkSession, name: str, inputs: list[str], build, partition_by: tuple[str, ...] = (), bucket_by: str | None = None, **params
) -> DataFrame:
    """A named stage table: built and written on first use, read afterwards; in folders by `partition_by`.

    With `bucket_by` it is stored by hash of that key, as many ways as a shuffle, so that grouping or joining
    by the key does not move its rows again.
    """
    key = (
        spark.sparkContext.applicationId,
        name,
        _fingerprint(spark, inputs),
        tuple(sorted(params.items())),
    )
    path = _STAGES.get(key)
    if path is None or not _exists(spark, path):
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if bucket_by:
            rows = spread(build(), bucket_by)  # no second move where the rows lie so already
            rows.write.bucketBy(parallelism(spark), bucket_by).option("path", path).saveAsTable(_table_name(path))
        else:
            build().write.partitionBy(*partition_by).parquet(path)
        _STAGES[key] = path
    return spark.table(_table_name(path)) if bucket_by else spark.read.parquet(path)


def _table_name(path: str) -> str:
    return path.rsplit("/", 1)[1].replace("-", "_")

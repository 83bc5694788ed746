"""Session settings and the shared folder that jobs write intermediate tables to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# About how many rows of a single key one task holds; keys are cut into time slices of that
# size (see operators/slices.py). Results do not depend on it. Override per session.
ROWS_PER_TASK_KEY = "fleetlens.rowsPerTask"
ROWS_PER_TASK = 2_000_000


def local_session(cores: str = "8", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fleetlens")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return with_defaults(spark)


def with_defaults(spark: SparkSession) -> SparkSession:
    """Settings the results depend on (time zone) or that skewed joins need."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def rows_per_task(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_TASK_KEY, str(ROWS_PER_TASK)))


# Folders handed out, by application, for ``discard_tables``.
_GIVEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, reachable by every executor.

    Only a local-mode session may fall back to a temporary folder. Results may be read from these folders until
    the caller has stored them elsewhere and calls ``discard_tables``.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="fleetlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/fleetlens/{purpose}-{uuid.uuid4().hex}"
    _GIVEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def discard_tables(spark: SparkSession) -> int:
    """Delete the intermediate tables of this application, once nothing reads them any more; returns their number."""
    given = _GIVEN.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    for path in map(hadoop, given):
        gone += path.getFileSystem(conf).delete(path, True)
    return gone


def written(df, purpose: str):
    """Cut the lineage: store ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

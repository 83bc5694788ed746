"""Session settings of this subpackage's operators and its intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetlens.session import shared_dir, with_defaults, written

# A batch handed to Python holds at most this many rows and bytes, so that a few long texts cannot fill a worker.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 * 1024 * 1024


def prepared(spark: SparkSession) -> SparkSession:
    with_defaults(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def stored(df: DataFrame, purpose: str, compression: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe from lost executors."""
    if compression is None:
        return written(df, purpose)
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")

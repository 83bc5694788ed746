"""Streams over stored tables and message topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Bounds a micro-batch, so that the rows of one key in it stay bounded too.
FILES_PER_BATCH = 100


def table_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """New Parquet files below ``path`` (a folder or a glob), never with an inferred schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def json_stream(spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Lines of JSON text as they arrive in a folder, in a ``value`` column."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, rows_per_batch: int = 1_000_000) -> DataFrame:
    """Messages of a topic in a ``value`` column (needs the Kafka connector on the class path)."""
    return (
        spark.readStream.format("kafka")
        .options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "maxOffsetsPerTrigger": rows_per_batch})
        .load()
        .selectExpr("CAST(value AS STRING) AS value")
    )

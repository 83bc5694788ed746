"""Reading and writing stored tables, raw JSON messages and CSV exports."""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.schema import SNAPSHOT


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def constant_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few fixed rows, kept in the plan itself."""
    columns = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(columns, r)) for r in rows]), schema)


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table read in parallel key ranges (needs the database's driver jar)."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
        .load()
    )


def decode(messages: DataFrame, value: str = "value", sections: tuple[str, ...] | None = None) -> DataFrame:
    """Parse JSON messages into a ``doc`` struct; unreadable text lands in ``doc._corrupt``.

    ``sections`` limits parsing to the top-level fields a query needs.
    """
    fields = [f for f in SNAPSHOT.fields if sections is None or f.name in sections]
    schema = T.StructType([*fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    # Parsing inside a generator runs once per message, also when filters on the result follow.
    return messages.withColumn("doc", F.explode(F.array(F.from_json(value, schema, options))))


def corrupt() -> Column:
    return F.col("doc").isNull() | F.col("doc._corrupt").isNotNull()


def land_raw(messages: DataFrame, path: str) -> None:
    """Append raw snapshots, partitioned by day."""
    messages.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").parquet(path)


def landed(spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Landed snapshots from ``start`` up to but not including ``end``; other days are not read."""
    rows = spark.read.parquet(path)
    if start is not None:
        rows = rows.where((F.col("date") >= F.lit(start.date())) & (F.col("ts") >= F.lit(start)))
    if end is not None:
        rows = rows.where((F.col("date") <= F.lit(end.date())) & (F.col("ts") < F.lit(end)))
    return rows


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)

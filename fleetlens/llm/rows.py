"""Dropping rows of a table by decisions that were made on its ids and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_rows(docs: DataFrame, gone: DataFrame, single: DataFrame, key: Column) -> DataFrame:
    """``docs`` with all its columns, less the rows of ``gone``, and one row of each of ``single``.

    Both hold (id, key): the document's id, and ``key`` of its text as computed from ``_row.text``. ``single`` lists
    rows that repeat id and text and of which one stays; there seldom are any, so they are only looked for if so.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row")).withColumn("_key", key)  # own columns of any name stay apart

    def same(marks: DataFrame) -> Column:
        return F.col("_row.doc_id").eqNullSafe(marks["id"]) & (rows["_key"] == marks["key"])

    repeats = not single.isEmpty()
    drop = gone.union(single) if repeats else gone
    left = rows.join(drop.hint("shuffle_hash"), same(drop), "left_anti").select("_row")
    if repeats:
        ones = rows.join(single.hint("shuffle_hash"), same(single), "left_semi")
        left = left.union(ones.withColumn("_id", F.col("_row.doc_id")).dropDuplicates(["_id", "_key"]).select("_row"))
    return left.select("_row.*")

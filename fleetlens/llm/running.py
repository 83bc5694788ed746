"""Ranks and running sums over a total order of all rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.session import stored

PART_BITS = 33  # monotonically_increasing_id: the partition, then 33 bits of the row within it


def in_order(df: DataFrame, order: list[Column], purpose: str, sums: list[str] = ()) -> DataFrame:
    """``df`` stored in ``order`` with ``_part`` (the range partition), ``_place`` (0-based rank) and, for each of ``sums``, ``_before_<name>``.

    Rows are dealt by sampled ranges and sorted in them, so no range grows with a key unless its rows are equal in all of ``order``.
    Ranks and sums of the rows of earlier ranges come from one row per range. ``_before_<name>`` sums the rows before a row; nulls
    count as 0. Rows that are equal in ``order`` come in any order.
    """
    laid = stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row_id", F.monotonically_increasing_id()), purpose
    )
    part = F.shiftright("_row_id", PART_BITS)
    each = [F.count("*").alias("_rows"), *(F.coalesce(F.sum(c), F.lit(0)).alias(f"_sum_{c}") for c in sums)]
    ranges = laid.groupBy(part.alias("_part")).agg(*each)  # one row per partition
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ["_rows", *(f"_sum_{c}" for c in sums)]
    ranges = ranges.select("_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_ahead{c}") for c in ahead))
    out = laid.withColumn("_part", part).join(F.broadcast(ranges), "_part")  # at most as many rows as there are partitions
    local = F.col("_row_id") - F.shiftleft(F.col("_part"), PART_BITS)
    out = out.withColumn("_place", F.col("_ahead_rows") + local)
    if sums:
        inside = Window.partitionBy("_part").orderBy("_row_id").rowsBetween(Window.unboundedPreceding, -1)
        for c in sums:
            out = out.withColumn(f"_before_{c}", F.col(f"_ahead_sum_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("_row_id", *(f"_ahead{c}" for c in ahead))

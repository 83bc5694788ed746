"""Exact quantiles with linear interpolation, spread over value ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import rows_per_task
from fleetlens.sources.tables import constant_table

MOST_RANGES = 50_000


def _reached(edges: list[float], value: Column) -> Column:
    """How many of the sorted ``edges`` are at most ``value``, by bisection."""
    if not edges:
        return F.lit(0)
    table = F.array(*[F.lit(float(e)) for e in edges])
    steps = F.array(*[F.lit(1 << k) for k in range(len(edges).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= value, at + step).otherwise(at))


def exact_quantiles(df: DataFrame, metrics: list[str], probabilities: dict[str, float]) -> DataFrame:
    """One row per metric that has values, with one column per named probability.

    Values are counted, then ranked within value ranges, as many as the number of rows asks for. The bounds
    of the ranges come from a sketch and only balance the work; the ranks are exact.
    """
    n = df.agg(*[F.count(m).alias(m) for m in metrics]).first()
    ranges = min(MOST_RANGES, max(n) // rows_per_task(df.sparkSession) + 1)
    grid = [i / ranges for i in range(1, ranges)] or [0.5]
    sketch = df.agg(*[F.percentile_approx(m, grid, 10 * max(ranges, 100)).alias(m) for m in metrics]).first()

    # A value belongs to the range opened by the last bound that it reaches.
    opened = F.lit(0)
    for m in metrics:
        reached = _reached(sorted(set(sketch[m] or [])), F.col("value"))
        opened = F.when(F.col("metric") == m, reached).otherwise(opened)
    long = df.select([F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], metrics, "metric", "value")
    counted = long.where(F.col("value").isNotNull()).groupBy("metric", "value").agg(F.count("*").alias("c"))
    counted = counted.withColumn("range", opened)

    # One row per metric and range.
    sums = counted.groupBy("metric", "range").agg(F.sum("c").alias("rows"))
    earlier = Window.partitionBy("metric").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).drop("rows")
    within = Window.partitionBy("metric", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counted.withColumn("upto", F.sum("c").over(within))
        .join(sums, ["metric", "range"])
        .withColumn("upto", F.col("upto") + F.col("before"))
        .withColumn("after", F.col("upto") - F.col("c"))
    )

    targets = []
    for m in metrics:
        last = max(n[m] - 1, 0)
        for name, p in probabilities.items():
            low = int(p * last)
            targets.append((m, name, low, min(low + 1, last), p * last - low))
    table = constant_table(df.sparkSession, targets, "metric string, name string, low bigint, high bigint, part double")
    found = ranked.join(F.broadcast(table), "metric").where((F.col("after") <= F.col("high")) & (F.col("upto") > F.col("low")))

    def value_at(rank: str) -> Column:
        return F.max(F.when((F.col("after") <= F.col(rank)) & (F.col("upto") > F.col(rank)), F.col("value")))

    quantile = value_at("low") * (1 - F.first("part")) + value_at("high") * F.first("part")
    points = found.groupBy("metric", "name").agg(quantile.alias("q"))
    return points.groupBy("metric").agg(*[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in probabilities])

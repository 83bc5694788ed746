"""Forecasts, trends, counter rates and scaling over the recent history of each agent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.operators.detect import IDS, present_index, slope
from fleetlens.operators.slices import AGENT_SERIES, Order, micros, trailing

TEN = 10
# Metric -> ceiling, least slope, horizon in intervals, confidence cap and factor.
FORECASTS = {
    "disk_usage": (100.0, 0.1, 100, 0.9, 10.0),
    "memory_usage": (95.0, 0.5, 50, 0.85, 5.0),
}


def _forecast_inputs(metrics: list[str]):
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        last = w.rowsBetween(1 - TEN, 0)
        df = df.withColumn("_history", F.count("*").over(last))
        df = df.withColumns({f"_x_{m}": present_index(m, w) for m in metrics})
        return df.withColumns({
            **{f"_n_{m}": F.count(m).over(last) for m in metrics},
            **{f"_slope_{m}": slope(m, f"_x_{m}", last) for m in metrics},
        })

    return build


def _forecast(metric: str) -> tuple[Column, dict[str, Column]]:
    ceiling, least, horizon, cap, factor = FORECASTS[metric]
    rise, current = F.col(f"_slope_{metric}"), F.col(metric)
    left = (F.lit(ceiling) - current) / F.nullif(rise, F.lit(0.0))
    due = (
        (F.col("_history") >= TEN) & current.isNotNull() & (F.col(f"_n_{metric}") >= 5)
        & (rise > least) & (left < horizon)
    )
    return due, {
        "time_to_failure": left.cast("int"),
        "confidence": F.least(F.lit(cap), rise * factor),
        "current_usage": current,
        "trend": rise,
    }


def forecast_exhaustion(df: DataFrame, metric: str, order: Order = AGENT_SERIES) -> DataFrame:
    """Intervals until ``metric`` reaches its ceiling, by the slope of the last 10 entries."""
    rows = trailing(df, TEN, _forecast_inputs([metric]), order)
    due, columns = _forecast(metric)
    return rows.where(due).select(*IDS, *[value.alias(name) for name, value in columns.items()])


def predict_failures(df: DataFrame, order: Order = AGENT_SERIES) -> DataFrame:
    """Both forecasts per snapshot as structs, NULL where none is due; CPU has no forecast."""
    rows = trailing(df, TEN, _forecast_inputs(list(FORECASTS)), order)

    def prediction(metric: str) -> Column:
        due, columns = _forecast(metric)
        return F.when(due, F.struct(*[value.alias(name) for name, value in columns.items()]))

    return rows.select(
        *IDS,
        prediction("disk_usage").alias("disk_full_prediction"),
        prediction("memory_usage").alias("memory_exhaustion_prediction"),
        F.lit(None).cast("double").alias("cpu_overload_prediction"),
    )


def _insight_inputs(df: DataFrame, w: WindowSpec) -> DataFrame:
    all10, first3, last3 = w.rowsBetween(-9, 0), w.rowsBetween(-9, -7), w.rowsBetween(-2, 0)
    columns = {"_history": F.count("*").over(all10)}
    for name in ("cpu", "memory"):
        value = F.coalesce(F.col(f"{name}_usage"), F.lit(0.0))
        columns[f"{name}_change"] = F.avg(value).over(last3) - F.avg(value).over(first3)
        columns[f"{name}_average"] = F.avg(value).over(all10)
    return df.withColumns(columns)


def _direction(change: Column) -> Column:
    return F.when(change > 5, "increasing").when(change < -5, "decreasing").otherwise("stable")


def insights(df: DataFrame, order: Order = AGENT_SERIES) -> DataFrame:
    """Direction, change and average of CPU and memory over 10 entries, and the efficiency score.

    An absent section counts as 0 here.
    """
    rows = trailing(df, TEN, _insight_inputs, order).where(F.col("_history") >= TEN)
    load = (
        F.col("cpu_average") * 0.4 + F.col("memory_average") * 0.4
        + F.greatest(F.lit(0.0), F.col("cpu_change")) * 0.2
    )
    return rows.select(
        *IDS,
        _direction(F.col("cpu_change")).alias("cpu_direction"), "cpu_change", "cpu_average",
        _direction(F.col("memory_change")).alias("memory_direction"), "memory_change", "memory_average",
        F.greatest(F.lit(0), (F.lit(100.0) - load).cast("int")).alias("efficiency_score"),
    )


def insight_texts(insight_rows: DataFrame) -> DataFrame:
    """One row per insight that applies to a snapshot."""
    found = [
        F.when(F.col(f"{name}_change") > above, F.struct(F.lit(text).alias("insight"), F.lit(advice).alias("recommendation")))
        for name, above, text, advice in C.INSIGHTS
    ]
    return (
        insight_rows.select(*IDS, F.explode(F.array(*found)).alias("t"))
        .where(F.col("t").isNotNull())
        .select(*IDS, "t.*")
    )


def counter_rates(df: DataFrame, counters: dict[str, str], order: Order = AGENT_SERIES) -> DataFrame:
    """Per-second rates of cumulative counters: ``counters`` maps counter column to rate column.

    The first sample of an agent has rate 0; without progress in time there is no rate.
    """
    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        now = micros(order.ts)
        elapsed = now - F.lag(now).over(w)
        rows = rows.withColumns({"_elapsed": elapsed, "_first": F.count("*").over(w.rowsBetween(-1, 0)) == 1})
        rates = {}
        for counter, rate in counters.items():
            moved = F.col(counter) - F.lag(counter).over(w)
            per_second = F.round(moved * 1000000.0 / F.col("_elapsed"), 2)
            rates[rate] = F.when(F.col("_first"), 0.0).when(F.col("_elapsed") > 0, per_second)
        return rows.withColumns(rates).drop("_elapsed", "_first")

    return trailing(df, 2, build, order)


def scaled(df: DataFrame, features: list[str], depth: int = 50, order: Order = AGENT_SERIES) -> DataFrame:
    """Standardise the current entry by the last ``depth`` entries of its agent (itself included).

    Needs more than ``depth`` entries of history and more than 10 usable ones. Population
    deviation; a constant feature is only centred.
    """
    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        last = w.rowsBetween(1 - depth, 0)
        columns = {
            "_history": F.count("*").over(w.rowsBetween(-depth, 0)),
            "_usable": F.count(features[0]).over(last),
        }
        for name in features:
            spread = F.coalesce(F.nullif(F.stddev_pop(name).over(last), F.lit(0.0)), F.lit(1.0))
            columns[f"z_{name}"] = (F.col(name) - F.avg(name).over(last)) / spread
        return rows.withColumns(columns)

    rows = trailing(df, depth + 1, build, order)
    ready = (F.col("_history") > depth) & (F.col("_usable") > 10) & F.col(features[0]).isNotNull()
    return rows.where(ready).select(*IDS, *[f"z_{name}" for name in features])

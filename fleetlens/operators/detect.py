"""Threshold and pattern detectors, their union, and remediation advice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.text import fixed
from fleetlens.operators.slices import AGENT_SERIES, Order, trailing
from fleetlens.sources.tables import constant_table

IDS = ("event_id", "ts", "agent_id")


def _anomaly(kind: str, severity: Column, description: Column, action: str,
             value: Column | None = None, threshold: float | None = None, score: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("type"), severity.alias("severity"),
        (F.lit(None) if score is None else score).cast("double").alias("score"),
        (F.lit(None) if value is None else value).cast("double").alias("value"),
        F.lit(threshold).cast("double").alias("threshold"),
        description.alias("description"), F.lit(action).alias("suggested_action"),
    )


def _threshold_checks(limits: dict[str, float]) -> list[tuple[Column, Column]]:
    checks = []
    for metric, kind, critical, severity, before, after, action in C.THRESHOLD_DETECTORS:
        value = F.col(metric)
        level = F.lit(severity) if critical is None else F.when(value > critical, "critical").otherwise(severity)
        text = F.concat(F.lit(before), value.cast("string"), F.lit(after))
        checks.append((value > limits[metric], _anomaly(kind, level, text, action, value, limits[metric])))
    return checks


def threshold_lists(df: DataFrame, limits: dict[str, float] = C.DETECTOR_LIMITS) -> DataFrame:
    """The threshold anomalies of each snapshot as one array, for snapshots that have any."""
    checks = _threshold_checks(limits)
    found = F.array_compact(F.array(*[F.when(holds, record) for holds, record in checks]))
    return df.where(reduce(lambda a, b: a | b, [holds for holds, _ in checks])).select(*IDS, found.alias("anomalies"))


def _emit(df: DataFrame, checks: list[tuple[Column, Column]]) -> DataFrame:
    """One row per check that holds. Rows on which none holds are dropped before the explode."""
    candidates = F.array(*[F.when(holds, record) for holds, record in checks])
    return (
        df.where(reduce(lambda a, b: a | b, [holds for holds, _ in checks]))
        .select(*IDS, F.explode(candidates).alias("a"))
        .where(F.col("a").isNotNull())
        .select(*IDS, "a.*")
    )


def threshold_anomalies(df: DataFrame, limits: dict[str, float] = C.DETECTOR_LIMITS) -> DataFrame:
    """Fixed limits on CPU, memory, disk and latency, in one pass without a shuffle."""
    return _emit(df, _threshold_checks(limits))


def _mean_from_end(values: Column, first: int, last: int) -> Column:
    """Mean of the elements ``first`` .. ``last`` counted from the end of an array (1 = last)."""
    picked = [F.try_element_at(values, F.lit(-i)) for i in range(first, last - 1, -1)]
    return reduce(lambda a, b: a + b, picked) / F.lit(float(len(picked)))


def present_index(metric: str, w: WindowSpec) -> Column:
    """Running count of the rows that have ``metric``: an x axis without gaps."""
    return F.count(metric).over(w.rowsBetween(Window.unboundedPreceding, 0))


def slope(metric: str, index: str, frame: WindowSpec) -> Column:
    """Least-squares slope per entry.

    Rounded to 9 decimals, so that limits and texts do not depend on the order of additions.
    """
    return F.round(F.regr_slope(metric, index).over(frame), 9)


def pattern_inputs(df: DataFrame, w: WindowSpec) -> DataFrame:
    """Trailing values the pattern detectors read; absent sections do not count as entries."""
    last20, last15 = w.rowsBetween(-19, 0), w.rowsBetween(-14, 0)
    df = df.withColumns({
        "_history": F.count("*").over(last20),
        "_cpu": F.collect_list("cpu_usage").over(last20),
        "_memory_n": F.count("memory_usage").over(last15),
        "_x": present_index("memory_usage", w),
    })
    return df.withColumns({
        "_slope": slope("memory_usage", "_x", last15),
        "_older": _mean_from_end(F.col("_cpu"), 15, 11),
        "_recent": _mean_from_end(F.col("_cpu"), 5, 1),
    })


def _jump_check(delta: float) -> tuple[Column, Column]:
    holds = (F.col("_history") >= 20) & (F.size("_cpu") >= 15) & (F.col("_recent") > F.col("_older") + delta)
    text = F.concat(
        F.lit("Rapid CPU increase detected: "), fixed(F.col("_older"), 1), F.lit("% → "), fixed(F.col("_recent"), 1), F.lit("%")
    )
    return holds, _anomaly("cpu_trend_anomaly", F.lit("high"), text, "investigate_cpu_spike")


def _leak_check(least: float) -> tuple[Column, Column]:
    holds = (F.col("_history") >= 20) & (F.col("_memory_n") >= 10) & (F.col("_slope") > least)
    text = F.concat(
        F.lit("Potential memory leak detected (trend: +"), fixed(F.col("_slope"), 1), F.lit("% per interval)")
    )
    return holds, _anomaly("memory_leak_pattern", F.lit("high"), text, "investigate_memory_leak")


def cpu_jump(df: DataFrame, delta: float = 30.0, order: Order = AGENT_SERIES) -> DataFrame:
    """Mean of the last 5 CPU values above that of the 5 values ten entries earlier."""
    return _emit(trailing(df, 20, pattern_inputs, order), [_jump_check(delta)])


def memory_leak(df: DataFrame, least: float = 2.0, order: Order = AGENT_SERIES) -> DataFrame:
    """Least-squares slope of the last 15 memory values above a limit per interval."""
    return _emit(trailing(df, 20, pattern_inputs, order), [_leak_check(least)])


def pattern_anomalies(df: DataFrame, order: Order = AGENT_SERIES) -> DataFrame:
    """CPU jumps and memory leaks from one windowed pass."""
    return _emit(trailing(df, 20, pattern_inputs, order), [_jump_check(30.0), _leak_check(2.0)])


def all_anomalies(df: DataFrame, limits: dict[str, float] = C.DETECTOR_LIMITS, order: Order = AGENT_SERIES) -> DataFrame:
    """Threshold and pattern anomalies from one windowed pass over the snapshots."""
    checks = [*_threshold_checks(limits), _jump_check(30.0), _leak_check(2.0)]
    return _emit(trailing(df, 20, pattern_inputs, order), checks)


def catalogue(spark) -> DataFrame:
    return constant_table(
        spark, C.REMEDIATION_CATALOGUE, "type string, actions array<string>, scripts array<string>, priority string"
    )


def with_remediation(anomalies: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Advice per anomaly type; unknown types get a manual investigation.

    The built-in catalogue of five rows is broadcast; for another one Spark decides by its size.
    """
    table = F.broadcast(catalogue(anomalies.sparkSession)) if table is None else table
    default = F.array(*map(F.lit, C.DEFAULT_ACTIONS))
    return anomalies.join(table, "type", "left").withColumns({
        "actions": F.coalesce("actions", default),
        "scripts": F.coalesce("scripts", F.array().cast("array<string>")),
        "priority": F.coalesce("priority", F.lit(C.DEFAULT_PRIORITY)),
    })

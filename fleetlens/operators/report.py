"""Reports over metrics, agents and alerts: counts, shares, summaries, top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.text import iso
from fleetlens.operators.quantiles import exact_quantiles
from fleetlens.operators.slices import AGENT_SERIES, Order, micros, numbered


def newest(df: DataFrame, limit: int = 100, agent_id=None, ts: str = "ts", ident: str = "event_id") -> DataFrame:
    """Newest rows first, optionally of one agent."""
    if agent_id is not None:
        df = df.where(F.col("agent_id") == agent_id)
    return df.orderBy(F.desc(ts), F.desc(ident)).limit(limit)


def newest_per_agent(df: DataFrame, k: int) -> DataFrame:
    """The ``k`` newest rows of every agent with their rank; the rank filter runs before the shuffle."""
    w = Window.partitionBy("agent_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def count_by(df: DataFrame, key: str, missing: str = "unknown") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(key), F.lit(missing)).alias(key)).agg(F.count("*").alias("n"))


def share_by(df: DataFrame, key: str, missing: str = "unknown") -> DataFrame:
    """Counts with their share in percent. The total is summed over the grouped rows."""
    counts = count_by(df, key, missing)
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.round(F.col("n") / total * 100, 6))


def anomaly_flag() -> Column:
    """True when any threshold detector would fire."""
    hits = [F.coalesce(F.col(m) > limit, F.lit(False)) for m, limit in C.DETECTOR_LIMITS.items()]
    return hits[0] | hits[1] | hits[2] | hits[3]


def flagged(df: DataFrame) -> DataFrame:
    """Adds ``is_anomaly`` and the worst threshold ``severity`` of each snapshot."""
    critical = (F.col("cpu_usage") > 95) | (F.col("memory_usage") > 95) | (F.col("disk_usage") > 98)
    high = (F.col("cpu_usage") > 80) | (F.col("memory_usage") > 85) | (F.col("disk_usage") > 90)
    severity = (
        F.when(critical, "critical").when(high, "high")
        .when(F.col("network_latency") > 200, "medium").otherwise("normal")
    )
    return df.withColumns({"is_anomaly": anomaly_flag(), "severity": severity})


def detection_counts(df: DataFrame) -> DataFrame:
    """Scanned, found, critical and detection rate, overall in one row."""
    return df.agg(
        F.count("*").alias("scanned"),
        F.count_if("is_anomaly").alias("found"),
        F.count_if(F.col("is_anomaly") & (F.col("severity") == "critical")).alias("critical"),
    ).withColumn("detection_rate", F.coalesce(F.col("found") / F.nullif("scanned", F.lit(0)) * 100, F.lit(0.0)))


def mean_bands(df: DataFrame) -> DataFrame:
    """Mean CPU, memory and disk with a band each."""
    means = df.agg(*[F.avg(F.coalesce(m, F.lit(0.0))).alias(m) for m in C.NORMAL_LIMITS])
    long = [
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("mean"),
                 F.when(F.col(m) > limit, "Above normal").otherwise("Normal range").alias("band"))
        for m, limit in C.NORMAL_LIMITS.items()
    ]
    return means.select(F.explode(F.array(*long)).alias("r")).select("r.*")


SUMMARY_METRICS = ["cpu_usage", "memory_usage", "disk_usage"]


def usage_summary(df: DataFrame, metrics: list[str] = SUMMARY_METRICS) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles, one row per metric."""
    moments = df.agg(*[
        F.struct(
            F.lit(m).alias("metric"), F.count(m).alias("n"), F.avg(m).alias("mean"),
            F.stddev_samp(m).alias("std"), F.min(m).alias("low"), F.max(m).alias("high"),
        ).alias(m)
        for m in metrics
    ]).select(F.explode(F.array(*metrics)).alias("r")).select("r.*")
    quartiles = exact_quantiles(df, metrics, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return moments.join(F.broadcast(quartiles), "metric")


def box_stats(df: DataFrame, metrics: list[str] = SUMMARY_METRICS) -> DataFrame:
    """Five-number summary and the fences 1.5 interquartile ranges beyond the quartiles."""
    spread = (F.col("q75") - F.col("q25")) * 1.5
    return usage_summary(df, metrics).select(
        "metric", "low", "q25", "q50", "q75", "high",
        (F.col("q25") - spread).alias("lower_fence"), (F.col("q75") + spread).alias("upper_fence"),
    )


def data_overview(df: DataFrame) -> DataFrame:
    """Points, agents, anomalies and the time they span."""
    return df.agg(
        F.count("*").alias("points"), F.count_distinct("agent_id").alias("agents"),
        F.count_if("is_anomaly").alias("anomalies"),
        ((F.max(micros("ts")) - F.min(micros("ts"))) / 1000000.0).alias("span_seconds"),
    ).withColumn("time_span", F.concat(F.col("points").cast("string"), F.lit(" points")))


def severity_timeline(df: DataFrame) -> DataFrame:
    """Occurrence index within each severity, and the severity's ordinal.

    A severity holds a large share of all rows, so the index is counted slice by slice.
    """
    level = F.create_map(*[F.lit(x) for pair in C.SEVERITY_LEVELS.items() for x in pair])
    order = Order(keys=("severity",))
    known = df.where(F.col("severity").isin(list(C.SEVERITY_LEVELS)))
    return numbered(known, "occurrence", order).withColumn("level", F.try_element_at(level, F.col("severity")))


def series(df: DataFrame, metrics: list[str], order: Order = AGENT_SERIES) -> DataFrame:
    """Sequence index per agent with the values to draw; an absent value is 0."""
    return numbered(df, "position", order).withColumns({m: F.coalesce(m, F.lit(0.0)) for m in metrics})


def cpu_overload(recent: DataFrame) -> DataFrame:
    """Agents whose newest CPU value exceeds that of five entries ago by 20, among ``recent``; an absent value is 0."""
    kind, probability, estimate, advice = C.CPU_OVERLOAD
    value = F.coalesce("cpu_usage", F.lit(0.0))
    five = newest_per_agent(recent, 5).groupBy("agent_id").agg(
        F.count("*").alias("_n"), F.max_by(value, -F.col("rank")).alias("newest"), F.max_by(value, "rank").alias("oldest"),
    )
    return five.where((F.col("_n") >= 5) & (F.col("newest") > F.col("oldest") + 20)).select(
        "agent_id", F.lit(kind).alias("type"), F.lit(probability).alias("probability"),
        F.lit(estimate).alias("time_estimate"), F.lit(advice).alias("recommendation"), "newest", "oldest",
    )


def memory_monotone(recent: DataFrame, direction: str = "rising") -> DataFrame:
    """Agents whose five newest memory values move strictly one way in time, among ``recent``; an absent value is 0."""
    kind, probability, estimate, advice = C.MEMORY_LEAK
    five = newest_per_agent(recent, 5)
    w = Window.partitionBy("agent_id").orderBy(F.desc("rank"))
    value = F.coalesce("memory_usage", F.lit(0.0))
    step = value - F.lag(value).over(w)
    ok = step > 0 if direction == "rising" else step < 0
    agents = five.withColumn("_ok", ok).groupBy("agent_id").agg(
        F.count("*").alias("_n"), F.bool_and(F.coalesce("_ok", F.lit(True))).alias("_all")
    )
    return agents.where((F.col("_n") >= 5) & F.col("_all")).select(
        "agent_id", F.lit(kind).alias("type"), F.lit(probability).alias("probability"),
        F.lit(estimate).alias("time_estimate"), F.lit(advice).alias("recommendation"),
    )


def alert_listing(alerts: DataFrame, status: str | None = None, severity: str | None = None, limit: int = 100) -> DataFrame:
    """Alerts newest first with the names readers expect, optionally filtered."""
    if status:
        alerts = alerts.where(F.col("status") == status)
    if severity:
        alerts = alerts.where(F.col("severity") == severity)
    top = alerts.orderBy(F.desc("first_seen"), "alert_id").limit(limit)
    return top.select(
        "alert_id", "agent_id", F.col("alert_type").alias("title"), "description", "severity", "status", "alert_type",
        iso("first_seen").alias("timestamp"), iso("last_seen").alias("resolved_at"),
    )


def alert_detail(alerts: DataFrame, alert_id: str) -> DataFrame:
    """One alert; an empty result means it does not exist."""
    return alerts.where(F.col("alert_id") == alert_id).select(
        "alert_id", "agent_id", F.col("alert_type").alias("title"), "description", "severity", "status",
        iso("first_seen").alias("timestamp"),
    )


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "resolved").alias("resolved"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.when(F.bool_or((F.col("severity") == "critical") & (F.col("status") == "active")), "Critical")
        .otherwise("Normal").alias("level"),
    )


def distinct_sketches(df: DataFrame, column: str, log_size: int = 14) -> DataFrame:
    """A HyperLogLog sketch of a column's distinct values per day, to be stored: 2^``log_size`` registers at most, whatever the rows.

    The relative standard error of a count is about 0.83 / sqrt(2^``log_size``), 0.65 % unless given otherwise. Rows without time count for no
    day, NULL values are not counted.
    """
    days = df.where(F.col("ts").isNotNull()).groupBy(F.to_date("ts").alias("day"))
    return days.agg(F.hll_sketch_agg(column, log_size).alias("sketch"))


def distinct_in_spans(sketches: DataFrame, days: int) -> DataFrame:
    """Estimated distinct values in the ``days`` days up to each day of the sketches, by merging them; no row is read again."""
    last = sketches.agg(F.max("day")).scalar()
    ends = sketches.select("sketch", F.explode(F.sequence("day", F.date_add("day", days - 1))).alias("day")).where(F.col("day") <= last)
    return ends.groupBy("day").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))

"""Alert episodes with deduplication and resolution, rules that must hold, notifications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.operators.slices import AGENT_SERIES, Order, micros, running
from fleetlens.sources.tables import constant_table

ALERT_ORDER = Order(keys=("type", "agent_id"), ident="_order")
# At equal times anomalies come before resolutions.
RESOLVE_OFFSET = 1 << 61
RULE_CELLS = 256


def _with_episodes(anomalies: DataFrame, resolves: DataFrame) -> DataFrame:
    """Anomalies and resolutions in order, numbered by the resolutions before them."""
    fields = ["severity", "description", "suggested_action"]
    opened = anomalies.select(
        "event_id", "ts", "agent_id", "type", F.coalesce("severity", F.lit("medium")).alias("severity"),
        F.coalesce("description", F.lit("")).alias("description"), "suggested_action",
        F.col("event_id").alias("_order"), F.lit(0).cast("bigint").alias("_resolve"),
    )
    closed = resolves.select(
        "event_id", "ts", "agent_id", "type", *[F.lit(None).cast("string").alias(f) for f in fields],
        (F.col("event_id") + RESOLVE_OFFSET).alias("_order"), F.lit(1).cast("bigint").alias("_resolve"),
    )
    rows = running(opened.unionByName(closed), {"_resolved": F.col("_resolve")}, ALERT_ORDER)
    # A resolution ends the episode it was counted after.
    return rows.withColumn("episode", F.col("_resolved") - F.col("_resolve")).drop("_resolved")


def alert_id() -> Column:
    return F.concat_ws("_", "type", F.coalesce(F.col("agent_id").cast("string"), F.lit("unknown")))


def _collapse(rows: DataFrame) -> DataFrame:
    """One row per episode, also those of resolutions without an open alert, which have count 0."""
    is_anomaly = F.col("_resolve") == 0
    first = F.when(is_anomaly, F.struct("ts", "event_id"))
    opening = F.min_by(F.struct("severity", "description", "suggested_action"), first)
    return (
        rows.groupBy("type", "agent_id", "episode")
        .agg(
            opening.alias("o"),
            F.min(F.when(is_anomaly, F.col("ts"))).alias("first_seen"),
            F.max(F.when(is_anomaly, F.col("ts"))).alias("last_seen"),
            F.count_if(is_anomaly).alias("count"),
            F.min(F.when(~is_anomaly, F.col("ts"))).alias("resolved_at"),
        )
    )


def _listed(collapsed: DataFrame) -> DataFrame:
    # A resolution without an open alert changes nothing.
    return collapsed.where(F.col("count") > 0).select(
        alert_id().alias("alert_id"), "type", "agent_id", "episode", "o.*", "first_seen", "last_seen", "count",
        F.when(F.col("resolved_at").isNull(), "active").otherwise("resolved").alias("status"), "resolved_at",
    )


def alert_episodes(anomalies: DataFrame, resolves: DataFrame) -> DataFrame:
    """One row per alert episode: repeats raise the count, a resolution closes the episode.

    Severity and text are those of the first anomaly.
    """
    return _listed(_collapse(_with_episodes(anomalies, resolves)))


def _continued(anomalies: DataFrame, resolves: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The rows with the number of their episode, and one row per episode, both given the state before them."""
    keys = ["type", "agent_id"]
    rows = _with_episodes(anomalies, resolves)
    now = _collapse(rows)
    if before is None:
        return rows, now
    rows = rows.join(before.select(*keys, F.col("episode").alias("_base")), keys, "left")
    rows = rows.withColumn("episode", F.col("episode") + F.coalesce("_base", F.lit(0))).drop("_base")
    now = now.join(before.select(*keys, F.struct("episode", "o", "first_seen", "last_seen", "count").alias("_b")), keys, "full_outer")
    held, base = F.coalesce("_b.count", F.lit(0)), F.coalesce("_b.episode", F.lit(0))
    local = F.coalesce("episode", F.lit(0))
    goes_on = (local == 0) & (held > 0)
    return rows, now.select(
        *keys, (base + local).alias("episode"),
        F.when(goes_on, F.col("_b.o")).otherwise(F.col("o")).alias("o"),
        F.when(goes_on, F.col("_b.first_seen")).otherwise(F.col("first_seen")).alias("first_seen"),
        F.when(goes_on, F.coalesce("last_seen", "_b.last_seen")).otherwise(F.col("last_seen")).alias("last_seen"),
        (F.coalesce("count", F.lit(0)) + F.when(goes_on, held).otherwise(0)).alias("count"), "resolved_at",
    )


def continue_episodes(
    anomalies: DataFrame, resolves: DataFrame, before: DataFrame | None, channels: list[str] = C.NOTIFICATION_CHANNELS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Episodes that end with these rows, the state after them, and their notifications, given the state before them.

    The state has a row per type and agent: the number of its current episode, and the alert if one is open. All rows
    are later than those that led to the state.
    """
    keys = ["type", "agent_id"]
    rows, now = _continued(anomalies, resolves, before)
    closed = _listed(now.where(F.col("resolved_at").isNotNull()))
    is_open = F.col("resolved_at").isNull() & (F.col("count") > 0)
    last = F.max(F.col("episode") + F.col("resolved_at").isNotNull().cast("bigint")).alias("episode")
    pick = lambda c: F.max_by(c, F.when(is_open, F.col("episode"))).alias(c)
    state = now.groupBy(*keys).agg(
        last, pick("o"), pick("first_seen"), pick("last_seen"), F.coalesce(F.max(F.when(is_open, F.col("count"))), F.lit(0)).alias("count"))
    return closed, state, _notified(rows, now, channels)


def open_episodes(state: DataFrame) -> DataFrame:
    """The open alerts of a state, as episodes."""
    return _listed(state.withColumn("resolved_at", F.lit(None).cast(state.schema["last_seen"].dataType)))


def active(episodes: DataFrame) -> DataFrame:
    return episodes.where(F.col("status") == "active")


def history(episodes: DataFrame, limit: int = 100) -> DataFrame:
    """Creation records, newest first."""
    created = episodes.select("alert_id", "type", "agent_id", "episode", "severity", "description", "first_seen")
    return created.orderBy(F.desc("first_seen"), "alert_id").limit(limit)


def purge(episodes: DataFrame, asof: Column, hours: int = 24) -> DataFrame:
    """Drop episodes resolved longer ago than ``hours``."""
    old = (F.col("status") == "resolved") & (F.col("resolved_at") < asof - F.expr(f"INTERVAL {hours} HOURS"))
    return episodes.where(~F.coalesce(old, F.lit(False)))


def alert_table(episodes: DataFrame) -> DataFrame:
    """Rows of the stored alerts table, one per episode."""
    return episodes.select(
        F.concat_ws("_", "alert_id", "episode").alias("alert_id"), "agent_id", F.col("type").alias("alert_type"),
        "severity", "description", "status", "first_seen", "last_seen",
    )


def apply_resolutions(alerts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Mark stored alerts as resolved: ``resolutions`` holds alert_id and the time of the request."""
    last = resolutions.groupBy("alert_id").agg(F.max("ts").alias("_at"))
    hit = F.col("_at").isNotNull()
    return alerts.join(last, "alert_id", "left").withColumns({
        "status": F.when(hit, "resolved").otherwise(F.col("status")),
        "last_seen": F.when(hit, F.col("_at")).otherwise(F.col("last_seen")),
    }).drop("_at")


def _notified(rows: DataFrame, episodes: DataFrame, channels: list[str]) -> DataFrame:
    keys = ["type", "agent_id", "episode"]
    texts = _listed(episodes).select(*keys, "alert_id", "description")
    critical = rows.where((F.col("_resolve") == 0) & (F.col("severity") == "critical")).select(*keys, "event_id", "ts")
    return critical.join(texts, keys).select(
        "event_id", "ts", "alert_id", "agent_id", "description",
        F.explode(F.array(*map(F.lit, channels))).alias("channel"),
    )


def notifications(anomalies: DataFrame, resolves: DataFrame, channels: list[str] = C.NOTIFICATION_CHANNELS) -> DataFrame:
    """Every critical anomaly, once per channel, with the text of the episode it belongs to."""
    rows = _with_episodes(anomalies, resolves)
    return _notified(rows, _collapse(rows), channels)


def rules(spark) -> DataFrame:
    return constant_table(
        spark, C.ALERT_RULES, "rule string, metric string, threshold double, duration_s int, severity string"
    )


def rule_matches(df: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Every snapshot value above the threshold of a rule on the same metric."""
    table = F.broadcast(rules(df.sparkSession)) if table is None else table
    long = df.unpivot(
        ["event_id", "ts", "agent_id"], ["cpu_usage", "memory_usage", "disk_usage"], "metric", "value"
    )
    return long.join(table, "metric").where(F.col("value") > F.col("threshold"))


def _number_below(sorted_values: Column, value: Column) -> Column:
    """How many of the sorted values are less than ``value``, by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(sorted_values, n + step - 1) < value, n + step).otherwise(n))


def rules_crossed(df: DataFrame, table: DataFrame, metrics: list[str], cells: int = RULE_CELLS) -> DataFrame:
    """Per snapshot value how many rules of a caller's ``table`` (rule, metric, threshold) lie below it, and the highest of them.

    Those rules are the first ``n_rules`` of their metric in the order of thresholds, so no pair of value and rule is made. Equal
    thresholds count once each and are kept as one entry. Thresholds are cut at approximate quantiles into at most ``cells``
    cells a metric; a value meets the entries of its own cell only, found by bisection, and the counts of the cells below.
    The join is on metric and cell, and Spark chooses it by size. Values and thresholds that are NULL match nothing; of equal thresholds the
    greatest rule id is named. Without rules there are no rows.
    """
    known = table.where(F.col("metric").isin(metrics) & F.col("threshold").isNotNull()).groupBy("metric", F.col("threshold").cast("double").alias("threshold")).agg(
        F.count("*").alias("n"), F.max("rule").alias("rule"))
    places = [i / cells for i in range(1, cells)]
    bounds = known.groupBy("metric").agg(F.array_sort(F.array_distinct(F.percentile_approx("threshold", places, 20 * cells))).alias("_bounds"))
    bounds = F.broadcast(bounds)  # a row per metric in the list, of fewer than ``cells`` numbers
    entry = F.struct("threshold", "n", "rule")
    filled = known.join(bounds, "metric").groupBy("metric", _number_below(F.col("_bounds"), F.col("threshold")).alias("_cell")).agg(
        F.sort_array(F.collect_list(entry)).alias("_entries"), F.sum("n").alias("_n"), F.max(entry).alias("_top"))
    every = bounds.select("metric", F.explode(F.sequence(F.lit(0), F.size("_bounds"))).alias("_cell"))
    lower = Window.partitionBy("metric").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    index = every.join(filled, ["metric", "_cell"], "left").select(
        "metric", "_cell", F.transform("_entries", lambda e: e["threshold"]).alias("_thresholds"), "_entries",
        F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before"), F.max("_top").over(lower).alias("_highest"))
    total = F.aggregate("_entries", F.array(F.lit(0).cast("bigint")), lambda sums, e: F.concat(sums, F.array(F.element_at(sums, -1) + e["n"])))
    index = index.withColumn("_sums", F.when(F.col("_entries").isNotNull(), total))
    long = df.unpivot(["event_id", "ts", "agent_id"], metrics, "metric", "value").where("value IS NOT NULL")
    placed = long.join(bounds, "metric").withColumn("_cell", _number_below(F.col("_bounds"), F.col("value"))).drop("_bounds")
    at = F.coalesce(_number_below(F.col("_thresholds"), F.col("value")), F.lit(0))
    found = placed.join(index, ["metric", "_cell"]).withColumn("_at", at)
    highest = F.when(F.col("_at") > 0, F.get("_entries", F.col("_at") - 1)).otherwise(F.col("_highest"))
    found = found.withColumns({"n_rules": F.col("_before") + F.coalesce(F.get("_sums", F.col("_at")), F.lit(0)), "_found": highest})
    return found.where("n_rules > 0").select(
        "event_id", "ts", "agent_id", "metric", "value", "n_rules", F.col("_found.threshold").alias("threshold"), F.col("_found.rule").alias("rule"))


def sustained_breaches(df: DataFrame, table: list[tuple] = C.ALERT_RULES, order: Order = AGENT_SERIES) -> DataFrame:
    """Unbroken runs above a rule's threshold that last at least the rule's duration.

    A run is identified by the number of snapshots below the threshold before it; an
    absent section breaks a run.
    """
    over = {rule: F.coalesce(F.col(metric) > threshold, F.lit(False)) for rule, metric, threshold, *_ in table}
    counts = running(df, {f"_below_{rule}": (~hit).cast("bigint") for rule, hit in over.items()}, order)
    hits = F.array(*[
        F.when(over[rule], F.struct(
            F.lit(rule).alias("rule"), F.lit(metric).alias("metric"), F.lit(severity).alias("severity"),
            F.lit(duration).alias("duration_s"), F.col(f"_below_{rule}").alias("island"),
        ))
        for rule, metric, _, duration, severity in table
    ])
    any_hit = reduce(lambda a, b: a | b, over.values())
    runs = (
        counts.where(any_hit)
        .select("agent_id", "ts", F.explode(hits).alias("h"))
        .where(F.col("h").isNotNull())
        .groupBy("agent_id", "h.rule", "h.metric", "h.severity", "h.duration_s", "h.island")
        .agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("samples"))
    )
    lasted = micros("ended_at") - micros("started_at")
    return runs.where(lasted >= F.col("duration_s") * F.lit(1000000).cast("bigint")).drop("island", "duration_s")

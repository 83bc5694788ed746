"""Queries on anomalies, trends and forecasts, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import detect, flatten, health, trend
from fleetlens.plans import views as V
from fleetlens.plans.views import sql

ANOMALY_COLUMNS = [
    "event_id", "ts", "agent_id", "type", "severity", "value", "threshold", "description", "suggested_action",
]


def _r(*names: str) -> dict:
    return {n: F.round(n, 6) for n in names}


def anomalies_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return detect.threshold_anomalies(V.tel_gap(spark, sf)).select(*ANOMALY_COLUMNS)


def anomalies_cpu_jump(spark: SparkSession, sf: str) -> DataFrame:
    found = detect.cpu_jump(V.tel_gap(spark, sf))
    return found.select("event_id", "ts", "agent_id", "type", "severity", "description", "suggested_action")


def anomalies_memory_leak(spark: SparkSession, sf: str) -> DataFrame:
    found = detect.memory_leak(V.tel_gap(spark, sf))
    return found.select("event_id", "ts", "agent_id", "type", "severity", "description", "suggested_action")


def anomalies_all_with_remediation(spark: SparkSession, sf: str) -> DataFrame:
    advised = detect.with_remediation(detect.all_anomalies(V.tel(spark, sf)))
    return advised.select(
        "event_id", "ts", "agent_id", "type", "severity", "value", "threshold", "description", "suggested_action",
        F.concat_ws(",", "actions").alias("actions"), F.concat_ws(",", "scripts").alias("scripts"), "priority",
    )


def anomalies_on_latest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    latest = health.latest_per_agent(V.tel(spark, sf))
    advised = detect.with_remediation(detect.threshold_anomalies(latest))
    return advised.select("agent_id", "ts", "type", "severity", "value", F.concat_ws(",", "actions").alias("actions"), "priority")


def forecast_disk_full(spark: SparkSession, sf: str) -> DataFrame:
    found = trend.forecast_exhaustion(V.tel_gap(spark, sf), "disk_usage")
    return found.withColumns(_r("confidence", "trend"))


def forecast_memory_exhaustion(spark: SparkSession, sf: str) -> DataFrame:
    found = trend.forecast_exhaustion(V.tel_gap(spark, sf), "memory_usage")
    return found.withColumns(_r("confidence", "trend"))


def failure_predictions(spark: SparkSession, sf: str) -> DataFrame:
    found = trend.predict_failures(V.tel_gap(spark, sf))
    return found.select(
        "event_id", "agent_id",
        F.col("disk_full_prediction.time_to_failure").alias("disk_full_in"),
        F.col("memory_exhaustion_prediction.time_to_failure").alias("memory_out_in"),
        F.col("cpu_overload_prediction").alias("cpu_overload"),
    )


def insights_trend(spark: SparkSession, sf: str) -> DataFrame:
    rows = trend.insights(V.tel_gap(spark, sf)).drop("efficiency_score")
    return rows.withColumns(_r("cpu_change", "cpu_average", "memory_change", "memory_average"))


def efficiency_score(spark: SparkSession, sf: str) -> DataFrame:
    return trend.insights(V.tel_gap(spark, sf)).select("event_id", "agent_id", "efficiency_score")


def insight_texts(spark: SparkSession, sf: str) -> DataFrame:
    return trend.insight_texts(trend.insights(V.tel_gap(spark, sf)))


def counter_rate(spark: SparkSession, sf: str) -> DataFrame:
    return trend.counter_rates(V.counters(spark, sf), {"bytes_sent_total": "bytes_sent_per_sec"})


def disk_rates(rows: DataFrame) -> DataFrame:
    """Snapshots whose disk section has the rates since the agent's snapshot before."""
    rows = rows.withColumns({"_read": F.col("disk.read_bytes_total"), "_write": F.col("disk.write_bytes_total")})
    rows = trend.counter_rates(rows, {"_read": "_read_rate", "_write": "_write_rate"})
    disk = F.col("disk").withField("read_bytes_per_sec", F.col("_read_rate")).withField(
        "write_bytes_per_sec", F.col("_write_rate"))
    return rows.withColumn("disk", disk).drop("_read", "_write", "_read_rate", "_write_rate")


def _with_disk_rates(spark: SparkSession, sf: str) -> DataFrame:
    return disk_rates(V.snapshots(spark, sf))


def feature_vectors_system(spark: SparkSession, sf: str) -> DataFrame:
    names = [slot[0] for slot in flatten.SYSTEM_SLOTS]
    return flatten.system_features(_with_disk_rates(spark, sf)).select("event_id", "agent_id", *names)


def feature_vectors_network(spark: SparkSession, sf: str) -> DataFrame:
    names = [slot[0] for slot in flatten.NETWORK_SLOTS]
    return flatten.network_features(V.snapshots(spark, sf)).select("event_id", "agent_id", *names)


def zscore_features(spark: SparkSession, sf: str) -> DataFrame:
    slots = [s for s in flatten.SYSTEM_SLOTS if s[0] not in ("disk_read_rate", "disk_write_rate")]
    names = [s[0] for s in slots]
    rows = flatten.feature_columns(V.snapshots(spark, sf), slots).select("event_id", "ts", "agent_id", *names)
    return trend.scaled(rows, names, 50).withColumns(_r(*[f"z_{n}" for n in names]))


_JUMP = """
hist AS (
  SELECT event_id, ts, agent_id,
         count(*) OVER w20 AS history,
         list(cpu_usage) FILTER (cpu_usage IS NOT NULL) OVER w20 AS a
  FROM {t} WINDOW w20 AS (PARTITION BY agent_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
jump AS (
  SELECT event_id, ts, agent_id, (a[-15] + a[-14] + a[-13] + a[-12] + a[-11]) / 5 AS older,
         (a[-5] + a[-4] + a[-3] + a[-2] + a[-1]) / 5 AS recent
  FROM hist WHERE history >= 20 AND len(a) >= 15)"""
_JUMP_SELECT = """
SELECT event_id, ts, agent_id, 'cpu_trend_anomaly' AS type, 'high' AS severity,
       printf('Rapid CPU increase detected: %.1f%% → %.1f%%', older, recent) AS description,
       'investigate_cpu_spike' AS suggested_action
FROM jump WHERE recent > older + 30"""
_LEAK = """
mem AS (
  SELECT event_id, ts, agent_id, memory_usage, count(*) OVER w20 AS history,
         count(memory_usage) OVER w15 AS n,
         count(memory_usage) OVER (PARTITION BY agent_id ORDER BY ts, event_id) AS x
  FROM {t} WINDOW w20 AS (PARTITION BY agent_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
                  w15 AS (PARTITION BY agent_id ORDER BY ts, event_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)),
leak AS (
  SELECT *, round(regr_slope(memory_usage, x) OVER (PARTITION BY agent_id ORDER BY ts, event_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), 9) AS slope
  FROM mem)"""
_LEAK_SELECT = """
SELECT event_id, ts, agent_id, 'memory_leak_pattern' AS type, 'high' AS severity,
       printf('Potential memory leak detected (trend: +%.1f%% per interval)', slope) AS description,
       'investigate_memory_leak' AS suggested_action
FROM leak WHERE history >= 20 AND n >= 10 AND slope > 2"""

_GAP_ANOMALIES = """
SELECT event_id, ts, agent_id, type, severity, value, threshold, description, suggested_action FROM anomaly_events
WHERE NOT (type = 'cpu_threshold_breach' AND event_id % 7 = 0) AND NOT (type = 'memory_threshold_breach' AND event_id % 5 = 0)"""

_CATALOGUE = """
catalogue AS (
  SELECT 'cpu_threshold_breach' AS type, 'kill_high_cpu_processes,restart_services,scale_horizontally' AS actions,
         'kill_top_cpu_process.sh,restart_critical_services.sh' AS scripts, 'high' AS priority
  UNION ALL SELECT 'memory_threshold_breach', 'clear_cache,restart_memory_intensive_services,enable_swap', 'clear_system_cache.sh,restart_services.sh', 'high'
  UNION ALL SELECT 'disk_threshold_breach', 'cleanup_temp_files,rotate_logs,compress_old_files', 'disk_cleanup.sh,log_rotation.sh', 'critical'
  UNION ALL SELECT 'network_latency_high', 'restart_network_services,flush_dns_cache,check_firewall_rules', 'network_reset.sh,dns_flush.sh', 'medium'
  UNION ALL SELECT 'memory_leak_pattern', 'restart_suspected_services,dump_memory_analysis,enable_memory_monitoring', 'restart_leaky_services.sh,memory_dump.sh', 'high')"""

_ALL = f"""
WITH {_JUMP.format(t='tel').strip()},
{_LEAK.format(t='tel').strip()},
{_CATALOGUE.strip()},
found AS (
  SELECT event_id, ts, agent_id, type, severity, value, threshold, description, suggested_action FROM anomaly_events
  UNION ALL SELECT event_id, ts, agent_id, type, severity, NULL, NULL, description, suggested_action FROM ({_JUMP_SELECT})
  UNION ALL SELECT event_id, ts, agent_id, type, severity, NULL, NULL, description, suggested_action FROM ({_LEAK_SELECT}))
SELECT event_id, ts, agent_id, f.type AS type, severity, value, threshold, description, suggested_action,
       coalesce(actions, 'manual_investigation') AS actions, coalesce(scripts, '') AS scripts, coalesce(priority, 'low') AS priority
FROM found f LEFT JOIN catalogue c ON f.type = c.type"""

_LATEST = """
WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY ts DESC, event_id DESC) AS rn FROM tel) WHERE rn = 1),
""" + _CATALOGUE.strip() + """
SELECT a.agent_id, a.ts, a.type AS type, a.severity, a.value, coalesce(actions, 'manual_investigation') AS actions, coalesce(priority, 'low') AS priority
FROM anomaly_events a JOIN latest l ON a.event_id = l.event_id LEFT JOIN catalogue c ON a.type = c.type"""


def _forecast_cte(metric: str) -> str:
    w = "(PARTITION BY agent_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
    return f"""
x_{metric} AS (SELECT event_id, ts, agent_id, {metric} AS m, count(*) OVER {w} AS history, count({metric}) OVER {w} AS n,
             count({metric}) OVER (PARTITION BY agent_id ORDER BY ts, event_id) AS x FROM tel_gap),
s_{metric} AS (SELECT *, round(regr_slope(m, x) OVER {w}, 9) AS slope FROM x_{metric})"""


def _forecast_sql(metric: str, ceiling: float, least: float, horizon: int, cap: float, factor: float) -> str:
    return sql(f"""
WITH {_forecast_cte(metric).strip()}
SELECT event_id, ts, agent_id, CAST(trunc(({ceiling} - m) / slope) AS INT) AS time_to_failure,
       round(least(CAST({cap} AS DOUBLE), slope * {factor}), 6) AS confidence, m AS current_usage, round(slope, 6) AS trend
FROM s_{metric} WHERE history >= 10 AND m IS NOT NULL AND n >= 5 AND slope > {least} AND ({ceiling} - m) / slope < {horizon}
""", "tel_gap")


_PREDICTIONS = sql(f"""
WITH {_forecast_cte('disk_usage').strip()},
{_forecast_cte('memory_usage').strip()}
SELECT d.event_id, d.agent_id,
       CASE WHEN d.history >= 10 AND d.n >= 5 AND d.slope > 0.1 AND (100 - d.m) / d.slope < 100 THEN CAST(trunc((100 - d.m) / d.slope) AS INT) END AS disk_full_in,
       CASE WHEN m.history >= 10 AND m.m IS NOT NULL AND m.n >= 5 AND m.slope > 0.5 AND (95 - m.m) / m.slope < 50 THEN CAST(trunc((95 - m.m) / m.slope) AS INT) END AS memory_out_in,
       CAST(NULL AS DOUBLE) AS cpu_overload
FROM s_disk_usage d JOIN s_memory_usage m ON d.event_id = m.event_id""", "tel_gap")

_INSIGHT = """
i AS (
  SELECT event_id, ts, agent_id,
         count(*) OVER (p ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS history,
         avg(c) OVER (p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) - avg(c) OVER (p ROWS BETWEEN 9 PRECEDING AND 7 PRECEDING) AS cpu_change,
         avg(c) OVER (p ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS cpu_average,
         avg(m) OVER (p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) - avg(m) OVER (p ROWS BETWEEN 9 PRECEDING AND 7 PRECEDING) AS memory_change,
         avg(m) OVER (p ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS memory_average
  FROM (SELECT *, coalesce(cpu_usage, 0) AS c, coalesce(memory_usage, 0) AS m FROM tel_gap)
  WINDOW p AS (PARTITION BY agent_id ORDER BY ts, event_id))""".replace("(p ROWS", "(PARTITION BY agent_id ORDER BY ts, event_id ROWS").replace(
    "\n  WINDOW p AS (PARTITION BY agent_id ORDER BY ts, event_id)", "")

_Z_SLOTS = {
    "cpu_usage": "cpu_usage", "load_1m": "(v % 1601) / CAST(100 AS DOUBLE)",
    "load_5m": "((v + event_id) % 1601) / CAST(100 AS DOUBLE)", "context_switches": "CAST(v + event_id AS DOUBLE)",
    "memory_usage": "memory_usage", "memory_available": "((v * 17) % 1638401) / CAST(100 AS DOUBLE)",
    "swap_usage": "((v * 5) % 10001) / CAST(100 AS DOUBLE)", "disk_usage": "disk_usage", "io_wait": "CAST(0 AS DOUBLE)",
}
_COMPLETE = "event_id % 7 <> 0 AND event_id % 5 <> 0"


def _zscore_sql() -> str:
    w = "(PARTITION BY agent_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"
    slots = ", ".join(f"CASE WHEN {_COMPLETE} THEN {e} END AS {n}" for n, e in _Z_SLOTS.items())
    z = ", ".join(
        f"round(({n} - avg({n}) OVER {w}) / coalesce(nullif(stddev_pop({n}) OVER {w}, 0), 1), 6) AS z_{n}" for n in _Z_SLOTS
    )
    columns = ", ".join(f"z_{n}" for n in _Z_SLOTS)
    return sql(f"""
WITH f AS (SELECT event_id, ts, agent_id, {slots} FROM snap),
z AS (SELECT event_id, ts, agent_id, cpu_usage, {z}, count(cpu_usage) OVER {w} AS usable,
             count(*) OVER (PARTITION BY agent_id ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND CURRENT ROW) AS history FROM f)
SELECT event_id, ts, agent_id, {columns} FROM z WHERE history > 50 AND usable > 10 AND cpu_usage IS NOT NULL""", "snap")


def _rate_sql(value: str, table: str, name: str) -> str:
    w = "(PARTITION BY agent_id ORDER BY ts, event_id)"
    elapsed = f"(epoch_us(ts) - lag(epoch_us(ts)) OVER {w})"
    return f"""CASE WHEN lag(ts) OVER {w} IS NULL THEN CAST(0 AS DOUBLE) WHEN {elapsed} > 0
       THEN round(({value} - lag({value}) OVER {w}) * CAST(1000000 AS DOUBLE) / {elapsed}, 2) END AS {name}"""


def _feature_sql() -> str:
    rates = _rate_sql("v * 1024", "snap", "r") + ", " + _rate_sql("v * 2048", "snap", "w")
    slots = dict(list(_Z_SLOTS.items())[:-1]) | {"disk_read_rate": "r", "disk_write_rate": "w", "io_wait": "CAST(0 AS DOUBLE)"}
    columns = ", ".join(f"CASE WHEN {_COMPLETE} THEN {e} END AS {n}" for n, e in slots.items())
    return sql(f"WITH f AS (SELECT *, {rates} FROM snap)\nSELECT event_id, agent_id, {columns} FROM f", "snap")


QUERIES = {
    "anomalies_threshold": (anomalies_threshold, sql(_GAP_ANOMALIES, "anomaly_events")),
    "anomalies_cpu_jump": (anomalies_cpu_jump, sql("WITH " + _JUMP.format(t="tel_gap").strip() + _JUMP_SELECT, "tel_gap")),
    "anomalies_memory_leak": (anomalies_memory_leak, sql("WITH " + _LEAK.format(t="tel_gap").strip() + _LEAK_SELECT, "tel_gap")),
    "anomalies_all_with_remediation": (anomalies_all_with_remediation, sql(_ALL, "anomaly_events")),
    "anomalies_on_latest_snapshot": (anomalies_on_latest_snapshot, sql(_LATEST, "anomaly_events")),
    "forecast_disk_full": (forecast_disk_full, _forecast_sql("disk_usage", 100, 0.1, 100, 0.9, 10)),
    "forecast_memory_exhaustion": (forecast_memory_exhaustion, _forecast_sql("memory_usage", 95, 0.5, 50, 0.85, 5)),
    "failure_predictions": (failure_predictions, _PREDICTIONS),
    "insights_trend": (insights_trend, sql(f"""
WITH {_INSIGHT.strip()}
SELECT event_id, ts, agent_id,
       CASE WHEN cpu_change > 5 THEN 'increasing' WHEN cpu_change < -5 THEN 'decreasing' ELSE 'stable' END AS cpu_direction,
       round(cpu_change, 6) AS cpu_change, round(cpu_average, 6) AS cpu_average,
       CASE WHEN memory_change > 5 THEN 'increasing' WHEN memory_change < -5 THEN 'decreasing' ELSE 'stable' END AS memory_direction,
       round(memory_change, 6) AS memory_change, round(memory_average, 6) AS memory_average
FROM i WHERE history >= 10""", "tel_gap")),
    "efficiency_score": (efficiency_score, sql(f"""
WITH {_INSIGHT.strip()}
SELECT event_id, agent_id, greatest(0, CAST(trunc(100 - (cpu_average * 0.4 + memory_average * 0.4 + greatest(CAST(0 AS DOUBLE), cpu_change) * 0.2)) AS INT)) AS efficiency_score
FROM i WHERE history >= 10""", "tel_gap")),
    "insight_texts": (insight_texts, sql(f"""
WITH {_INSIGHT.strip()}
SELECT event_id, ts, agent_id, 'CPU usage has increased significantly in recent measurements' AS insight,
       'Consider investigating processes causing increased CPU usage' AS recommendation FROM i WHERE history >= 10 AND cpu_change > 10
UNION ALL
SELECT event_id, ts, agent_id, 'Memory usage shows concerning upward trend', 'Monitor for potential memory leaks'
FROM i WHERE history >= 10 AND memory_change > 8""", "tel_gap")),
    "counter_rate": (counter_rate, sql(
        "SELECT event_id, ts, agent_id, bytes_sent_total, " + _rate_sql("bytes_sent_total", "counters", "bytes_sent_per_sec")
        + " FROM counters", "counters")),
    "feature_vectors_system": (feature_vectors_system, _feature_sql()),
    "feature_vectors_network": (feature_vectors_network, sql("""
SELECT event_id, agent_id, network_latency AS latency, CAST(0 AS DOUBLE) AS packet_loss, CAST(0 AS DOUBLE) AS bandwidth_usage,
       CAST(v % 300 AS DOUBLE) AS connections, ((v * 11) % 1000001) / CAST(100 AS DOUBLE) AS sent_rate,
       ((v * 19) % 1000001) / CAST(100 AS DOUBLE) AS received_rate
FROM snap""", "snap")),
    "zscore_features": (zscore_features, _zscore_sql()),
}

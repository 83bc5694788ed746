"""Queries on health, reports, alerts and agents, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.text import iso, label
from fleetlens.operators import agents as A
from fleetlens.operators import alerts as L
from fleetlens.operators import detect, flatten, health, report
from fleetlens.plans import views as V
from fleetlens.plans.views import sql
from fleetlens.session import written

USAGE = ["cpu_usage", "memory_usage", "disk_usage"]
ALL_METRICS = [*USAGE, "network_latency"]
# The compared agents, as chosen by a reader.
SELECTED = [3, 8]
# Liveness in the test data, where snapshots are hours apart: 960 missed intervals are 8 hours.
MISSED = 960


def last_ts(df: DataFrame) -> Column:
    """The newest time in the input, which batch queries use as the present."""
    return df.agg(F.max("ts")).scalar()


def _anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return detect.threshold_anomalies(V.tel(spark, sf))


def _episodes(spark: SparkSession, sf: str) -> DataFrame:
    return L.alert_episodes(_anomalies(spark, sf), V.resolve_events(spark, sf))


# Health -------------------------------------------------------------------------------------

def health_check(spark: SparkSession, sf: str) -> DataFrame:
    silent = V.agents(spark, sf).select("agent_id").union(V.agents(spark, sf).select(F.col("agent_id") + 1000000))
    return health.health_check(health.latest_per_agent(V.tel_gap(spark, sf)), silent)


def health_issues(spark: SparkSession, sf: str) -> DataFrame:
    return health.health_issues(health.latest_per_agent(V.tel_gap(spark, sf)))


def fleet_health_score(spark: SparkSession, sf: str) -> DataFrame:
    agents = A.liveness(V.tel(spark, sf), last_ts(V.tel(spark, sf)), MISSED)
    scored = health.fleet_score(agents, report.flagged(V.tel(spark, sf)))
    return scored.withColumn("health_score", F.round("health_score", 6))


def gauge_bands(spark: SparkSession, sf: str) -> DataFrame:
    return health.gauge_bands(health.latest_per_agent(V.tel(spark, sf)))


def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return health.recommendations(health.latest_per_agent(V.tel(spark, sf)))


# Metrics ------------------------------------------------------------------------------------

def metrics_newest(spark: SparkSession, sf: str) -> DataFrame:
    rows = report.newest(V.metrics_json(spark, sf), 100)
    return flatten.stored_metrics(rows).drop("raw_data").withColumn("ts", iso("ts"))


def metrics_of_agent(spark: SparkSession, sf: str) -> DataFrame:
    return report.newest(V.tel(spark, sf), 50, agent_id=SELECTED[0]).select("event_id", "ts", "agent_id", *ALL_METRICS)


def metrics_latest_per_agent(spark: SparkSession, sf: str) -> DataFrame:
    return health.latest_per_agent(V.tel(spark, sf).select("event_id", "ts", "agent_id", *ALL_METRICS))


def metrics_json_defaults(spark: SparkSession, sf: str) -> DataFrame:
    return flatten.stored_metrics(V.metrics_json(spark, sf)).drop("raw_data")


def headline_values(spark: SparkSession, sf: str) -> DataFrame:
    return flatten.headline(V.snapshots(spark, sf)).select("event_id", "agent_id", *ALL_METRICS)


def detector_values(spark: SparkSession, sf: str) -> DataFrame:
    return flatten.detector_values(V.snapshots(spark, sf)).select("event_id", "agent_id", *ALL_METRICS)


def iso_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.when(F.col("event_id") % 10 != 0, F.col("ts"))
    return V.tel(spark, sf).select("event_id", iso(F.date_trunc("second", shown)).alias("second"), iso(shown).alias("timestamp"))


def platform_columns(spark: SparkSession, sf: str) -> DataFrame:
    return flatten.platform_columns(V.snapshots(spark, sf))


def limit_then_group(spark: SparkSession, sf: str) -> DataFrame:
    recent = report.newest(V.tel(spark, sf), 100)
    return recent.groupBy("agent_id").agg(F.count("*").alias("n"), F.round(F.avg("cpu_usage"), 6).alias("cpu_mean"))


def dash_cpu_overload(spark: SparkSession, sf: str) -> DataFrame:
    return report.cpu_overload(V.tel(spark, sf))


def dash_cpu_overload_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return report.cpu_overload(V.tel_gap(spark, sf))


def dash_cpu_overload_newest_100(spark: SparkSession, sf: str) -> DataFrame:
    return report.cpu_overload(report.newest(V.tel(spark, sf), 100))


def dash_cpu_overload_newest_1000(spark: SparkSession, sf: str) -> DataFrame:
    return report.cpu_overload(report.newest(V.tel(spark, sf), 1000))


def _monotone(rows: DataFrame) -> DataFrame:
    rising, falling = (report.memory_monotone(rows, way).withColumn("direction", F.lit(way)) for way in ("rising", "falling"))
    return rising.unionByName(falling)


def dash_memory_monotone(spark: SparkSession, sf: str) -> DataFrame:
    return _monotone(V.tel(spark, sf))


def dash_memory_monotone_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Absent values read as 0."""
    return _monotone(V.tel_gap(spark, sf))


def raw_table_preview(spark: SparkSession, sf: str) -> DataFrame:
    return report.newest(V.tel(spark, sf), 20).select("event_id", "ts", "agent_id", *ALL_METRICS)


def raw_json_preview(spark: SparkSession, sf: str) -> DataFrame:
    rows = report.newest(V.tel(spark, sf), 10)
    return rows.select("event_id", F.to_json(F.struct("agent_id", "event_type", "v")).alias("json"))


def anomalies_flagged(spark: SparkSession, sf: str) -> DataFrame:
    rows = report.flagged(V.tel(spark, sf)).where("is_anomaly")
    return rows.select("event_id", "ts", "agent_id", "severity")


def anomalies_by_severity_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = report.flagged(V.tel(spark, sf)).where(F.col("is_anomaly") & F.col("severity").isin("critical", "high"))
    return report.newest(rows, 20).select("event_id", "ts", "agent_id", "severity")


def detection_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = report.detection_counts(report.flagged(V.tel(spark, sf)))
    return counts.withColumn("detection_rate", F.round("detection_rate", 6))


def mean_bands(spark: SparkSession, sf: str) -> DataFrame:
    return report.mean_bands(V.tel_gap(spark, sf)).withColumn("mean", F.round("mean", 6))


def usage_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = report.usage_summary(V.tel(spark, sf))
    return rows.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75")})


def box_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = report.box_stats(V.tel(spark, sf))
    return rows.withColumns({c: F.round(c, 6) for c in ("q25", "q50", "q75", "lower_fence", "upper_fence")})


def data_overview(spark: SparkSession, sf: str) -> DataFrame:
    return report.data_overview(report.flagged(V.tel(spark, sf)))


def distinct_agents(spark: SparkSession, sf: str) -> DataFrame:
    return V.tel(spark, sf).select("agent_id").distinct()


def distinct_agents_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Agents seen in the seven days up to each day, merged from stored sketches, next to the exact count."""
    sketches = written(report.distinct_sketches(V.tel(spark, sf), "agent_id"), "sketches")
    seen = V.tel(spark, sf).select("agent_id", F.to_date("ts").alias("day")).distinct()
    days = F.explode(F.sequence("day", F.date_add("day", 6))).alias("day")
    exact = seen.select("agent_id", days).groupBy("day").agg(F.countDistinct("agent_id").alias("exact"))
    near = F.abs(F.col("n") - F.col("exact")) <= 0.03 * F.col("exact")
    return report.distinct_in_spans(sketches, 7).join(exact, "day").select("day", "exact", near.alias("within_3_percent"))


def severity_timeline(spark: SparkSession, sf: str) -> DataFrame:
    rows = report.severity_timeline(_anomalies(spark, sf).select(
        (F.col("event_id") * 4 + F.length("type") % 4).alias("event_id"), "ts", "agent_id", "severity"))
    return rows.select("event_id", "agent_id", "severity", "occurrence", "level")


def metric_series(spark: SparkSession, sf: str) -> DataFrame:
    rows = report.series(V.tel_gap(spark, sf), USAGE)
    flag = report.anomaly_flag().cast("int").alias("anomaly")
    return rows.select("event_id", "agent_id", "position", *USAGE, flag)


def column_labels(spark: SparkSession, sf: str) -> DataFrame:
    long = V.tel(spark, sf).unpivot(["event_id"], USAGE, "metric", "value")
    return long.groupBy(label("metric").alias("label")).agg(F.max("value").alias("peak"))


def agent_compare(spark: SparkSession, sf: str) -> DataFrame:
    chosen = V.agents(spark, sf).where(F.col("agent_id").isin(SELECTED)).select("agent_id")
    rows = V.tel(spark, sf).join(chosen, "agent_id", "left_semi")
    return report.series(rows, ["cpu_usage", "memory_usage"]).select(
        "event_id", "agent_id", "position", "cpu_usage", "memory_usage")


def agent_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.agents(spark, sf).join(V.tel(spark, sf), "agent_id")
    return rows.select("event_id", "agent_id", "hostname", "platform", *USAGE)


# Alerts -------------------------------------------------------------------------------------

def alerts_by_severity(spark: SparkSession, sf: str) -> DataFrame:
    return report.count_by(_anomalies(spark, sf), "severity")


def alert_status_share(spark: SparkSession, sf: str) -> DataFrame:
    return report.share_by(_episodes(spark, sf), "status")


def alert_counts(spark: SparkSession, sf: str) -> DataFrame:
    return report.alert_counts(_episodes(spark, sf))


def alert_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return _episodes(spark, sf)


def alerts_active(spark: SparkSession, sf: str) -> DataFrame:
    return L.active(_episodes(spark, sf)).drop("resolved_at")


def alert_history(spark: SparkSession, sf: str) -> DataFrame:
    return L.history(_episodes(spark, sf), 100)


def alerts_resolved_purge(spark: SparkSession, sf: str) -> DataFrame:
    kept = L.purge(_episodes(spark, sf), last_ts(V.tel(spark, sf)), 24)
    return kept.select("alert_id", "episode", "status", "resolved_at")


def alerts_newest(spark: SparkSession, sf: str) -> DataFrame:
    return report.alert_listing(L.alert_table(_episodes(spark, sf)), status="active", severity="high", limit=100)


def alert_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return report.alert_detail(L.alert_table(_episodes(spark, sf)), "disk_threshold_breach_8_0")


def alerts_apply_resolutions(spark: SparkSession, sf: str) -> DataFrame:
    alerts = L.alert_table(_episodes(spark, sf))
    requests = V.conn_events(spark, sf).where(F.col("kind") == "connect").select(
        F.concat(F.lit("memory_threshold_breach_"), F.col("agent_id").cast("string"), F.lit("_0")).alias("alert_id"), "ts")
    return L.apply_resolutions(alerts, requests).select("alert_id", "agent_id", "status", "last_seen")


def sustained_breach(spark: SparkSession, sf: str) -> DataFrame:
    return L.sustained_breaches(V.tel_gap(spark, sf))


def rule_matches(spark: SparkSession, sf: str) -> DataFrame:
    return L.rule_matches(V.tel_gap(spark, sf)).select("event_id", "agent_id", "rule", "metric", "value", "severity")


def rule_matches_many(spark: SparkSession, sf: str) -> DataFrame:
    """A caller's rules, one per order: as many as there are orders, on three metrics."""
    rows = L.rules_crossed(V.tel_gap(spark, sf), V.order_rules(spark, sf), ["cpu_usage", "memory_usage", "disk_usage"])
    return rows.select("event_id", "agent_id", "metric", "value", "n_rules", "threshold", "rule")


def notifications_outbox(spark: SparkSession, sf: str) -> DataFrame:
    return L.notifications(_anomalies(spark, sf), V.resolve_events(spark, sf))


# Agents -------------------------------------------------------------------------------------

def agents_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The registry built in two steps: an older snapshot, then the later connects merged in."""
    events, hosts = V.conn_events(spark, sf), V.agents(spark, sf)
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    older = A.agent_snapshot(events.where(F.col("ts") < cut), hosts)
    return A.agent_snapshot(events.where(F.col("ts") >= cut), hosts, older)


def agents_listing(spark: SparkSession, sf: str) -> DataFrame:
    return A.agent_listing(A.agent_snapshot(V.conn_events(spark, sf)))


def agents_connected(spark: SparkSession, sf: str) -> DataFrame:
    return A.connected(V.conn_events(spark, sf))


def agents_liveness(spark: SparkSession, sf: str) -> DataFrame:
    return A.liveness(V.tel(spark, sf), last_ts(V.tel(spark, sf)), MISSED)


def agent_status_share(spark: SparkSession, sf: str) -> DataFrame:
    return report.share_by(agents_liveness(spark, sf), "status")


def fleet_status(spark: SparkSession, sf: str) -> DataFrame:
    agents, online = agents_liveness(spark, sf), A.connected(V.conn_events(spark, sf))
    dashboards = A.connected(V.dashboard_events(spark, sf))
    checks = health.health_check(health.latest_per_agent(V.tel(spark, sf)))
    row = A.fleet_status(agents, online, dashboards, _anomalies(spark, sf), checks, last_ts(V.tel(spark, sf)))
    return row.withColumn("healthy_share", F.round("healthy_share", 6))


def commands_deliverable(spark: SparkSession, sf: str) -> DataFrame:
    return A.deliverable(V.commands(spark, sf), A.connected(V.conn_events(spark, sf)))


def commands_undeliverable(spark: SparkSession, sf: str) -> DataFrame:
    return A.undeliverable(V.commands(spark, sf), A.connected(V.conn_events(spark, sf)))


def command_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.commands(spark, sf).withColumn("issue_type", F.nullif("issue_type", F.lit("general")))
    return A.command_envelopes(rows)


def script_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return A.script_lookup(V.commands(spark, sf), V.agents(spark, sf))


def script_missing(spark: SparkSession, sf: str) -> DataFrame:
    return A.script_missing(V.commands(spark, sf), V.agents(spark, sf))


_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY ts DESC, event_id DESC) AS rn FROM {t}) WHERE rn = 1)"
_LATEST_TEL, _LATEST_GAP = _LATEST.format(t="tel"), _LATEST.format(t="tel_gap")
_ISO = "regexp_replace(strftime({0}, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '')"
_ORDINAL = "CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END"
_FLAGGED = """
flagged AS (SELECT *, cpu_usage > 80 OR memory_usage > 85 OR disk_usage > 90 OR network_latency > 200 AS is_anomaly,
  CASE WHEN cpu_usage > 95 OR memory_usage > 95 OR disk_usage > 98 THEN 'critical'
       WHEN cpu_usage > 80 OR memory_usage > 85 OR disk_usage > 90 THEN 'high'
       WHEN network_latency > 200 THEN 'medium' ELSE 'normal' END AS severity FROM tel)"""
_LIVE = f"""
live AS (SELECT agent_id, max(ts) AS last_seen,
  CASE WHEN max(ts) < (SELECT max(ts) FROM tel) - INTERVAL {MISSED * C.SNAPSHOT_INTERVAL_S} SECOND THEN 'offline' ELSE 'healthy' END AS status
  FROM tel GROUP BY agent_id)"""
_ONLINE = "online AS (SELECT agent_id, max(ts) AS since FROM conn_events GROUP BY agent_id HAVING arg_max(kind, (ts, event_id)) = 'connect')"
_EPISODES = """
stream AS (
  SELECT event_id, ts, agent_id, type, severity, description, suggested_action, 0 AS res FROM anomaly_events
  UNION ALL SELECT event_id, ts, agent_id, type, NULL, NULL, NULL, 1 FROM resolve_events),
numbered AS (SELECT *, CAST(sum(res) OVER (PARTITION BY type, agent_id ORDER BY ts, res, event_id ROWS UNBOUNDED PRECEDING) - res AS BIGINT) AS episode FROM stream),
episodes AS (
  SELECT concat(type, '_', CAST(agent_id AS VARCHAR)) AS alert_id, type, agent_id, episode,
         arg_min(severity, (ts, event_id)) FILTER (res = 0) AS severity,
         arg_min(description, (ts, event_id)) FILTER (res = 0) AS description,
         arg_min(suggested_action, (ts, event_id)) FILTER (res = 0) AS suggested_action,
         min(ts) FILTER (res = 0) AS first_seen, max(ts) FILTER (res = 0) AS last_seen,
         count(*) FILTER (res = 0) AS count,
         CASE WHEN min(ts) FILTER (res = 1) IS NULL THEN 'active' ELSE 'resolved' END AS status,
         min(ts) FILTER (res = 1) AS resolved_at
  FROM numbered GROUP BY type, agent_id, episode HAVING count(*) FILTER (res = 0) > 0),
alerts AS (SELECT concat(alert_id, '_', CAST(episode AS VARCHAR)) AS alert_id, agent_id, type AS alert_type, severity, description, status, first_seen, last_seen FROM episodes)"""
_SCRIPTS = """
keys AS (SELECT 'cpu_threshold_breach' AS issue_type, 'kill_high_cpu_process' AS script_key UNION ALL SELECT 'memory_threshold_breach', 'clear_cache'
  UNION ALL SELECT 'disk_threshold_breach', 'cleanup_disk_space' UNION ALL SELECT 'network_latency_high', 'network_reset'),
paths AS (SELECT k AS script_key, o AS os, concat('scripts/', o, '/', f, CASE o WHEN 'linux' THEN '.sh' ELSE '.bat' END) AS script_path
  FROM (SELECT 'kill_high_cpu_process' AS k, 'kill_high_cpu' AS f UNION ALL SELECT 'cleanup_disk_space', 'disk_cleanup'
        UNION ALL SELECT 'restart_services', 'restart_services' UNION ALL SELECT 'clear_cache', 'clear_cache' UNION ALL SELECT 'network_reset', 'network_reset') s,
       (SELECT 'linux' AS o UNION ALL SELECT 'windows') t),
found AS (SELECT c.event_id, c.agent_id, c.issue_type, k.script_key, lower(a.platform) AS os, p.script_path FROM commands c LEFT JOIN agents a ON c.agent_id = a.agent_id
  LEFT JOIN keys k ON c.issue_type = k.issue_type LEFT JOIN paths p ON k.script_key = p.script_key AND lower(a.platform) = p.os)"""


def _bands_sql() -> str:
    parts = [
        f"""SELECT agent_id, '{m}' AS metric, {m} AS value, CASE WHEN {m} >= {c} THEN 'critical' WHEN {m} >= {w} THEN 'warning' ELSE 'healthy' END AS band,
       round({m} - {w}, 6) AS over_warning FROM latest{' WHERE network_latency <> 0' if m == 'network_latency' else ''}"""
        for m, w, c in C.GAUGE_LIMITS
    ]
    return sql(f"WITH {_LATEST_TEL}\n" + "\nUNION ALL\n".join(parts), "tel")


def _summary_sql(columns: str) -> str:
    parts = [
        f"""SELECT '{m}' AS metric, count({m}) AS n, avg({m}) AS mean, stddev_samp({m}) AS std, min({m}) AS low, max({m}) AS high,
       quantile_cont({m}, 0.25) AS q25, quantile_cont({m}, 0.5) AS q50, quantile_cont({m}, 0.75) AS q75 FROM tel""" for m in USAGE
    ]
    return sql("WITH s AS (" + "\nUNION ALL\n".join(parts) + f")\nSELECT {columns} FROM s", "tel")


_ADVICE_SQL = "\nUNION ALL\n".join(
    f"SELECT agent_id, '{cat}' AS category, '{prio}' AS priority, '{text}' AS recommendation FROM latest WHERE {m} > {above}"
    for m, above, cat, prio, text in C.RECOMMENDATIONS
)
_ISSUES_SQL = "\nUNION ALL\n".join(
    f"""SELECT agent_id, ts, CASE WHEN {m} > {c} THEN 'critical' ELSE 'warning' END AS level, '{name}' AS component,
       CASE WHEN {m} > {c} THEN '{issue}' ELSE '{mild}' END AS issue, {m} AS value, CASE WHEN {m} > {c} THEN '{impact}' END AS impact
FROM latest WHERE {m} > {w}"""
    for name, m, c, _, w, _, issue, impact, mild in C.HEALTH_CHECKS
)

QUERIES = {
    "health_check": (health_check, sql(f"""
WITH {_LATEST_GAP},
silent AS (SELECT agent_id FROM agents UNION ALL SELECT agent_id + 1000000 FROM agents),
h AS (SELECT agent_id,
  100 - (CASE WHEN cpu_usage > 95 THEN 30 WHEN cpu_usage > 80 THEN 10 ELSE 0 END) - (CASE WHEN memory_usage > 95 THEN 25 WHEN memory_usage > 85 THEN 10 ELSE 0 END)
      - (CASE WHEN disk_usage > 98 THEN 35 WHEN disk_usage > 90 THEN 15 ELSE 0 END) AS overall_score,
  (CASE WHEN cpu_usage > 95 THEN 1 ELSE 0 END) + (CASE WHEN memory_usage > 95 THEN 1 ELSE 0 END) + (CASE WHEN disk_usage > 98 THEN 1 ELSE 0 END) AS critical_issues,
  (CASE WHEN cpu_usage > 80 AND cpu_usage <= 95 THEN 1 ELSE 0 END) + (CASE WHEN memory_usage > 85 AND memory_usage <= 95 THEN 1 ELSE 0 END)
      + (CASE WHEN disk_usage > 90 AND disk_usage <= 98 THEN 1 ELSE 0 END) AS warnings,
  CASE WHEN cpu_usage IS NOT NULL THEN greatest(CAST(0 AS DOUBLE), 100 - cpu_usage) END AS cpu_score,
  CASE WHEN memory_usage IS NOT NULL THEN greatest(CAST(0 AS DOUBLE), 100 - memory_usage) END AS memory_score,
  CASE WHEN disk_usage IS NOT NULL THEN greatest(CAST(0 AS DOUBLE), 100 - disk_usage) END AS disk_score FROM latest)
SELECT s.agent_id, CASE WHEN overall_score IS NULL THEN 'insufficient_data' WHEN critical_issues > 0 THEN 'critical' WHEN warnings > 0 THEN 'warning' ELSE 'healthy' END AS status,
       overall_score, coalesce(critical_issues, 0) AS critical_issues, warnings, cpu_score, memory_score, disk_score
FROM silent s LEFT JOIN h ON s.agent_id = h.agent_id""", "tel_gap", "agents")),
    "health_issues": (health_issues, sql(f"WITH {_LATEST_GAP}\n{_ISSUES_SQL}", "tel_gap")),
    "fleet_health_score": (fleet_health_score, sql(f"""
WITH {_FLAGGED.strip()},
{_LIVE.strip()},
x AS (SELECT (SELECT count(*) FROM live) AS agents, (SELECT count(*) FROM live WHERE status = 'healthy') AS healthy_agents,
      (SELECT count(*) FROM flagged) AS metrics, (SELECT count(*) FROM flagged WHERE is_anomaly) AS anomalies),
y AS (SELECT *, (healthy_agents / CAST(agents AS DOUBLE) * 0.6 + (1 - anomalies / CAST(metrics AS DOUBLE)) * 0.4) * 100 AS score FROM x)
SELECT agents, healthy_agents, metrics, anomalies, round(score, 6) AS health_score,
       CASE WHEN score >= 80 THEN 'Excellent' WHEN score >= 60 THEN 'Good' ELSE 'Needs Attention' END AS rating FROM y""", "tel")),
    "gauge_bands": (gauge_bands, _bands_sql()),
    "recommendations": (recommendations, sql(f"WITH {_LATEST_TEL}\n{_ADVICE_SQL}", "tel")),
    "metrics_newest": (metrics_newest, sql(f"""
SELECT event_id, agent_id, {_ISO.format('ts')} AS ts,
       CASE WHEN event_id % 7 <> 0 THEN cpu_usage ELSE 0 END AS cpu_usage, CASE WHEN event_id % 5 <> 0 THEN memory_usage ELSE 0 END AS memory_usage,
       disk_usage, network_latency, cpu_usage > 80 AS is_anomaly, CAST(0 AS DOUBLE) AS anomaly_score,
       CASE WHEN cpu_usage > 95 THEN 'critical' WHEN cpu_usage > 80 THEN 'high' ELSE 'normal' END AS severity
FROM (SELECT * FROM tel ORDER BY ts DESC, event_id DESC LIMIT 100)""", "tel")),
    "metrics_of_agent": (metrics_of_agent, sql(f"""
SELECT event_id, ts, agent_id, cpu_usage, memory_usage, disk_usage, network_latency FROM tel
WHERE agent_id = {SELECTED[0]} ORDER BY ts DESC, event_id DESC LIMIT 50""", "tel")),
    "metrics_latest_per_agent": (metrics_latest_per_agent, sql(
        f"WITH {_LATEST_TEL}\nSELECT event_id, ts, agent_id, cpu_usage, memory_usage, disk_usage, network_latency FROM latest", "tel")),
    "metrics_json_defaults": (metrics_json_defaults, sql("""
SELECT event_id, ts, agent_id, CASE WHEN event_id % 7 <> 0 THEN cpu_usage ELSE 0 END AS cpu_usage,
       CASE WHEN event_id % 5 <> 0 THEN memory_usage ELSE 0 END AS memory_usage, disk_usage, network_latency,
       cpu_usage > 80 AS is_anomaly, CAST(0 AS DOUBLE) AS anomaly_score,
       CASE WHEN cpu_usage > 95 THEN 'critical' WHEN cpu_usage > 80 THEN 'high' ELSE 'normal' END AS severity FROM tel""", "tel")),
    "headline_values": (headline_values, sql("""
SELECT event_id, agent_id, CASE WHEN failed THEN 0 ELSE coalesce(cpu_usage, 0) END AS cpu_usage,
       CASE WHEN failed THEN 0 ELSE coalesce(memory_usage, 0) END AS memory_usage, CASE WHEN failed THEN 0 ELSE disk_usage END AS disk_usage,
       CASE WHEN failed THEN 0 ELSE network_latency END AS network_latency FROM snap""", "snap")),
    "detector_values": (detector_values, sql(
        "SELECT event_id, agent_id, cpu_usage, memory_usage, disk_usage, network_latency FROM snap", "snap")),
    "iso_timestamps": (iso_timestamps, sql(f"""
SELECT event_id, {_ISO.format("date_trunc('second', t)")} AS second, {_ISO.format('t')} AS timestamp
FROM (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN ts END AS t FROM tel)""", "tel")),
    "platform_columns": (platform_columns, sql("""
SELECT event_id, ts, agent_id, CASE agent_id % 3 WHEN 0 THEN 'Linux' WHEN 1 THEN 'Windows' ELSE 'Darwin' END AS system,
       concat('host-', CAST(agent_id AS VARCHAR)) AS node, concat('6.', CAST(agent_id % 7 AS VARCHAR)) AS release, 'x86_64' AS machine FROM tel""", "tel")),
    "limit_then_group": (limit_then_group, sql("""
SELECT agent_id, count(*) AS n, round(avg(cpu_usage), 6) AS cpu_mean FROM (SELECT * FROM tel ORDER BY ts DESC, event_id DESC LIMIT 100) GROUP BY agent_id""", "tel")),
    "anomalies_flagged": (anomalies_flagged, sql(
        f"WITH {_FLAGGED.strip()}\nSELECT event_id, ts, agent_id, severity FROM flagged WHERE is_anomaly", "tel")),
    "anomalies_by_severity_filter": (anomalies_by_severity_filter, sql(f"""
WITH {_FLAGGED.strip()}
SELECT event_id, ts, agent_id, severity FROM flagged WHERE is_anomaly AND severity IN ('critical', 'high') ORDER BY ts DESC, event_id DESC LIMIT 20""", "tel")),
    "detection_counts": (detection_counts, sql(f"""
WITH {_FLAGGED.strip()}
SELECT count(*) AS scanned, count_if(is_anomaly) AS found, count_if(is_anomaly AND severity = 'critical') AS critical,
       round(count_if(is_anomaly) / CAST(count(*) AS DOUBLE) * 100, 6) AS detection_rate FROM flagged""", "tel")),
    "mean_bands": (mean_bands, sql("\nUNION ALL\n".join(
        f"SELECT '{m}' AS metric, round(avg(coalesce({m}, 0)), 6) AS mean, CASE WHEN avg(coalesce({m}, 0)) > {limit} THEN 'Above normal' ELSE 'Normal range' END AS band FROM tel_gap"
        for m, limit in C.NORMAL_LIMITS.items()), "tel_gap")),
    "usage_summary": (usage_summary, _summary_sql(
        "metric, n, round(mean, 6) AS mean, round(std, 6) AS std, low, high, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75")),
    "box_stats": (box_stats, _summary_sql(
        "metric, low, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, high, "
        "round(q25 - (q75 - q25) * 1.5, 6) AS lower_fence, round(q75 + (q75 - q25) * 1.5, 6) AS upper_fence")),
    "data_overview": (data_overview, sql(f"""
WITH {_FLAGGED.strip()}
SELECT count(*) AS points, count(DISTINCT agent_id) AS agents, count_if(is_anomaly) AS anomalies,
       (epoch_us(max(ts)) - epoch_us(min(ts))) / CAST(1000000 AS DOUBLE) AS span_seconds, concat(CAST(count(*) AS VARCHAR), ' points') AS time_span FROM flagged""", "tel")),
    "distinct_agents": (distinct_agents, sql("SELECT DISTINCT agent_id FROM tel", "tel")),
    "distinct_agents_sketch": (distinct_agents_sketch, sql("""
WITH seen AS (SELECT DISTINCT agent_id, CAST(ts AS DATE) AS day FROM tel),
spread AS (SELECT agent_id, CAST(day + to_days(CAST(d AS INT)) AS DATE) AS day FROM seen, (SELECT unnest(range(0, 7)) AS d) r)
SELECT day, count(DISTINCT agent_id) AS exact, true AS within_3_percent FROM spread WHERE day <= (SELECT max(day) FROM seen) GROUP BY day""", "tel")),
    "severity_timeline": (severity_timeline, sql(f"""
SELECT event_id, agent_id, severity, row_number() OVER (PARTITION BY severity ORDER BY ts, event_id) - 1 AS occurrence, {_ORDINAL} AS level
FROM (SELECT event_id * 4 + length(type) % 4 AS event_id, ts, agent_id, severity FROM anomaly_events)""", "anomaly_events")),
    "metric_series": (metric_series, sql("""
SELECT event_id, agent_id, row_number() OVER (PARTITION BY agent_id ORDER BY ts, event_id) - 1 AS position,
       coalesce(cpu_usage, 0) AS cpu_usage, coalesce(memory_usage, 0) AS memory_usage, disk_usage,
       CAST(coalesce(cpu_usage, 0) > 80 OR coalesce(memory_usage, 0) > 85 OR disk_usage > 90 OR network_latency > 200 AS INT) AS anomaly
FROM tel_gap""", "tel_gap")),
    "column_labels": (column_labels, sql("""
SELECT 'Cpu Usage' AS label, max(cpu_usage) AS peak FROM tel UNION ALL SELECT 'Memory Usage', max(memory_usage) FROM tel
UNION ALL SELECT 'Disk Usage', max(disk_usage) FROM tel""", "tel")),
    "agent_compare": (agent_compare, sql(f"""
SELECT event_id, agent_id, row_number() OVER (PARTITION BY agent_id ORDER BY ts, event_id) - 1 AS position, cpu_usage, memory_usage
FROM tel WHERE agent_id IN ({SELECTED[0]}, {SELECTED[1]})""", "tel")),
    "agent_metrics": (agent_metrics, sql("""
SELECT t.event_id, t.agent_id, a.hostname, a.platform, t.cpu_usage, t.memory_usage, t.disk_usage FROM agents a JOIN tel t ON a.agent_id = t.agent_id""", "agents")),
    "alerts_by_severity": (alerts_by_severity, sql("SELECT severity, count(*) AS n FROM anomaly_events GROUP BY severity", "anomaly_events")),
    "alert_status_share": (alert_status_share, sql(f"""
WITH {_EPISODES.strip()}
SELECT status, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM episodes) AS DOUBLE) * 100, 6) AS share FROM episodes GROUP BY status""", "anomaly_events", "resolve_events")),
    "alert_counts": (alert_counts, sql(f"""
WITH {_EPISODES.strip()}
SELECT count(*) AS total, count_if(status = 'active') AS active, count_if(status = 'resolved') AS resolved, count_if(severity = 'critical') AS critical,
       CASE WHEN bool_or(severity = 'critical' AND status = 'active') THEN 'Critical' ELSE 'Normal' END AS level FROM episodes""", "anomaly_events", "resolve_events")),
    "alert_episodes": (alert_episodes, sql(f"WITH {_EPISODES.strip()}\nSELECT * FROM episodes", "anomaly_events", "resolve_events")),
    "alerts_active": (alerts_active, sql(
        f"WITH {_EPISODES.strip()}\nSELECT * EXCLUDE (resolved_at) FROM episodes WHERE status = 'active'", "anomaly_events", "resolve_events")),
    "alert_history": (alert_history, sql(f"""
WITH {_EPISODES.strip()}
SELECT alert_id, type, agent_id, episode, severity, description, first_seen FROM episodes ORDER BY first_seen DESC, alert_id LIMIT 100""", "anomaly_events", "resolve_events")),
    "alerts_resolved_purge": (alerts_resolved_purge, sql(f"""
WITH {_EPISODES.strip()}
SELECT alert_id, episode, status, resolved_at FROM episodes
WHERE NOT coalesce(status = 'resolved' AND resolved_at < (SELECT max(ts) FROM tel) - INTERVAL 24 HOUR, false)""", "anomaly_events", "resolve_events")),
    "alerts_newest": (alerts_newest, sql(f"""
WITH {_EPISODES.strip()}
SELECT alert_id, agent_id, alert_type AS title, description, severity, status, alert_type, {_ISO.format('first_seen')} AS timestamp, {_ISO.format('last_seen')} AS resolved_at
FROM alerts WHERE status = 'active' AND severity = 'high' ORDER BY first_seen DESC, alert_id LIMIT 100""", "anomaly_events", "resolve_events")),
    "alert_by_id": (alert_by_id, sql(f"""
WITH {_EPISODES.strip()}
SELECT alert_id, agent_id, alert_type AS title, description, severity, status, {_ISO.format('first_seen')} AS timestamp
FROM alerts WHERE alert_id = 'disk_threshold_breach_8_0'""", "anomaly_events", "resolve_events")),
    "alerts_apply_resolutions": (alerts_apply_resolutions, sql(f"""
WITH {_EPISODES.strip()},
req AS (SELECT concat('memory_threshold_breach_', CAST(agent_id AS VARCHAR), '_0') AS alert_id, max(ts) AS at FROM conn_events WHERE kind = 'connect' GROUP BY agent_id)
SELECT a.alert_id, a.agent_id, CASE WHEN r.at IS NOT NULL THEN 'resolved' ELSE a.status END AS status, coalesce(r.at, a.last_seen) AS last_seen
FROM alerts a LEFT JOIN req r ON a.alert_id = r.alert_id""", "anomaly_events", "resolve_events", "conn_events")),
    "sustained_breach": (sustained_breach, sql("""
WITH long AS (
  SELECT t.event_id, t.ts, t.agent_id, r.rule, r.metric, r.severity, r.duration_s,
         coalesce(CASE r.metric WHEN 'cpu_usage' THEN t.cpu_usage WHEN 'memory_usage' THEN t.memory_usage ELSE t.disk_usage END > r.threshold, false) AS hit
  FROM tel_gap t, rules r),
marked AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY agent_id, rule ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM long)
SELECT agent_id, rule, metric, severity, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS samples FROM marked WHERE hit
GROUP BY agent_id, rule, metric, severity, duration_s, island HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= duration_s * 1000000""", "tel_gap", "rules")),
    "rule_matches": (rule_matches, sql("""
WITH long AS (SELECT event_id, agent_id, 'cpu_usage' AS metric, cpu_usage AS value FROM tel_gap UNION ALL SELECT event_id, agent_id, 'memory_usage', memory_usage FROM tel_gap
  UNION ALL SELECT event_id, agent_id, 'disk_usage', disk_usage FROM tel_gap)
SELECT event_id, agent_id, rule, l.metric AS metric, value, severity FROM long l JOIN rules r ON l.metric = r.metric AND l.value > r.threshold""", "tel_gap", "rules")),
    "rule_matches_many": (rule_matches_many, sql("""
WITH long AS (SELECT event_id, agent_id, 'cpu_usage' AS metric, cpu_usage AS value FROM tel_gap UNION ALL SELECT event_id, agent_id, 'memory_usage', memory_usage FROM tel_gap
  UNION ALL SELECT event_id, agent_id, 'disk_usage', disk_usage FROM tel_gap),
found AS (SELECT v.metric, value, count(*) AS n_rules, max(threshold) AS threshold, arg_max(rule, (threshold, rule)) AS rule
  FROM (SELECT DISTINCT metric, value FROM long) v JOIN order_rules r ON v.metric = r.metric AND v.value > r.threshold GROUP BY v.metric, value)
SELECT event_id, agent_id, l.metric AS metric, l.value AS value, n_rules, threshold, rule FROM long l JOIN found f ON l.metric = f.metric AND l.value = f.value""", "tel_gap", "order_rules")),
    "notifications_outbox": (notifications_outbox, sql(f"""
WITH {_EPISODES.strip()}
SELECT n.event_id, n.ts, e.alert_id, n.agent_id, e.description, channel
FROM numbered n JOIN episodes e ON n.type = e.type AND n.agent_id = e.agent_id AND n.episode = e.episode,
     (SELECT 'webhook' AS channel UNION ALL SELECT 'email' UNION ALL SELECT 'slack') c
WHERE n.res = 0 AND n.severity = 'critical'""", "anomaly_events", "resolve_events")),
    "raw_table_preview": (raw_table_preview, sql("""
SELECT event_id, ts, agent_id, cpu_usage, memory_usage, disk_usage, network_latency FROM tel ORDER BY ts DESC, event_id DESC LIMIT 20""", "tel")),
    "raw_json_preview": (raw_json_preview, sql("""
SELECT event_id, concat('{"agent_id":', CAST(agent_id AS VARCHAR), ',"event_type":"', event_type, '","v":', CAST(v AS VARCHAR), '}') AS json
FROM tel ORDER BY ts DESC, event_id DESC LIMIT 10""", "tel")),
    "agents_snapshot": (agents_snapshot, sql("""
SELECT c.agent_id, hostname, platform, 'healthy' AS status, min(ts) AS first_connected, max(ts) AS last_seen
FROM conn_events c JOIN agents a ON c.agent_id = a.agent_id WHERE kind = 'connect' GROUP BY c.agent_id, hostname, platform""", "conn_events", "agents")),
    "agents_listing": (agents_listing, sql(f"""
SELECT agent_id, CAST(agent_id AS VARCHAR) AS hostname, 'Unknown' AS platform, 'healthy' AS status, {_ISO.format('max(ts)')} AS last_seen
FROM conn_events WHERE kind = 'connect' GROUP BY agent_id""", "conn_events")),
    "agents_connected": (agents_connected, sql(f"WITH {_ONLINE}\nSELECT * FROM online", "conn_events")),
    "agents_liveness": (agents_liveness, sql(f"WITH {_LIVE.strip()}\nSELECT agent_id, last_seen, status FROM live", "tel")),
    "agent_status_share": (agent_status_share, sql(f"""
WITH {_LIVE.strip()}
SELECT status, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM live) AS DOUBLE) * 100, 6) AS share FROM live GROUP BY status""", "tel")),
    "fleet_status": (fleet_status, sql(f"""
WITH {_LIVE.strip()},
{_ONLINE},
{_LATEST_TEL},
dash AS (SELECT agent_id FROM dashboard_events GROUP BY agent_id HAVING arg_max(kind, (ts, event_id)) = 'connect')
SELECT count(*) AS agents, count_if(status = 'healthy') AS healthy_agents, round(count_if(status = 'healthy') / CAST(count(*) AS DOUBLE) * 100, 6) AS healthy_share,
       (SELECT count(*) FROM online) AS connected_agents, (SELECT count(*) FROM dash) AS active_dashboards,
       (SELECT count(*) FROM anomaly_events WHERE ts > (SELECT max(ts) FROM tel) - INTERVAL 24 HOUR) AS anomalies_24h,
       (SELECT CASE WHEN bool_or(cpu_usage > 95 OR memory_usage > 95 OR disk_usage > 98) THEN 'critical'
                    WHEN bool_or(cpu_usage > 80 OR memory_usage > 85 OR disk_usage > 90) THEN 'warning' ELSE 'healthy' END FROM latest) AS system_health
FROM live""", "conn_events", "dashboard_events", "anomaly_events")),
    "commands_deliverable": (commands_deliverable, sql(
        f"WITH {_ONLINE}\nSELECT event_id, ts, agent_id, issue_type FROM commands WHERE agent_id IN (SELECT agent_id FROM online)", "conn_events", "commands")),
    "commands_undeliverable": (commands_undeliverable, sql(
        f"WITH {_ONLINE}\nSELECT event_id, ts, agent_id, issue_type FROM commands WHERE agent_id NOT IN (SELECT agent_id FROM online)", "conn_events", "commands")),
    "command_envelopes": (command_envelopes, sql(f"""
SELECT event_id, agent_id, CASE issue_type WHEN 'general' THEN concat('{{"type":"restart","timestamp":"', {_ISO.format('ts')}, '"}}')
       ELSE concat('{{"type":"remediate","issue_type":"', issue_type, '","timestamp":"', {_ISO.format('ts')}, '"}}') END AS message FROM commands""", "commands")),
    "script_lookup": (script_lookup, sql(f"WITH {_SCRIPTS.strip()}\nSELECT event_id, agent_id, issue_type, script_key, os, script_path FROM found WHERE script_path IS NOT NULL", "commands", "agents")),
    "script_missing": (script_missing, sql(f"WITH {_SCRIPTS.strip()}\nSELECT event_id, agent_id, issue_type, os FROM found WHERE script_path IS NULL", "commands", "agents")),
}

_FIVE = """
r AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY ts DESC, event_id DESC) AS rn FROM {t}),
p AS (SELECT agent_id, max(CASE WHEN rn = 1 THEN cpu_usage END) AS newest, max(CASE WHEN rn = 5 THEN cpu_usage END) AS oldest, count(*) AS n FROM r WHERE rn <= 5 GROUP BY agent_id)
SELECT agent_id, 'CPU Overload' AS type, 'High' AS probability, '2-4 hours' AS time_estimate,
       'Consider scaling up CPU resources or optimizing running processes' AS recommendation, newest, oldest
FROM p WHERE n >= 5 AND newest > oldest + 20"""
QUERIES["dash_cpu_overload"] = (dash_cpu_overload, sql("WITH " + _FIVE.format(t="tel").strip(), "tel"))
for _limit, _query in ((100, dash_cpu_overload_newest_100), (1000, dash_cpu_overload_newest_1000)):
    QUERIES[_query.__name__] = (_query, sql(
        f"WITH recent AS (SELECT * FROM tel ORDER BY ts DESC, event_id DESC LIMIT {_limit}),\n" + _FIVE.format(t="recent").strip(), "tel"))
QUERIES["dash_cpu_overload_gaps"] = (dash_cpu_overload_gaps, sql(
    "WITH zero AS (SELECT * REPLACE (coalesce(cpu_usage, 0) AS cpu_usage) FROM tel_gap),\n" + _FIVE.format(t="zero").strip(), "tel_gap"))

_MONOTONE = """
r AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY ts DESC, event_id DESC) AS rn FROM {t}),
s AS (SELECT *, coalesce(memory_usage, 0) - lag(coalesce(memory_usage, 0)) OVER (PARTITION BY agent_id ORDER BY rn DESC) AS step FROM r WHERE rn <= 5),
d AS (SELECT agent_id, bool_and(coalesce(step, 1) > 0) AS up, bool_and(coalesce(step, -1) < 0) AS down FROM s GROUP BY agent_id HAVING count(*) >= 5)
SELECT agent_id, 'Memory Leak' AS type, 'Medium' AS probability, '6-12 hours' AS time_estimate,
       'Investigate memory-intensive processes and consider restart' AS recommendation, CASE WHEN up THEN 'rising' ELSE 'falling' END AS direction
FROM d WHERE up OR down"""
for _query, _table in ((dash_memory_monotone, "tel"), (dash_memory_monotone_gaps, "tel_gap")):
    QUERIES[_query.__name__] = (_query, sql("WITH " + _MONOTONE.format(t=_table).strip(), _table))

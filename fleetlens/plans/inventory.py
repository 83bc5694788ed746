"""Queries on host inventory, messages and exports, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.units import gib, mib
from fleetlens import constants as C
from fleetlens.operators import detect, flatten, health, inventory, routing
from fleetlens.plans import views as V
from fleetlens.plans.views import sql
from fleetlens.session import shared_dir
from fleetlens.sources.tables import corrupt, decode, export_csv

# The day on which stale files are counted, so that both outcomes occur.
FILES_ASOF = "2000-01-01"


def load_and_uptime(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.load_and_uptime(V.snapshots(spark, sf))


def memory_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return V.processes(spark, sf).select("pid", mib("rss_bytes").alias("memory_mb"), gib("rss_bytes").alias("memory_gb"))


def uptime_seconds(spark: SparkSession, sf: str) -> DataFrame:
    booted = F.lit(1704067200) - F.col("v")
    return V.tel(spark, sf).select("event_id", inventory.uptime(booted).alias("uptime"))


def partition_usage(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.partition_usage(V.partitions(spark, sf)).select(
        "agent_id", "ordinal", "device", "mountpoint", "total_gb", "used_gb", "free_gb", "usage_percent")


def disk_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = inventory.disk_rollup(V.partitions(spark, sf))
    return rows.withColumns({c: F.round(c, 2) for c in ("total_gb", "used_gb", "free_gb")})


def stale_files(spark: SparkSession, sf: str) -> DataFrame:
    asof = F.lit(FILES_ASOF).cast("timestamp_ntz")
    return inventory.stale(V.files(spark, sf), asof).select("file_id", "ctime", "size_bytes")


def stale_files_summary(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.stale_summary(V.files(spark, sf), F.lit(FILES_ASOF).cast("timestamp_ntz"))


def latency_valid_mean(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.mean_latency(V.probes(spark, sf))


def probe_text_latency(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.parse_probes(V.probes(spark, sf)).select("event_id", "host", "latency_ms")


def interface_addresses(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.interface_addresses(V.interfaces(spark, sf), V.addresses(spark, sf))


def interface_address_counts(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.address_counts(V.interfaces(spark, sf), V.addresses(spark, sf))


def script_screen(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.screen_scripts(V.scripts(spark, sf))


def top_processes_cpu(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.top_processes(V.processes(spark, sf), "cpu_percent").select(
        "agent_id", "rank", "pid", "name", "cpu_percent", "memory_mb")


def top_processes_memory(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.top_processes(V.processes(spark, sf), "memory_percent").select(
        "agent_id", "rank", "pid", "name", "cpu_percent", "memory_mb", "memory_percent")


def process_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.processes(spark, sf)
    return inventory.process_candidates(rows, rows.where(F.col("pid") % 50 == 0).select("pid"))


def process_totals(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.process_totals(V.processes(spark, sf))


def connections_established(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.connection_counts(V.connections(spark, sf))


def nested_services(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.service_counts(V.snapshots(spark, sf))


def nested_connectivity(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.connectivity(V.snapshots(spark, sf)).withColumn("latency_ms", F.round("latency_ms", 6))


def nested_device_io(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.device_io(V.snapshots(spark, sf))


def nested_interfaces(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.nested_addresses(V.host_interfaces(spark, sf))


def mounts_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.mounts(V.snapshots(spark, sf))


def log_levels(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.log_levels(V.agent_logs(spark, sf))


def message_routing(spark: SparkSession, sf: str) -> DataFrame:
    routed = V.messages(spark, sf).withColumn("route", routing.message_route("msg_type"))
    return routed.groupBy("route").agg(F.count("*").alias("n"))


def telemetry_branch(spark: SparkSession, sf: str) -> DataFrame:
    rows = routing.route_messages(V.messages(spark, sf))["telemetry"]
    return rows.select("event_id", "ts", "agent_id", "cpu_usage")


def json_decoded(spark: SparkSession, sf: str) -> DataFrame:
    parsed = decode(V.raw_messages(spark, sf), sections=("cpu", "memory", "disk", "network"))
    parsed = parsed.where(~corrupt()).select("event_id", "ts", "agent_id", "doc.*")
    return flatten.detector_values(parsed).select(
        "event_id", "agent_id", "cpu_usage", "memory_usage", "disk_usage", "network_latency")


def json_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    parsed = decode(V.raw_messages(spark, sf), sections=("agent_id",))
    return parsed.where(corrupt()).select("event_id", "ts", "agent_id", "value")


_ANOMALY = "struct<type:string,severity:string,value:double,threshold:double,description:string,suggested_action:string>"


def anomaly_fields(envelopes: DataFrame, agent: str = "bigint") -> DataFrame:
    """One row per anomaly of a message, with all its fields."""
    body = F.from_json("message", f"type string, agent_id {agent}, timestamp string, anomalies array<{_ANOMALY}>").alias("b")
    return envelopes.select("event_id", body).select(
        "event_id", "b.agent_id", "b.type", "b.timestamp", F.explode("b.anomalies").alias("a")
    ).select("event_id", "agent_id", "type", "timestamp", F.col("a.type").alias("kind"), "a.severity", "a.value", "a.threshold", "a.description", "a.suggested_action")


def metric_fields(envelopes: DataFrame, metrics: list[str]) -> DataFrame:
    inner = ",".join(f"{m}:double" for m in metrics)
    body = F.from_json("message", f"type string, agent_id bigint, timestamp string, metrics struct<{inner}>").alias("b")
    return envelopes.select("event_id", body).select("event_id", "b.agent_id", "b.type", "b.timestamp", "b.metrics.*")


def critical_fields(envelopes: DataFrame) -> DataFrame:
    """One row per issue of a message, with all its fields."""
    item = "struct<component:string,issue:string,value:double,impact:string>"
    body = F.from_json("message", f"type string, agent_id bigint, timestamp string, issues array<{item}>").alias("b")
    return envelopes.select(body, "n_issues").select("b.agent_id", "b.type", "b.timestamp", "n_issues", F.explode("b.issues").alias("i")).select(
        "agent_id", "type", "timestamp", "n_issues", "i.*")


def anomaly_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly_fields(routing.anomaly_envelopes(detect.threshold_lists(V.tel(spark, sf))))


def metric_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    metrics = ["cpu_usage", "memory_usage", "disk_usage", "network_latency"]
    return metric_fields(routing.metric_envelopes(V.tel(spark, sf), metrics), metrics)


def critical_feed(spark: SparkSession, sf: str) -> DataFrame:
    issues = health.health_issues(health.latest_per_agent(V.tel(spark, sf)))
    return critical_fields(routing.critical_envelopes(issues))


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "csv")
    rows = V.tel(spark, sf).select("event_id", "agent_id", "cpu_usage", "memory_usage")
    export_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


_ISO = "regexp_replace(strftime({0}, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '')"
ISO_TS = _ISO.format("ts")
_ISSUES = "\n  UNION ALL ".join(
    f"SELECT agent_id, ts, '{name}' AS component, '{issue}' AS issue, {m} AS value, '{impact}' AS impact FROM latest WHERE {m} > {c}"
    for name, m, c, _, _, _, issue, impact, _ in C.HEALTH_CHECKS
)
CRITICAL = sql(f"""
WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY ts DESC, event_id DESC) AS rn FROM tel) WHERE rn = 1),
found AS (
  {_ISSUES})
SELECT agent_id, 'critical_alert' AS type, {ISO_TS} AS timestamp, CAST(count(*) OVER (PARTITION BY agent_id) AS INT) AS n_issues, component, issue, value, impact FROM found""", "tel")
_PARTS = """
parts AS (SELECT *, round(total_bytes / CAST(1073741824 AS DOUBLE), 2) AS total_gb, round(used_bytes / CAST(1073741824 AS DOUBLE), 2) AS used_gb,
  round((total_bytes - used_bytes) / CAST(1073741824 AS DOUBLE), 2) AS free_gb,
  round(used_bytes / CAST(nullif(total_bytes, 0) AS DOUBLE) * 100, 2) AS usage_percent FROM partitions)"""
_PROBED = """
p AS (SELECT *, CASE WHEN contains(output, 'time=') THEN CAST(regexp_extract(output, 'time=([0-9.]+) ?ms', 1) AS DOUBLE) ELSE -1 END AS latency_ms FROM probes)"""


def _top_sql(by: str, extra: str) -> str:
    return sql(f"""
SELECT agent_id, rank, pid, name, cpu_percent, memory_mb{extra} FROM (
  SELECT *, rss_bytes / CAST(1048576 AS DOUBLE) AS memory_mb, row_number() OVER (PARTITION BY agent_id ORDER BY {by} DESC, pid) AS rank FROM processes)
WHERE rank <= 10""", "processes")


QUERIES = {
    "load_and_uptime": (load_and_uptime, sql("""
SELECT event_id, agent_id, CASE WHEN event_id % 6 <> 0 THEN (v % 401) / CAST(100 AS DOUBLE) ELSE 0 END AS load_1m,
       CASE WHEN event_id % 6 <> 0 THEN ((v * 3) % 401) / CAST(100 AS DOUBLE) ELSE 0 END AS load_5m,
       CASE WHEN event_id % 6 <> 0 THEN ((v * 5) % 401) / CAST(100 AS DOUBLE) ELSE 0 END AS load_15m, v + 86400 AS uptime FROM tel""", "tel")),
    "memory_sizes": (memory_sizes, sql("""
SELECT pid, round(rss_bytes / CAST(1048576 AS DOUBLE), 2) AS memory_mb, round(rss_bytes / CAST(1073741824 AS DOUBLE), 2) AS memory_gb FROM processes""", "processes")),
    "uptime_seconds": (uptime_seconds, sql("""
SELECT event_id, CAST(floor(epoch_us(ts) / CAST(1000000 AS DOUBLE) - (1704067200 - v)) AS BIGINT) AS uptime FROM tel""", "tel")),
    "partition_usage": (partition_usage, sql(
        f"WITH {_PARTS.strip()}\nSELECT agent_id, ordinal, device, mountpoint, total_gb, used_gb, free_gb, usage_percent FROM parts", "partitions")),
    "disk_rollup": (disk_rollup, sql(f"""
WITH {_PARTS.strip()}
SELECT agent_id, round(sum(total_gb), 2) AS total_gb, round(sum(used_gb), 2) AS used_gb, round(sum(free_gb), 2) AS free_gb,
       coalesce(arg_min(usage_percent, ordinal), 0) AS usage_percent FROM parts GROUP BY agent_id""", "partitions")),
    "stale_files": (stale_files, sql(
        f"SELECT * FROM files WHERE ctime < TIMESTAMP '{FILES_ASOF} 00:00:00' - INTERVAL 1 DAY", "files")),
    "stale_files_summary": (stale_files_summary, sql(f"""
SELECT count(*) AS files, coalesce(round(CAST(sum(size_bytes) AS DOUBLE) / 1048576, 2), 0) AS size_mb FROM files WHERE ctime < TIMESTAMP '{FILES_ASOF} 00:00:00' - INTERVAL 1 DAY""", "files")),
    "latency_valid_mean": (latency_valid_mean, sql(f"""
WITH {_PROBED.strip()}
SELECT agent_id, coalesce(round(avg(CASE WHEN latency_ms > 0 THEN latency_ms END), 2), 0) AS latency_ms FROM p GROUP BY agent_id""", "probes")),
    "probe_text_latency": (probe_text_latency, sql(f"WITH {_PROBED.strip()}\nSELECT event_id, host, latency_ms FROM p", "probes")),
    "interface_addresses": (interface_addresses, sql(
        "SELECT i.if_id, name, is_up, address FROM interfaces i LEFT JOIN addresses a ON i.if_id = a.if_id", "interfaces", "addresses")),
    "interface_address_counts": (interface_address_counts, sql(
        "SELECT i.if_id, name, is_up, count(address) AS addresses FROM interfaces i LEFT JOIN addresses a ON i.if_id = a.if_id GROUP BY i.if_id, name, is_up",
        "interfaces", "addresses")),
    "script_screen": (script_screen, sql("""
SELECT script_id, CASE WHEN contains(lower(text), 'rm -rf') OR contains(lower(text), 'del /f') OR contains(lower(text), 'format') THEN 'blocked' ELSE 'accepted' END AS decision
FROM scripts""", "scripts")),
    "top_processes_cpu": (top_processes_cpu, _top_sql("cpu_percent", "")),
    "top_processes_memory": (top_processes_memory, _top_sql("memory_percent", ", memory_percent")),
    "process_candidates": (process_candidates, sql(
        "SELECT agent_id, pid, name, cpu_percent FROM processes WHERE cpu_percent > 90 AND pid % 50 <> 0", "processes")),
    "process_totals": (process_totals, sql("SELECT agent_id, count(*) AS total_processes FROM processes GROUP BY agent_id", "processes")),
    "connections_established": (connections_established, sql(
        "SELECT host_id, count(*) AS connections, count_if(status = 'ESTABLISHED') AS established FROM connections GROUP BY host_id", "connections")),
    "nested_services": (nested_services, sql("""
SELECT name, status, count(*) AS n FROM (
  SELECT 'sshd' AS name, CASE v % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'stopped' ELSE 'running' END AS status FROM tel
  UNION ALL SELECT 'cron', CASE v % 3 WHEN 0 THEN 'stopped' ELSE 'running' END FROM tel) GROUP BY name, status""", "tel")),
    "nested_connectivity": (nested_connectivity, sql("""
SELECT host, round(avg(CASE WHEN l > 0 THEN l END), 6) AS latency_ms, count_if(l < 0) AS failed, count(*) AS probes FROM (
  SELECT '8.8.8.8' AS host, CASE WHEN v % 13 = 0 THEN -1 ELSE network_latency END AS l FROM tel
  UNION ALL SELECT 'google.com', ((v * 2) % 20001) / CAST(100 AS DOUBLE) FROM tel) GROUP BY host""", "tel")),
    "nested_device_io": (nested_device_io, sql("""
SELECT agent_id, 'sda' AS device, max(v) AS read_bytes, max(v) * 2 AS write_bytes FROM tel GROUP BY agent_id
UNION ALL SELECT agent_id, 'sdb', max(v) * 3, max(v) * 6 FROM tel GROUP BY agent_id""", "tel")),
    "nested_interfaces": (nested_interfaces, sql("""
SELECT event_id, agent_id, 'lo' AS name, true AS is_up, NULL AS family, NULL AS address FROM tel
UNION ALL SELECT event_id, agent_id, 'eth0', v % 2 = 0, 'AF_INET', concat('10.0.0.', CAST(v % 250 AS VARCHAR)) FROM tel
UNION ALL SELECT event_id, agent_id, 'eth0', true, 'AF_INET6', concat('fe80::', CAST(v % 250 AS VARCHAR)) FROM tel WHERE v % 2 = 0""", "tel")),
    "mounts_distinct": (mounts_distinct, sql("""
SELECT DISTINCT agent_id, 'sda' AS device, '/' AS mountpoint FROM tel UNION ALL SELECT DISTINCT agent_id, 'sdb', '/data' FROM tel""", "tel")),
    "log_levels": (log_levels, sql("SELECT agent_id, level, count(*) AS n FROM agent_logs GROUP BY agent_id, level", "agent_logs")),
    "message_routing": (message_routing, sql("""
SELECT CASE WHEN msg_type IS NULL THEN 'telemetry' WHEN msg_type = 'mystery' THEN 'quarantine' ELSE msg_type END AS route, count(*) AS n FROM messages GROUP BY 1""", "messages")),
    "telemetry_branch": (telemetry_branch, sql("SELECT event_id, ts, agent_id, cpu_usage FROM messages WHERE msg_type IS NULL", "messages")),
    "json_decoded": (json_decoded, sql(
        "SELECT event_id, agent_id, cpu_usage, memory_usage, disk_usage, network_latency FROM snap WHERE event_id % 50 <> 49", "snap")),
    "json_quarantine": (json_quarantine, sql("""
SELECT event_id, ts, agent_id, substr(concat('{"agent_id":"agent-', CAST(agent_id AS VARCHAR), '","platform":{"system":"',
       CASE agent_id % 3 WHEN 0 THEN 'Linux' WHEN 1 THEN 'Windows' ELSE 'Darwin' END, '"'), 1, 40) AS value
FROM tel WHERE event_id % 50 = 49""", "tel")),
    "anomaly_envelopes": (anomaly_envelopes, sql(f"""
SELECT event_id, agent_id, 'anomaly_detected' AS type, {ISO_TS} AS timestamp, type AS kind, severity, value, threshold, description, suggested_action FROM anomaly_events""", "anomaly_events")),
    "metric_envelopes": (metric_envelopes, sql(f"""
SELECT event_id, agent_id, 'metrics_update' AS type, {ISO_TS} AS timestamp, cpu_usage, memory_usage, disk_usage, network_latency FROM tel""", "tel")),
    "critical_feed": (critical_feed, CRITICAL),
    "csv_roundtrip": (csv_roundtrip, sql("SELECT event_id, agent_id, cpu_usage, memory_usage FROM tel", "tel")),
}

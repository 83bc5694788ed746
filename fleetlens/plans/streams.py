"""Queries that run a stream over a stored table to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.operators import detect, flatten, forest, moving_forest
from fleetlens.operators.slices import micros
from fleetlens.plans import detection, inventory
from fleetlens.plans import views as V
from fleetlens.plans.reporting import _EPISODES, MISSED, last_ts
from fleetlens.plans.reporting import QUERIES as REPORTS
from fleetlens.plans.views import sql
from fleetlens.session import shared_dir, written
from fleetlens.sources.tables import constant_table
from fleetlens.streaming import jobs, liveness, state
from fleetlens.streaming.sources import json_stream, table_stream

SYSTEM = [s[0] for s in flatten.SYSTEM_SLOTS]
NETWORK = [s[0] for s in flatten.NETWORK_SLOTS]


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Telemetry out of a stream over the events table, which may be one file or a folder."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return V.telemetry(table_stream(spark, f"{sf}/events.parque[t]", schema))


def _finished(query) -> None:
    query.awaitTermination()


def stream_landing(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "landing")
    rows = event_stream(spark, sf).select("event_id", "ts", "agent_id", "v")
    _finished(jobs.land_raw(rows, path, jobs.ALL_NOW))
    return spark.read.parquet(f"{path}/rows").select("event_id", "ts", "agent_id", "v", F.col("date").cast("string").alias("date"))


def stream_threshold_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "thresholds")
    _finished(jobs.detect_thresholds(event_stream(spark, sf), path, jobs.ALL_NOW))
    return spark.read.parquet(f"{path}/rows").select("event_id", "ts", "agent_id", "type", "severity", "value", "priority")


def stream_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """Both feeds, every message field by field: one row per anomaly, and one per snapshot for its values."""
    path = shared_dir(spark, "feeds")
    metrics = ["cpu_usage", "memory_usage", "disk_usage", "network_latency"]
    for query in jobs.fan_out(event_stream(spark, sf), metrics, path, jobs.ALL_NOW):
        _finished(query)
    feeds = [spark.read.parquet(f"{path}/{name}/rows") for name in ("anomalies", "metrics")]
    return inventory.anomaly_fields(feeds[0]).unionByName(inventory.metric_fields(feeds[1], metrics), allowMissingColumns=True)


PATTERN_COLUMNS = ["event_id", "agent_id", "type", "severity", "description", "suggested_action"]


def _patterns(spark: SparkSession, rows: DataFrame, lateness_s: int, name: str) -> str:
    path = shared_dir(spark, name)
    _finished(jobs.detect_patterns(rows, path, jobs.ALL_NOW, lateness_s))
    state.finish(spark, path, state.find_patterns(path))
    return path


def stream_pattern_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    path = _patterns(spark, event_stream(spark, sf), 600, "patterns")
    return spark.read.parquet(f"{path}/rows").select(*PATTERN_COLUMNS)


FEEDS, DELAY_S = 4, 12 * 3600


def _delayed(spark: SparkSession, sf: str, messages: bool = False) -> DataFrame:
    """A stream of several files in which every other snapshot, or message, arrives half a day late."""
    rows = V.tel(spark, sf)
    arrival = micros("ts") + F.col("event_id") % 2 * F.lit(DELAY_S * 1_000_000).cast("bigint")
    ends = rows.agg(F.min(arrival).alias("a"), F.max(arrival).alias("b")).first()
    feed = F.floor((arrival - ends["a"]) * FEEDS / F.lit(ends["b"] - ends["a"] + 1)).cast("int")
    path = shared_dir(spark, "delayed")
    for k in range(FEEDS):
        part = rows.where(feed == k)
        if messages:
            V.message_texts(V.snapshots_of(part)).select("value").coalesce(1).write.mode("append").text(path)
        else:
            part.coalesce(1).write.mode("append").parquet(path)
    return json_stream(spark, path, files_per_batch=1) if messages else table_stream(spark, path, rows.schema, files_per_batch=1)


def stream_patterns_late(spark: SparkSession, sf: str) -> DataFrame:
    """Late rows, many batches: the same as over the whole table."""
    path = _patterns(spark, _delayed(spark, sf), DELAY_S, "patterns-late")
    return spark.read.parquet(f"{path}/rows").select(*PATTERN_COLUMNS)


def stream_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What arrives later than the allowed hour."""
    path = _patterns(spark, _delayed(spark, sf), 3600, "patterns-too-late")
    late = state.late_rows(spark, path, "event_id bigint, ts timestamp_ntz, agent_id bigint, cpu_usage double, memory_usage double")
    return late.select("event_id", "ts", "agent_id")


def _alert_events(telemetry: DataFrame) -> DataFrame:
    columns = ["event_id", "ts", "agent_id", "type", "severity", "description", "suggested_action"]
    opened = detect.threshold_anomalies(telemetry).select(*columns, F.lit(0).alias("resolve"))
    closed = telemetry.where(F.col("event_type") == "signup").select(
        "event_id", "ts", "agent_id", F.lit(V.CPU_BREACH).alias("type"),
        *[F.lit(None).cast("string").alias(c) for c in columns[4:]], F.lit(1).alias("resolve"))
    return opened.unionByName(closed)


def _tracked(spark: SparkSession, rows: DataFrame, lateness_s: int, name: str) -> DataFrame:
    path = shared_dir(spark, name)
    _finished(jobs.track_alerts(_alert_events(rows), path, jobs.ALL_NOW, lateness_s))
    state.finish(spark, path, state.follow_alerts(path))
    return jobs.tracked_alerts(spark, path)


def stream_notifications(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "notified")
    _finished(jobs.track_alerts(_alert_events(_delayed(spark, sf)), path, jobs.ALL_NOW, DELAY_S))
    state.finish(spark, path, state.follow_alerts(path))
    return spark.read.parquet(f"{path}/notifications").drop("batch")


def stream_alerts_purged(spark: SparkSession, sf: str) -> DataFrame:
    """Late rows, many batches: what is left of the alerts a day after they were resolved."""
    path = shared_dir(spark, "alerts-purged")
    _finished(jobs.track_alerts_purged(_alert_events(_delayed(spark, sf)), path, jobs.ALL_NOW, DELAY_S))
    state.finish(spark, path, state.follow_alerts(path, 24))
    return jobs.kept_alerts(spark, path, last_ts(V.tel(spark, sf))).select("alert_id", "episode", "status", "resolved_at")


def stream_alert_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return _tracked(spark, event_stream(spark, sf), 600, "alerts")


def stream_alerts_late(spark: SparkSession, sf: str) -> DataFrame:
    return _tracked(spark, _delayed(spark, sf), DELAY_S, "alerts-late")


# Over the system features: feature 8 is the disk read rate, 0 the CPU usage.
FIXED_SYSTEM = [
    (0, 1, 8, 0.0, 0.0, 256), (0, 2, 0, 50.0, 0.0, 256), (0, 3, -1, 0.0, 9.0, 256), (0, 4, -1, 0.0, 11.0, 256), (0, 5, -1, 0.0, 3.0, 256),
]
FIXED_OFFSET = -0.6


def _all_values(rows: DataFrame) -> DataFrame:
    """Detector values and both feature vectors; the system's need the snapshot before."""
    rows = flatten.system_features(detection.disk_rates(rows))
    rows = rows.withColumnsRenamed({n: f"system_{n}" for n in SYSTEM})
    return flatten.network_features(flatten.detector_values(rows)).drop("cpu", "memory", "disk", "network")


def _saved_forests(spark: SparkSession) -> list[tuple[str, tuple, float]]:
    forests = []
    for name, nodes, features, kind, settings in (
        ("network", FIXED_NODES, NETWORK, C.NETWORK_ANOMALY, C.NETWORK_FOREST),
        ("system", FIXED_SYSTEM, [f"system_{n}" for n in SYSTEM], C.SYSTEM_ANOMALY, C.SYSTEM_FOREST),
    ):
        model = shared_dir(spark, f"model-{name}")
        forest.save_forest(constant_table(spark, nodes, forest.NODES), FIXED_OFFSET, features, model)
        forests.append((model, kind, settings["high_below"]))
    return forests


def stream_all_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """Messages with the anomalies of all four detectors, from late rows in many batches, one row per anomaly."""
    path, forests = shared_dir(spark, "all-anomalies"), _saved_forests(spark)
    process = state.send_all_anomalies(path, _all_values, forests)
    snapshots = V.snapshots_of(_delayed(spark, sf)).select("event_id", "ts", "agent_id", "cpu", "memory", "disk", "network")
    _finished(state.in_order(snapshots, path, process, jobs.ALL_NOW, DELAY_S))
    state.finish(spark, path, process)
    return inventory.anomaly_fields(spark.read.parquet(f"{path}/rows")).drop("timestamp")


def stream_messages_all_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """The anomalies of all four detectors from message text that arrives late and in many batches, one row per anomaly."""
    path, forests = shared_dir(spark, "messages-all"), _saved_forests(spark)
    _finished(jobs.detect_all_in_messages(_delayed(spark, sf, messages=True), path, _all_values, forests, jobs.ALL_NOW, DELAY_S))
    state.finish(spark, path, state.send_all_anomalies(path, _all_values, forests))
    return inventory.anomaly_fields(spark.read.parquet(f"{path}/rows"), "string").drop("event_id")


def _branch(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """What ``detect_messages`` writes for messages of all kinds."""
    feed, path = shared_dir(spark, "typed-messages"), shared_dir(spark, "branches")
    V.typed_feed(spark, sf).write.text(feed)
    _finished(jobs.detect_messages(json_stream(spark, feed), path, jobs.ALL_NOW))
    return spark.read.parquet(f"{path}/{table}").select("ts", "agent_id", "route")


def stream_replies(spark: SparkSession, sf: str) -> DataFrame:
    return _branch(spark, sf, "replies")


def stream_commands(spark: SparkSession, sf: str) -> DataFrame:
    return _branch(spark, sf, "commands")


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of message text, some of it unreadable."""
    path = shared_dir(spark, "messages")
    V.message_feed(spark, sf).write.text(path)
    return json_stream(spark, path)


def _from_messages(spark: SparkSession, sf: str, table: str) -> DataFrame:
    path = shared_dir(spark, "from-messages")
    _finished(jobs.detect_messages(_messages(spark, sf), path, jobs.ALL_NOW))
    return spark.read.parquet(f"{path}/{table}")


def stream_messages_to_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return _from_messages(spark, sf, "anomalies").select("ts", "agent_id", "type", "severity", "value", "priority")


def stream_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    return _from_messages(spark, sf, "quarantine").select("value")


def stream_messages_landed(spark: SparkSession, sf: str) -> DataFrame:
    return _from_messages(spark, sf, "landed").select("ts", "agent_id")


def stream_latest_per_agent(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "latest")
    rows = event_stream(spark, sf).select("event_id", "ts", "agent_id", "cpu_usage")
    _finished(jobs.keep_latest(rows, path, jobs.ALL_NOW))
    return jobs.newest_version(spark, path)


def stream_agent_registry(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "registry")
    _finished(jobs.keep_registry(V.connections_of(event_stream(spark, sf)), path, jobs.ALL_NOW))
    return jobs.newest_version(spark, path).select("agent_id", "hostname", "platform", "status", "first_connected", "last_seen")


def stream_liveness(spark: SparkSession, sf: str) -> DataFrame:
    """Agents that fall silent and return, up to the watermark."""
    path = shared_dir(spark, "liveness")
    _finished(liveness.watch_liveness(event_stream(spark, sf), path, MISSED, jobs.ALL_NOW))
    return spark.read.parquet(f"{path}/rows")


def stream_anomalies_24h(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "last-day")
    _finished(jobs.anomalies_last_day(detect.threshold_anomalies(event_stream(spark, sf)), path, jobs.ALL_NOW))
    hours = jobs.hours_counted(spark, path)
    return jobs.last_day(hours, jobs.watermark(spark, path)).withColumn("hour_end", F.col("hour_end").cast("timestamp_ntz"))


def stream_without_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Every snapshot arrives twice and is kept once."""
    path = shared_dir(spark, "unique")
    rows = event_stream(spark, sf).select("event_id", "ts", "agent_id", "v")
    _finished(jobs.keep_once(rows.union(rows), path, jobs.ALL_NOW))
    state.finish(spark, path, state.drop_repeats(path))
    return jobs.kept_once(spark, path)


def stream_critical_feed(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "critical")
    _finished(jobs.critical_feed(event_stream(spark, sf), path, jobs.ALL_NOW))
    return inventory.critical_fields(jobs.newest_check(spark, path))


def _system_rows(spark: SparkSession, sf: str) -> DataFrame:
    return flatten.system_features(detection._with_disk_rates(spark, sf)).select("event_id", "ts", "agent_id", *SYSTEM)


def _network_rows(spark: SparkSession, sf: str) -> DataFrame:
    return flatten.network_features(V.snapshots(spark, sf)).select("event_id", "ts", "agent_id", *NETWORK)


def _system_anomalies(decided: DataFrame) -> DataFrame:
    return forest.forest_anomalies(decided, *C.SYSTEM_ANOMALY, C.SYSTEM_FOREST["high_below"])


def _network_anomalies(decided: DataFrame) -> DataFrame:
    return forest.forest_anomalies(decided, *C.NETWORK_ANOMALY, C.NETWORK_FOREST["high_below"])


def _fitted(rows: DataFrame, features: list[str], settings: dict) -> DataFrame:
    return forest.detect_with_forest(rows, features, settings["trees"], settings["contamination"])


def forest_system(spark: SparkSession, sf: str) -> DataFrame:
    return _system_anomalies(_fitted(_system_rows(spark, sf), SYSTEM, C.SYSTEM_FOREST))


def forest_network(spark: SparkSession, sf: str) -> DataFrame:
    return _network_anomalies(_fitted(_network_rows(spark, sf), NETWORK, C.NETWORK_FOREST))


def _per_message(rows: DataFrame, features: list[str], settings: dict) -> DataFrame:
    return forest.per_message_decision(rows, features, settings["trees"], settings["window"], settings["contamination"])


def forest_system_per_message(spark: SparkSession, sf: str) -> DataFrame:
    return _system_anomalies(_per_message(_system_rows(spark, sf), SYSTEM, C.SYSTEM_FOREST))


def forest_network_per_message(spark: SparkSession, sf: str) -> DataFrame:
    return _network_anomalies(_per_message(_network_rows(spark, sf), NETWORK, C.NETWORK_FOREST))


def _moving(rows: DataFrame, features: list[str], settings: dict) -> DataFrame:
    return moving_forest.decisions(rows, features, settings["trees"], settings["window"], settings["contamination"])


def forest_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of ``forest_system_per_message``, from trees that follow the window."""
    return _system_anomalies(_moving(_system_rows(spark, sf), SYSTEM, C.SYSTEM_FOREST))


def forest_incremental_network(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of ``forest_network_per_message``, from trees that follow the window."""
    return _network_anomalies(_moving(_network_rows(spark, sf), NETWORK, C.NETWORK_FOREST))


# A forest written by hand, so that SQL can walk it too: tree, node, feature, split, path, rows grown on.
FIXED_NODES = [
    (0, 1, 0, 250.0, 0.0, 256), (0, 2, 3, 150.0, 0.0, 256), (0, 3, -1, 0.0, 2.5, 256), (0, 4, -1, 0.0, 9.0, 256), (0, 5, -1, 0.0, 11.5, 256),
    (1, 1, 4, 5000.0, 0.0, 256), (1, 2, -1, 0.0, 10.0, 256), (1, 3, 5, 7000.0, 0.0, 256), (1, 6, -1, 0.0, 7.25, 256), (1, 7, -1, 0.0, 3.0, 256),
]
FIXED_SHARE = 0.3


def _fixed_nodes(spark: SparkSession) -> DataFrame:
    return constant_table(spark, FIXED_NODES, "tree int, node int, feature int, split double, path double, size int")


def _fixed_scores(spark: SparkSession, sf: str, nodes: DataFrame) -> DataFrame:
    scored = forest.score_forest(_network_rows(spark, sf), nodes, NETWORK)
    return scored.withColumn("score", F.round("score", 9))


def forest_score_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return _fixed_scores(spark, sf, _fixed_nodes(spark)).select("event_id", "score")


def _flags(scored: DataFrame, offset: float) -> DataFrame:
    decided = forest.decide(scored, offset).withColumn("decision", F.round("decision", 9))
    found = _network_anomalies(decided)
    return found.select("event_id", "agent_id", "type", "severity", "score", "description", "suggested_action")


def forest_offset_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Offset, decision and severity over the scores of the fixed forest."""
    scored = _fixed_scores(spark, sf, _fixed_nodes(spark))
    return _flags(scored, forest.forest_offset(scored, FIXED_SHARE))


def forest_reloaded(spark: SparkSession, sf: str) -> DataFrame:
    """Save, load again, score: what a later job does with a stored forest."""
    path = shared_dir(spark, "model")
    nodes = _fixed_nodes(spark)
    forest.save_forest(nodes, forest.forest_offset(_fixed_scores(spark, sf, nodes), FIXED_SHARE), NETWORK, path)
    again, offset, features = forest.load_forest(spark, path)
    scored = forest.score_forest(_network_rows(spark, sf), again, features)
    return _flags(scored.withColumn("score", F.round("score", 9)), offset)


def stream_forest_network(spark: SparkSession, sf: str) -> DataFrame:
    """A stream scored with a forest that a batch job has fitted and saved."""
    rows = written(_network_rows(spark, sf), "features")
    nodes = written(forest.fit_forest(rows, NETWORK, C.NETWORK_FOREST["trees"]), "forest")
    scored = written(forest.score_forest(rows, nodes, NETWORK).select("score"), "scores")
    model, path = shared_dir(spark, "model"), shared_dir(spark, "scored")
    forest.save_forest(nodes, forest.forest_offset(scored, C.NETWORK_FOREST["contamination"]), NETWORK, model)
    live = flatten.network_features(V.snapshots_of(event_stream(spark, sf))).select("event_id", "ts", "agent_id", *NETWORK)
    _finished(jobs.detect_with_saved_forest(
        live, model, path, *C.NETWORK_ANOMALY, C.NETWORK_FOREST["high_below"], jobs.ALL_NOW))
    return spark.read.parquet(f"{path}/rows").drop("batch")


def anomalies_four_detectors(spark: SparkSession, sf: str) -> DataFrame:
    """Both forests, the thresholds and the patterns over one table, with advice."""
    values = flatten.detector_values(V.snapshots(spark, sf))
    found = detect.all_anomalies(values)
    for other in (forest_system(spark, sf), forest_network(spark, sf)):
        found = found.unionByName(other)
    return detect.with_remediation(found).select("event_id", "agent_id", "type", "severity", "description", "priority")


_FIXED = """
path AS (SELECT event_id, agent_id,
         CASE WHEN network_latency > 250 THEN 2.5 WHEN CAST(v % 300 AS DOUBLE) > 150 THEN 11.5 ELSE 9 END
         + CASE WHEN ((v * 11) % 1000001) / CAST(100 AS DOUBLE) <= 5000 THEN 10
                WHEN ((v * 19) % 1000001) / CAST(100 AS DOUBLE) > 7000 THEN 3 ELSE 7.25 END AS total FROM snap),
fixed AS (SELECT event_id, agent_id,
          round(-pow(CAST(2 AS DOUBLE), -(total / CAST(2 AS DOUBLE)) / (CAST(2 AS DOUBLE) * (ln(255) + 0.5772156649015329) - CAST(510 AS DOUBLE) / 256)), 9) AS score FROM path)""".strip()
_FLAGS = sql(f"""
WITH {_FIXED},
decided AS (SELECT *, round(score - (SELECT quantile_cont(score, {FIXED_SHARE}) FROM fixed), 9) AS decision FROM fixed)
SELECT event_id, agent_id, 'network_anomaly' AS type, CASE WHEN decision < {C.NETWORK_FOREST["high_below"]} THEN 'high' ELSE 'medium' END AS severity,
       decision AS score, 'Unusual network behavior detected' AS description, 'check_network_connectivity' AS suggested_action
FROM decided WHERE decision < 0""", "snap")
_PATTERNS = sql(
    "WITH " + detection._JUMP.format(t="tel").strip() + ",\n" + detection._LEAK.format(t="tel").strip()
    + f"\nSELECT event_id, agent_id, type, severity, description, suggested_action FROM ({detection._JUMP_SELECT} UNION ALL {detection._LEAK_SELECT})", "tel")
_ALERTS = sql(f"WITH {_EPISODES.strip()}\nSELECT * FROM episodes", "anomaly_events", "resolve_events")

_FOUND = f"""{detection._JUMP.format(t="snap").strip()},
{detection._LEAK.format(t="snap").strip()},
{_FIXED},
rate AS (SELECT *, {detection._rate_sql("v * 1024", "snap", "r")} FROM snap),
walked AS (SELECT event_id, agent_id, -pow(CAST(2 AS DOUBLE), -CAST(CASE WHEN coalesce(r, 0) > 0 THEN 9 WHEN cpu_usage > 50 THEN 3 ELSE 11 END AS DOUBLE)
           / (CAST(2 AS DOUBLE) * (ln(255) + 0.5772156649015329) - CAST(510 AS DOUBLE) / 256)) - ({FIXED_OFFSET}) AS decision
           FROM rate WHERE has_cpu AND has_memory),
found AS (
  SELECT event_id, agent_id, 'cpu_threshold_breach' AS kind, CASE WHEN cpu_usage > 95 THEN 'critical' ELSE 'high' END AS severity, cpu_usage AS value, CAST(80 AS DOUBLE) AS threshold,
         concat('CPU usage ', CAST(cpu_usage AS VARCHAR), '% exceeds threshold') AS description, 'identify_cpu_intensive_processes' AS suggested_action FROM snap WHERE cpu_usage > 80
  UNION ALL SELECT event_id, agent_id, 'memory_threshold_breach', CASE WHEN memory_usage > 95 THEN 'critical' ELSE 'high' END, memory_usage, 85,
         concat('Memory usage ', CAST(memory_usage AS VARCHAR), '% exceeds threshold'), 'free_memory_resources' FROM snap WHERE memory_usage > 85
  UNION ALL SELECT event_id, agent_id, 'disk_threshold_breach', CASE WHEN disk_usage > 98 THEN 'critical' ELSE 'high' END, disk_usage, 90,
         concat('Disk usage ', CAST(disk_usage AS VARCHAR), '% exceeds threshold'), 'cleanup_disk_space' FROM snap WHERE disk_usage > 90
  UNION ALL SELECT event_id, agent_id, 'network_latency_high', 'medium', network_latency, 200,
         concat('Network latency ', CAST(network_latency AS VARCHAR), 'ms exceeds threshold'), 'check_network_connectivity' FROM snap WHERE network_latency > 200
  UNION ALL SELECT event_id, agent_id, type, severity, NULL, NULL, description, suggested_action FROM ({detection._JUMP_SELECT})
  UNION ALL SELECT event_id, agent_id, type, severity, NULL, NULL, description, suggested_action FROM ({detection._LEAK_SELECT})
  UNION ALL SELECT event_id, agent_id, 'network_anomaly', CASE WHEN score - ({FIXED_OFFSET}) < {C.NETWORK_FOREST["high_below"]} THEN 'high' ELSE 'medium' END, NULL, NULL,
         'Unusual network behavior detected', 'check_network_connectivity' FROM fixed WHERE score - ({FIXED_OFFSET}) < 0
  UNION ALL SELECT event_id, agent_id, 'system_anomaly', CASE WHEN decision < {C.SYSTEM_FOREST["high_below"]} THEN 'high' ELSE 'medium' END, NULL, NULL,
         'Unusual system behavior detected by ML model', 'investigate_system_resources' FROM walked WHERE decision < 0)"""
_SENT = """'anomaly_detected' AS type, kind, severity, value, threshold, description, suggested_action FROM found"""

_SILENCE_S = MISSED * C.SNAPSHOT_INTERVAL_S

QUERIES = {
    "forest_system": (forest_system, None),
    "forest_network": (forest_network, None),
    "forest_system_per_message": (forest_system_per_message, None),
    "forest_network_per_message": (forest_network_per_message, None),
    "forest_incremental": (forest_incremental, None),
    "forest_incremental_network": (forest_incremental_network, None),
    "forest_score_fixed": (forest_score_fixed, sql(f"WITH {_FIXED}\nSELECT event_id, score FROM fixed", "snap")),
    "forest_offset_flags": (forest_offset_flags, _FLAGS),
    "forest_reloaded": (forest_reloaded, _FLAGS),
    "anomalies_four_detectors": (anomalies_four_detectors, None),
    "stream_forest_network": (stream_forest_network, None),
    "stream_envelopes": (stream_envelopes, sql(f"""
SELECT event_id, agent_id, 'anomaly_detected' AS type, {inventory.ISO_TS} AS timestamp, type AS kind, severity, value, threshold, description, suggested_action,
       NULL AS cpu_usage, NULL AS memory_usage, NULL AS disk_usage, NULL AS network_latency FROM anomaly_events
UNION ALL SELECT event_id, agent_id, 'metrics_update', {inventory.ISO_TS}, NULL, NULL, NULL, NULL, NULL, NULL, cpu_usage, memory_usage, disk_usage, network_latency FROM tel""",
        "anomaly_events")),
    "stream_landing": (stream_landing, sql(
        "SELECT event_id, ts, agent_id, v, strftime(ts, '%Y-%m-%d') AS date FROM tel", "tel")),
    "stream_threshold_anomalies": (stream_threshold_anomalies, sql("""
SELECT event_id, ts, agent_id, type, severity, value,
       CASE type WHEN 'disk_threshold_breach' THEN 'critical' WHEN 'network_latency_high' THEN 'medium' ELSE 'high' END AS priority FROM anomaly_events""", "anomaly_events")),
    "stream_pattern_anomalies": (stream_pattern_anomalies, _PATTERNS),
    "stream_patterns_late": (stream_patterns_late, _PATTERNS),
    "stream_late_rows": (stream_late_rows, sql(f"""
WITH a AS (SELECT event_id, ts, agent_id, epoch_us(ts) + event_id % 2 * {DELAY_S * 1_000_000} AS arrival FROM tel),
f AS (SELECT *, CAST(floor((arrival - (SELECT min(arrival) FROM a)) * CAST({FEEDS} AS DOUBLE) / ((SELECT max(arrival) - min(arrival) FROM a) + 1)) AS INT) AS feed FROM a),
seen AS (SELECT feed, max(max(epoch_us(ts))) OVER (ORDER BY feed) - 3600000000 AS until FROM f GROUP BY feed)
SELECT event_id, ts, agent_id FROM f JOIN seen s ON s.feed = f.feed - 1 WHERE epoch_us(ts) < until""", "tel")),
    "stream_alert_episodes": (stream_alert_episodes, _ALERTS),
    "stream_alerts_late": (stream_alerts_late, _ALERTS),
    "stream_alerts_purged": (stream_alerts_purged, REPORTS["alerts_resolved_purge"][1]),
    "stream_notifications": (stream_notifications, REPORTS["notifications_outbox"][1]),
    "stream_all_anomalies": (stream_all_anomalies, sql(f"WITH {_FOUND}\nSELECT event_id, agent_id, {_SENT}", "snap")),
    "stream_messages_all_anomalies": (stream_messages_all_anomalies, sql(
        f"WITH readable AS (SELECT * FROM snap WHERE event_id % 50 NOT IN (48, 49)),\n{_FOUND.replace('FROM snap', 'FROM readable')}\n"
        f"SELECT concat('agent-', CAST(agent_id AS VARCHAR)) AS agent_id, {inventory.ISO_TS} AS timestamp, {_SENT} JOIN (SELECT event_id, ts FROM tel) t USING (event_id)", "snap")),
    "stream_replies": (stream_replies, sql("""
SELECT ts, concat('agent-', CAST(agent_id AS VARCHAR)) AS agent_id, CASE event_type WHEN 'signup' THEN 'pong' ELSE 'remediation_result' END AS route
FROM tel WHERE event_type IN ('signup', 'error')""", "tel")),
    "stream_commands": (stream_commands, sql("""
SELECT ts, concat('agent-', CAST(agent_id AS VARCHAR)) AS agent_id, CASE WHEN event_id % 3 = 0 THEN 'restart' ELSE 'remediate' END AS route
FROM commands""", "commands")),
    "stream_messages_to_anomalies": (stream_messages_to_anomalies, sql("""
SELECT ts, concat('agent-', CAST(agent_id AS VARCHAR)) AS agent_id, type, severity, value,
       CASE type WHEN 'disk_threshold_breach' THEN 'critical' WHEN 'network_latency_high' THEN 'medium' ELSE 'high' END AS priority
FROM (SELECT event_id, ts, agent_id, 'cpu_threshold_breach' AS type, CASE WHEN cpu_usage > 95 THEN 'critical' ELSE 'high' END AS severity, cpu_usage AS value FROM snap WHERE cpu_usage > 80
      UNION ALL SELECT event_id, ts, agent_id, 'memory_threshold_breach', CASE WHEN memory_usage > 95 THEN 'critical' ELSE 'high' END, memory_usage FROM snap WHERE memory_usage > 85
      UNION ALL SELECT event_id, ts, agent_id, 'disk_threshold_breach', CASE WHEN disk_usage > 98 THEN 'critical' ELSE 'high' END, disk_usage FROM snap WHERE disk_usage > 90
      UNION ALL SELECT event_id, ts, agent_id, 'network_latency_high', 'medium', network_latency FROM snap WHERE network_latency > 200)
WHERE event_id % 50 <> 49 AND event_id % 50 <> 48""", "snap")),
    "stream_quarantine": (stream_quarantine, sql("""
SELECT CASE WHEN event_id % 50 = 48 THEN concat('{"type":"mystery","agent_id":"agent-', CAST(agent_id AS VARCHAR), '","timestamp":"', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '"}')
            ELSE substr(concat('{"agent_id":"agent-', CAST(agent_id AS VARCHAR), '","timestamp":"', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '"'), 1, 40) END AS value
FROM tel WHERE event_id % 50 IN (48, 49)""", "tel")),
    "stream_messages_landed": (stream_messages_landed, sql("""
SELECT ts, concat('agent-', CAST(agent_id AS VARCHAR)) AS agent_id FROM tel WHERE event_id % 50 NOT IN (48, 49)""", "tel")),
    "stream_latest_per_agent": (stream_latest_per_agent, sql("""
SELECT event_id, ts, agent_id, cpu_usage FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY ts DESC, event_id DESC) AS rn FROM tel) WHERE rn = 1""", "tel")),
    "stream_agent_registry": (stream_agent_registry, sql("""
SELECT agent_id, CAST(agent_id AS VARCHAR) AS hostname, 'Unknown' AS platform, 'healthy' AS status, min(ts) AS first_connected, max(ts) AS last_seen
FROM conn_events WHERE kind = 'connect' GROUP BY agent_id""", "conn_events")),
    "stream_liveness": (stream_liveness, sql(f"""
WITH g AS (SELECT agent_id, ts, lag(epoch_us(ts)) OVER w AS earlier, lead(epoch_us(ts)) OVER w AS later FROM tel WINDOW w AS (PARTITION BY agent_id ORDER BY ts, event_id)),
mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 600 SECOND AS until FROM tel)
SELECT agent_id, 'online' AS status, ts AS since, ts AS last_seen FROM g, mark
WHERE coalesce(epoch_us(ts) - earlier > {_SILENCE_S * 1_000_000}, true) AND ts < until
UNION ALL
SELECT agent_id, 'offline', ts + INTERVAL {_SILENCE_S} SECOND, ts FROM g, mark
WHERE coalesce(later - epoch_us(ts) > {_SILENCE_S * 1_000_000}, true) AND ts + INTERVAL {_SILENCE_S} SECOND < until""", "tel")),
    "stream_anomalies_24h": (stream_anomalies_24h, sql("""
WITH hours AS (SELECT date_trunc('hour', ts) + to_hours(CAST(h AS BIGINT)) AS hour_end FROM anomaly_events, (SELECT unnest(range(1, 25)) AS h) r)
SELECT hour_end, count(*) AS n FROM hours GROUP BY hour_end HAVING hour_end <= (SELECT max(ts) FROM anomaly_events) - INTERVAL 10 MINUTE""", "anomaly_events")),
    "stream_without_repeats": (stream_without_repeats, sql("SELECT event_id, ts, agent_id, v FROM tel", "tel")),
    "stream_critical_feed": (stream_critical_feed, inventory.CRITICAL),
}

"""Telemetry-shaped views over the driver tables, in Spark and as SQL for the oracle.

Values use integer arithmetic divided by 100, so both engines compute identical numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.slices import running
from fleetlens.sources.tables import table

CPU_BREACH = "cpu_threshold_breach"


def _hundredths(value: Column, modulus: int) -> Column:
    return (value % modulus) / F.lit(100.0)


def telemetry(events: DataFrame) -> DataFrame:
    """One snapshot per event, batch or stream."""
    v = F.col("v")
    return (
        events.select(
            "event_id", "ts", F.col("user_id").alias("agent_id"), "event_type",
            F.round(F.col("value") * 100).cast("bigint").alias("v"),
        )
        .select(
            "event_id", "ts", "agent_id", "event_type", "v",
            _hundredths(v, 10001).alias("cpu_usage"),
            _hundredths(v * 7 + F.col("event_id"), 10001).alias("memory_usage"),
            _hundredths(v * 13 + F.col("agent_id") * 31, 10001).alias("disk_usage"),
            _hundredths(v * 3, 30001).alias("network_latency"),
        )
    )


def tel(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry(table(spark, sf, "events"))


def tel_gap(spark: SparkSession, sf: str) -> DataFrame:
    return tel(spark, sf).select(
        "event_id", "ts", "agent_id",
        F.when(F.col("event_id") % 7 != 0, F.col("cpu_usage")).alias("cpu_usage"),
        F.when(F.col("event_id") % 5 != 0, F.col("memory_usage")).alias("memory_usage"),
        "disk_usage", "network_latency",
    )


def agents(spark: SparkSession, sf: str) -> DataFrame:
    system = F.when(F.col("agent_id") % 3 == 0, "Linux").when(F.col("agent_id") % 3 == 1, "Windows").otherwise("Darwin")
    return tel(spark, sf).select("agent_id").distinct().select(
        "agent_id", F.concat(F.lit("host-"), F.col("agent_id").cast("string")).alias("hostname"),
        system.alias("platform"),
    )


def conn_events(spark: SparkSession, sf: str) -> DataFrame:
    return connections_of(tel(spark, sf))


def connections_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("event_type").isin("signup", "error")).select(
        "event_id", "ts", "agent_id",
        F.when(F.col("event_type") == "signup", "connect").otherwise("disconnect").alias("kind"),
    )


def dashboard_events(spark: SparkSession, sf: str) -> DataFrame:
    """Dashboards that open and close, in the form of connection events."""
    return tel(spark, sf).where(F.col("event_type").isin("view", "purchase")).select(
        "event_id", "ts", "agent_id",
        F.when(F.col("event_type") == "view", "connect").otherwise("disconnect").alias("kind"),
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    kind = (
        F.when(F.col("event_type") == "signup", "pong")
        .when(F.col("event_type") == "error", "remediation_result")
        .when(F.col("event_type") == "purchase", "mystery")
    )
    return tel(spark, sf).select("event_id", "ts", "agent_id", "cpu_usage", kind.alias("msg_type"))


def resolve_events(spark: SparkSession, sf: str) -> DataFrame:
    return tel(spark, sf).where(F.col("event_type") == "signup").select(
        "event_id", "ts", "agent_id", F.lit(CPU_BREACH).alias("type")
    )


def commands(spark: SparkSession, sf: str) -> DataFrame:
    issues = [CPU_BREACH, "memory_threshold_breach", "disk_threshold_breach", "network_latency_high", "general"]
    return tel(spark, sf).where(F.col("event_type") == "click").select(
        "event_id", "ts", (F.col("agent_id") + 20).alias("agent_id"),
        F.element_at(F.array(*map(F.lit, issues)), (F.col("v") % 5 + 1).cast("int")).alias("issue_type"),
    )


def processes(spark: SparkSession, sf: str) -> DataFrame:
    return tel(spark, sf).select(
        "agent_id", F.col("event_id").alias("pid"), F.col("event_type").alias("name"),
        F.col("cpu_usage").alias("cpu_percent"), F.col("memory_usage").alias("memory_percent"),
        (F.col("v") * 1048576).alias("rss_bytes"),
    )


def order_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A rule per order: on one of three metrics, with a threshold in hundredths."""
    metric = F.when(F.col("o_orderkey") % 3 == 0, "cpu_usage").when(F.col("o_orderkey") % 3 == 1, "memory_usage").otherwise("disk_usage")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("rule"), metric.alias("metric"), _hundredths(cents, 10001).alias("threshold"))


def counters(spark: SparkSession, sf: str) -> DataFrame:
    return running(
        tel(spark, sf).select("event_id", "ts", "agent_id", "v"), {"bytes_sent_total": F.col("v")}
    ).drop("v")


def partitions(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("bigint")
    return table(spark, sf, "part").select(
        (F.col("p_partkey") % 150).alias("agent_id"), F.col("p_partkey").alias("ordinal"),
        F.col("p_brand").alias("device"), F.col("p_type").alias("mountpoint"),
        (size * 1073741824).alias("total_bytes"),
        (size * 10737418 * ((F.col("p_partkey") * 37) % 101)).alias("used_bytes"),
    )


def interfaces(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("if_id"), F.col("n_name").alias("name"),
        (F.col("n_regionkey") % 2 == 0).alias("is_up"),
    )


def addresses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where(F.col("c_nationkey") % 4 != 0).select(
        F.col("c_nationkey").alias("if_id"), F.col("c_name").alias("address")
    )


def host_interfaces(spark: SparkSession, sf: str) -> DataFrame:
    """The interfaces section of a snapshot: one without addresses, one with up to two."""
    digit = (F.col("v") % 250).cast("string")
    address = lambda family, text: F.struct(F.lit(family).alias("family"), text.alias("address"))
    v4 = address("AF_INET", F.concat(F.lit("10.0.0."), digit))
    v6 = address("AF_INET6", F.concat(F.lit("fe80::"), digit))
    nic = lambda name, up, found: F.struct(F.lit(name).alias("name"), up.alias("is_up"), found.alias("addresses"))
    none = F.array().cast("array<struct<family:string,address:string>>")
    return tel(spark, sf).select(
        "event_id", "agent_id",
        F.array(
            nic("lo", F.lit(True), none),
            nic("eth0", F.col("v") % 2 == 0, F.when(F.col("v") % 2 == 0, F.array(v4, v6)).otherwise(F.array(v4))),
        ).alias("interfaces"),
    )


def files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("file_id"), F.col("o_orderdate").alias("ctime"),
        F.round(F.col("o_totalprice") * 1000).cast("bigint").alias("size_bytes"),
    )


def scripts(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("doc_id") % 11
    planted = F.when(kind == 0, "RM -RF /tmp/x ").when(kind == 1, "del /F a ").when(kind == 2, "Format c: ").otherwise("")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("script_id"), F.concat(planted, F.col("text")).alias("text")
    )


def probes(spark: SparkSession, sf: str) -> DataFrame:
    reply = F.concat(F.lit("64 bytes: seq=1 time="), F.col("network_latency").cast("string"), F.lit(" ms"))
    return tel(spark, sf).select(
        "event_id", "agent_id", F.col("event_type").alias("host"),
        F.when(F.col("event_type") == "error", "request timed out").otherwise(reply).alias("output"),
    )


def connections(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("host_id"),
        F.when(F.col("l_linestatus") == "O", "ESTABLISHED").otherwise("TIME_WAIT").alias("status"),
    )


def agent_logs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("agent_id"), "ts",
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.col("props").alias("message"),
    )


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots_of(tel(spark, sf))


def snapshots_of(rows: DataFrame) -> DataFrame:
    """One nested snapshot document per event; sections and keys are missing in places."""
    e, v, a = F.col("event_id"), F.col("v"), F.col("agent_id")
    service = F.element_at(F.array(F.lit("error"), F.lit("stopped"), F.lit("running"), F.lit("running")),
                           (v % 4 + 1).cast("int"))
    failed = F.when(v % 13 == 0, F.lit(-1.0))
    cpu = F.struct(
        F.col("cpu_usage").alias("usage_percent"),
        _hundredths(v, 1601).alias("load_avg_1m"), _hundredths(v + e, 1601).alias("load_avg_5m"),
        (v + e).alias("context_switches"),
    )
    memory = F.struct(
        F.when(e % 11 != 0, F.col("memory_usage")).alias("usage_percent"),
        _hundredths(v * 17, 1638401).alias("available_mb"), _hundredths(v * 5, 10001).alias("swap_usage_percent"),
    )
    part = lambda name, mount, factor: F.struct(
        F.lit(name).alias("device"), F.lit(mount).alias("mountpoint"), F.lit("ext4").alias("fstype"),
        ((v % 500 + 1) * factor / F.lit(1.0)).alias("total_gb"),
    )
    disk = F.struct(
        F.col("disk_usage").alias("usage_percent"),
        F.array(part("sda", "/", 1), part("sdb", "/data", 2)).alias("partitions"),
        (v * 1024).alias("read_bytes_total"), (v * 2048).alias("write_bytes_total"),
    )
    network = F.struct(
        F.when(e % 9 != 0, F.col("network_latency")).alias("latency_ms"),
        (v % 300).alias("connections_count"),
        _hundredths(v * 11, 1000001).alias("bytes_sent_per_sec"),
        _hundredths(v * 19, 1000001).alias("bytes_recv_per_sec"),
    )
    device = lambda factor: F.struct(
        (v * factor).alias("read_bytes"), (v * factor * 2).alias("write_bytes")
    )
    mount = lambda name, at: F.struct(F.lit(name).alias("device"), F.lit(at).alias("mountpoint"))
    health = F.struct(
        (v + F.lit(86400)).alias("uptime"),
        F.when(e % 6 != 0, F.array(_hundredths(v, 401), _hundredths(v * 3, 401), _hundredths(v * 5, 401))).alias("load_average"),
        F.array(
            F.struct(F.lit("sshd").alias("name"), service.alias("status")),
            F.struct(F.lit("cron").alias("name"), F.when(v % 3 == 0, "stopped").otherwise("running").alias("status")),
        ).alias("service_status"),
        F.struct(
            F.map_from_arrays(F.array(F.lit("sda"), F.lit("sdb")), F.array(device(1), device(3))).alias("io_stats"),
            F.array(mount("sda", "/"), mount("sdb", "/data")).alias("mount_points"),
        ).alias("disk_health"),
        F.map_from_arrays(
            F.array(F.lit("8.8.8.8"), F.lit("google.com")),
            F.array(F.coalesce(failed, F.col("network_latency")), _hundredths(v * 2, 20001)),
        ).alias("network_connectivity"),
    )
    system = F.when(a % 3 == 0, "Linux").when(a % 3 == 1, "Windows").otherwise("Darwin")
    platform = F.struct(
        system.alias("system"), F.concat(F.lit("host-"), a.cast("string")).alias("node"),
        F.concat(F.lit("6."), (a % 7).cast("string")).alias("release"), F.lit("x86_64").alias("machine"),
    )
    return rows.select(
        "event_id", "ts", "agent_id", platform.alias("platform"),
        F.when(e % 7 != 0, cpu).alias("cpu"), F.when(e % 5 != 0, memory).alias("memory"),
        disk.alias("disk"), network.alias("network"), health.alias("health"),
        F.when(e % 97 == 0, "collector failed").alias("error"),
    )


def raw_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshots as JSON text; every 50th message is cut short and unreadable."""
    sections = ["platform", "cpu", "memory", "disk", "network", "health", "error"]
    doc = F.to_json(F.struct(F.concat(F.lit("agent-"), F.col("agent_id").cast("string")).alias("agent_id"), *sections))
    return snapshots(spark, sf).select(
        "event_id", "ts", "agent_id",
        F.when(F.col("event_id") % 50 == 49, F.substring(doc, 1, 40)).otherwise(doc).alias("value"),
    )


def message_texts(rows: DataFrame) -> DataFrame:
    """``rows`` of snapshots with ``value``, the message as an agent sends it; of every 50, one is cut short and one has an unknown type."""
    sections = ["platform", "cpu", "memory", "disk", "network", "health", "error"]
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")
    agent = F.concat(F.lit("agent-"), F.col("agent_id").cast("string")).alias("agent_id")
    doc = F.to_json(F.struct(agent, time, *sections))
    other = F.to_json(F.struct(F.lit("mystery").alias("type"), agent, time))
    number = F.col("event_id") % 50
    return rows.withColumn("value", F.when(number == 49, F.substring(doc, 1, 40)).when(number == 48, other).otherwise(doc))


def message_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Messages as agents send them, with their own time."""
    return message_texts(snapshots(spark, sf)).select("value")


def typed_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of all kinds: telemetry, replies by type, commands to agents, and unknown ones."""
    text = lambda kind: F.to_json(F.struct(
        kind.alias("type"), F.concat(F.lit("agent-"), F.col("agent_id").cast("string")).alias("agent_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")))
    sent = commands(spark, sf).withColumn("kind", F.when(F.col("event_id") % 3 == 0, "restart").otherwise("remediate"))
    return messages(spark, sf).select(text(F.col("msg_type")).alias("value")).union(sent.select(text(F.col("kind")).alias("value")))


def metrics_json(spark: SparkSession, sf: str) -> DataFrame:
    """Stored metric rows: headline values inside a JSON column, with keys missing."""
    e = F.col("event_id")
    doc = F.struct(
        F.when(e % 7 != 0, F.col("cpu_usage")).alias("cpu_usage"),
        F.when(e % 5 != 0, F.col("memory_usage")).alias("memory_usage"),
        "disk_usage", "network_latency",
        F.when(F.col("cpu_usage") > 80, F.lit(True)).alias("is_anomaly"),
        F.when(F.col("cpu_usage") > 95, "critical").when(F.col("cpu_usage") > 80, "high").alias("severity"),
    )
    return tel(spark, sf).select("event_id", "ts", "agent_id", F.to_json(doc).alias("raw_data"))


# The same views as SQL, for the oracle. Each entry lists what it reads.
_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "tel": ((), """
SELECT event_id, ts, user_id AS agent_id, event_type, v,
       (v % 10001) / CAST(100 AS DOUBLE) AS cpu_usage,
       ((v * 7 + event_id) % 10001) / CAST(100 AS DOUBLE) AS memory_usage,
       ((v * 13 + user_id * 31) % 10001) / CAST(100 AS DOUBLE) AS disk_usage,
       ((v * 3) % 30001) / CAST(100 AS DOUBLE) AS network_latency
FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS v FROM events) e"""),
    "tel_gap": (("tel",), """
SELECT event_id, ts, agent_id,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE cpu_usage END AS cpu_usage,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE memory_usage END AS memory_usage,
       disk_usage, network_latency
FROM tel"""),
    "agents": (("tel",), """
SELECT DISTINCT agent_id, concat('host-', CAST(agent_id AS STRING)) AS hostname,
       CASE agent_id % 3 WHEN 0 THEN 'Linux' WHEN 1 THEN 'Windows' ELSE 'Darwin' END AS platform
FROM tel"""),
    "conn_events": (("tel",), """
SELECT event_id, ts, agent_id, CASE WHEN event_type = 'signup' THEN 'connect' ELSE 'disconnect' END AS kind
FROM tel WHERE event_type IN ('signup', 'error')"""),
    "dashboard_events": (("tel",), """
SELECT event_id, ts, agent_id, CASE WHEN event_type = 'view' THEN 'connect' ELSE 'disconnect' END AS kind
FROM tel WHERE event_type IN ('view', 'purchase')"""),
    "messages": (("tel",), """
SELECT event_id, ts, agent_id, cpu_usage,
       CASE event_type WHEN 'signup' THEN 'pong' WHEN 'error' THEN 'remediation_result'
                       WHEN 'purchase' THEN 'mystery' ELSE NULL END AS msg_type
FROM tel"""),
    "anomaly_events": (("tel",), """
SELECT event_id, ts, agent_id, 'cpu_threshold_breach' AS type, CASE WHEN cpu_usage > 95 THEN 'critical' ELSE 'high' END AS severity,
       cpu_usage AS value, CAST(80 AS DOUBLE) AS threshold, concat('CPU usage ', CAST(cpu_usage AS VARCHAR), '% exceeds threshold') AS description,
       'identify_cpu_intensive_processes' AS suggested_action FROM tel WHERE cpu_usage > 80
UNION ALL
SELECT event_id, ts, agent_id, 'memory_threshold_breach', CASE WHEN memory_usage > 95 THEN 'critical' ELSE 'high' END,
       memory_usage, CAST(85 AS DOUBLE), concat('Memory usage ', CAST(memory_usage AS VARCHAR), '% exceeds threshold'),
       'free_memory_resources' FROM tel WHERE memory_usage > 85
UNION ALL
SELECT event_id, ts, agent_id, 'disk_threshold_breach', CASE WHEN disk_usage > 98 THEN 'critical' ELSE 'high' END,
       disk_usage, CAST(90 AS DOUBLE), concat('Disk usage ', CAST(disk_usage AS VARCHAR), '% exceeds threshold'),
       'cleanup_disk_space' FROM tel WHERE disk_usage > 90
UNION ALL
SELECT event_id, ts, agent_id, 'network_latency_high', 'medium',
       network_latency, CAST(200 AS DOUBLE), concat('Network latency ', CAST(network_latency AS VARCHAR), 'ms exceeds threshold'),
       'check_network_connectivity' FROM tel WHERE network_latency > 200"""),
    "resolve_events": (("tel",), """
SELECT event_id, ts, agent_id, 'cpu_threshold_breach' AS type FROM tel WHERE event_type = 'signup'"""),
    "rules": ((), """
SELECT 'cpu_high' AS rule, 'cpu_usage' AS metric, 80 AS threshold, 300 AS duration_s, 'warning' AS severity
UNION ALL SELECT 'cpu_critical', 'cpu_usage', 95, 60, 'critical'
UNION ALL SELECT 'memory_high', 'memory_usage', 85, 300, 'warning'
UNION ALL SELECT 'memory_critical', 'memory_usage', 95, 60, 'critical'
UNION ALL SELECT 'disk_critical', 'disk_usage', 90, 0, 'critical'"""),
    "order_rules": ((), """
SELECT o_orderkey AS rule, CASE o_orderkey % 3 WHEN 0 THEN 'cpu_usage' WHEN 1 THEN 'memory_usage' ELSE 'disk_usage' END AS metric,
       (CAST(round(o_totalprice * 100) AS BIGINT) % 10001) / CAST(100 AS DOUBLE) AS threshold
FROM orders"""),
    "commands": (("tel",), """
SELECT event_id, ts, agent_id + 20 AS agent_id,
       CASE v % 5 WHEN 0 THEN 'cpu_threshold_breach' WHEN 1 THEN 'memory_threshold_breach'
                  WHEN 2 THEN 'disk_threshold_breach' WHEN 3 THEN 'network_latency_high' ELSE 'general' END AS issue_type
FROM tel WHERE event_type = 'click'"""),
    "processes": (("tel",), """
SELECT agent_id, event_id AS pid, event_type AS name, cpu_usage AS cpu_percent, memory_usage AS memory_percent,
       v * 1048576 AS rss_bytes
FROM tel"""),
    "counters": (("tel",), """
SELECT event_id, ts, agent_id,
       CAST(sum(v) OVER (PARTITION BY agent_id ORDER BY ts, event_id) AS BIGINT) AS bytes_sent_total
FROM tel"""),
    "partitions": ((), """
SELECT p_partkey % 150 AS agent_id, p_partkey AS ordinal, p_brand AS device, p_type AS mountpoint,
       CAST(p_size AS BIGINT) * 1073741824 AS total_bytes,
       CAST(p_size AS BIGINT) * 10737418 * ((p_partkey * 37) % 101) AS used_bytes
FROM part"""),
    "interfaces": ((), """
SELECT n_nationkey AS if_id, n_name AS name, n_regionkey % 2 = 0 AS is_up FROM nation"""),
    "addresses": ((), """
SELECT c_nationkey AS if_id, c_name AS address FROM customer WHERE c_nationkey % 4 <> 0"""),
    "files": ((), """
SELECT o_orderkey AS file_id, o_orderdate AS ctime, CAST(round(o_totalprice * 1000) AS BIGINT) AS size_bytes FROM orders"""),
    "scripts": ((), """
SELECT doc_id AS script_id,
       CASE doc_id % 11 WHEN 0 THEN concat('RM -RF /tmp/x ', text) WHEN 1 THEN concat('del /F a ', text)
                        WHEN 2 THEN concat('Format c: ', text) ELSE text END AS text
FROM documents"""),
    "probes": (("tel",), """
SELECT event_id, agent_id, event_type AS host,
       CASE WHEN event_type = 'error' THEN 'request timed out'
            ELSE concat('64 bytes: seq=1 time=', CAST(network_latency AS STRING), ' ms') END AS output
FROM tel"""),
    "connections": ((), """
SELECT l_suppkey AS host_id, CASE l_linestatus WHEN 'O' THEN 'ESTABLISHED' ELSE 'TIME_WAIT' END AS status FROM lineitem"""),
    "agent_logs": ((), """
SELECT user_id AS agent_id, ts, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, props AS message FROM events"""),
    # The nested snapshot, flat: a missing section is NULL, a missing key inside a section is 0.
    "snap": (("tel",), """
SELECT event_id, ts, agent_id, v,
       event_id % 7 <> 0 AS has_cpu, event_id % 5 <> 0 AS has_memory, event_id % 97 = 0 AS failed,
       CASE WHEN event_id % 7 <> 0 THEN cpu_usage END AS cpu_usage,
       CASE WHEN event_id % 5 <> 0 THEN (CASE WHEN event_id % 11 <> 0 THEN memory_usage ELSE 0 END) END AS memory_usage,
       disk_usage,
       CASE WHEN event_id % 9 <> 0 THEN network_latency ELSE 0 END AS network_latency,
       network_latency AS raw_latency
FROM tel"""),
}


def sql(body: str, *views: str) -> str:
    """``body`` preceded by the views it reads, in dependency order."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in _SQL[name][0]:
            add(other)
        if name not in needed:
            needed.append(name)

    for name in views:
        add(name)
    ctes = ",\n".join(f"{name} AS ({_SQL[name][1].strip()})" for name in needed)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}" if ctes else body

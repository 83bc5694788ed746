"""Host inventory computed over a table of many hosts: disks, files, probes, processes, sockets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.text import probe_latency
from fleetlens.functions.units import gib, mib, percent


def partition_usage(partitions: DataFrame) -> DataFrame:
    return partitions.withColumns({
        "total_gb": gib("total_bytes"), "used_gb": gib("used_bytes"),
        "free_gb": gib(F.col("total_bytes") - F.col("used_bytes")),
        "usage_percent": percent("used_bytes", "total_bytes"),
    })


def disk_rollup(partitions: DataFrame) -> DataFrame:
    """Totals per agent; the usage is that of the first partition."""
    return partition_usage(partitions).groupBy("agent_id").agg(
        F.sum("total_gb").alias("total_gb"), F.sum("used_gb").alias("used_gb"), F.sum("free_gb").alias("free_gb"),
        F.coalesce(F.min_by("usage_percent", "ordinal"), F.lit(0.0)).alias("usage_percent"),
    )


def stale(files: DataFrame, asof: Column, days: int = 1) -> DataFrame:
    return files.where(F.col("ctime") < asof - F.expr(f"INTERVAL {days} DAYS"))


def stale_summary(files: DataFrame, asof: Column, days: int = 1) -> DataFrame:
    """How many files are older than ``days``, and the space they hold."""
    return stale(files, asof, days).agg(
        F.count("*").alias("files"), F.coalesce(mib(F.sum("size_bytes")), F.lit(0.0)).alias("size_mb")
    )


def parse_probes(probes: DataFrame) -> DataFrame:
    return probes.withColumn("latency_ms", probe_latency("output"))


def valid_mean(latency: Column) -> Column:
    """Mean of the probes that succeeded, 0 if none did."""
    return F.coalesce(F.round(F.avg(F.when(latency > 0, latency)), 2), F.lit(0.0))


def mean_latency(probes: DataFrame) -> DataFrame:
    return parse_probes(probes).groupBy("agent_id").agg(valid_mean(F.col("latency_ms")).alias("latency_ms"))


def interface_addresses(interfaces: DataFrame, addresses: DataFrame) -> DataFrame:
    """Every interface with each of its addresses, interfaces without one included.

    The result stays flat, because a nested list per interface would grow without bound. An
    inner join plus the interfaces left over, so that an interface with very many addresses
    can be split over tasks.
    """
    matched = interfaces.join(addresses, "if_id")
    bare = interfaces.join(addresses.select("if_id").distinct(), "if_id", "left_anti")
    return matched.unionByName(bare, allowMissingColumns=True)


def nested_addresses(snapshots: DataFrame, interfaces: str = "interfaces") -> DataFrame:
    """The interfaces inside a snapshot with each of their addresses; no address reads NULL."""
    rows = snapshots.select("event_id", "agent_id", F.explode(interfaces).alias("i"))
    return rows.select("event_id", "agent_id", "i.name", "i.is_up", F.explode_outer("i.addresses").alias("a")).select(
        "event_id", "agent_id", "name", "is_up", F.col("a.family").alias("family"), F.col("a.address").alias("address"))


def address_counts(interfaces: DataFrame, addresses: DataFrame) -> DataFrame:
    counts = addresses.groupBy("if_id").agg(F.count("*").alias("addresses"))
    return interfaces.join(counts, "if_id", "left").withColumn("addresses", F.coalesce("addresses", F.lit(0)))


def connection_counts(connections: DataFrame) -> DataFrame:
    return connections.groupBy("host_id").agg(
        F.count("*").alias("connections"), F.count_if(F.col("status") == "ESTABLISHED").alias("established")
    )


def top_processes(processes: DataFrame, by: str, k: int = 10) -> DataFrame:
    """The ``k`` largest processes per agent; ties go to the lower pid. Ranked before the shuffle."""
    w = Window.partitionBy("agent_id").orderBy(F.desc(by), "pid")
    return (
        processes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        .withColumn("memory_mb", mib("rss_bytes")).drop("rss_bytes")
    )


def process_totals(processes: DataFrame) -> DataFrame:
    return processes.groupBy("agent_id").agg(F.count("*").alias("total_processes"))


def process_candidates(processes: DataFrame, exclusions: DataFrame, threshold: float = 90.0) -> DataFrame:
    """Processes above the CPU limit that are not excluded. Only reported, never killed."""
    hot = processes.where(F.col("cpu_percent") > threshold)
    return hot.join(exclusions, "pid", "left_anti").select("agent_id", "pid", "name", "cpu_percent")


def screen_scripts(scripts: DataFrame, phrases: list[str] = C.BLOCKED_PHRASES, allowed: bool = True) -> DataFrame:
    """Which scripts contain a dangerous phrase; none may run unless scripts are allowed."""
    text = F.lower("text")
    hits = [F.contains(text, F.lit(p)) for p in phrases]
    blocked = hits[0]
    for hit in hits[1:]:
        blocked = blocked | hit
    decision = F.when(F.lit(not allowed), "not_allowed").when(blocked, "blocked").otherwise("accepted")
    return scripts.select("script_id", decision.alias("decision"))


def service_counts(snapshots: DataFrame) -> DataFrame:
    return (
        snapshots.select(F.explode("health.service_status").alias("s"))
        .groupBy("s.name", "s.status").agg(F.count("*").alias("n"))
    )


def connectivity(snapshots: DataFrame) -> DataFrame:
    """Per tested host: mean of the valid probes and the number of failed ones."""
    rows = snapshots.select(F.explode("health.network_connectivity").alias("host", "latency"))
    latency = F.col("latency")
    return rows.groupBy("host").agg(
        F.avg(F.when(latency > 0, latency)).alias("latency_ms"), F.count_if(latency < 0).alias("failed"),
        F.count("*").alias("probes"),
    )


def device_io(snapshots: DataFrame) -> DataFrame:
    rows = snapshots.select("agent_id", F.explode("health.disk_health.io_stats").alias("device", "io"))
    return rows.groupBy("agent_id", "device").agg(
        F.max("io.read_bytes").alias("read_bytes"), F.max("io.write_bytes").alias("write_bytes")
    )


def mounts(snapshots: DataFrame) -> DataFrame:
    rows = snapshots.select("agent_id", F.explode("health.disk_health.mount_points").alias("m"))
    return rows.select("agent_id", "m.device", "m.mountpoint").distinct()


def log_levels(logs: DataFrame) -> DataFrame:
    return logs.groupBy("agent_id", "level").agg(F.count("*").alias("n"))


def load_and_uptime(snapshots: DataFrame) -> DataFrame:
    """The three load averages (0 when absent) and the uptime with its start time."""
    load = F.coalesce(F.col("health.load_average"), F.array(*[F.lit(0.0)] * 3))
    return snapshots.select(
        "event_id", "agent_id",
        *[F.try_element_at(load, F.lit(i)).alias(f"load_{name}") for i, name in ((1, "1m"), (2, "5m"), (3, "15m"))],
        F.col("health.uptime").alias("uptime"),
    )


def uptime(boot_seconds: Column, ts: str = "ts") -> Column:
    """Whole seconds since boot."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1000000.0) - boot_seconds).cast("bigint")

"""Schemas of the telemetry snapshot and of the stored tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STR, DBL, INT, BOOL = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()

PLATFORM = _struct(system=STR, node=STR, release=STR, machine=STR)
CPU = _struct(
    usage_percent=DBL, load_avg_1m=DBL, load_avg_5m=DBL, load_avg_15m=DBL, frequency_mhz=DBL,
    core_count=INT, context_switches=INT, interrupts=INT, user_time=DBL, system_time=DBL, idle_time=DBL,
)
MEMORY = _struct(
    total_mb=DBL, available_mb=DBL, used_mb=DBL, usage_percent=DBL, free_mb=DBL, cached_mb=DBL,
    buffers_mb=DBL, swap_total_mb=DBL, swap_used_mb=DBL, swap_usage_percent=DBL,
)
PARTITION = _struct(
    device=STR, mountpoint=STR, fstype=STR, total_gb=DBL, used_gb=DBL, free_gb=DBL, usage_percent=DBL,
)
DISK = _struct(
    usage_percent=DBL, total_gb=DBL, used_gb=DBL, free_gb=DBL, partitions=T.ArrayType(PARTITION),
    read_bytes_total=INT, write_bytes_total=INT, read_count=INT, write_count=INT,
    read_time_ms=INT, write_time_ms=INT,
    read_bytes_per_sec=DBL, write_bytes_per_sec=DBL, io_wait_percent=DBL,
)
ADDRESS = _struct(family=STR, address=STR, netmask=STR, broadcast=STR)
INTERFACE = _struct(name=STR, is_up=BOOL, duplex=STR, speed=INT, mtu=INT, addresses=T.ArrayType(ADDRESS))
NETWORK = _struct(
    bytes_sent_total=INT, bytes_recv_total=INT, packets_sent_total=INT, packets_recv_total=INT,
    errors_in=INT, errors_out=INT, drops_in=INT, drops_out=INT,
    bytes_sent_per_sec=DBL, bytes_recv_per_sec=DBL, packets_sent_per_sec=DBL, packets_recv_per_sec=DBL,
    connections_count=INT, established_connections=INT, interfaces=T.ArrayType(INTERFACE),
    latency_8_8_8_8=DBL, latency_1_1_1_1=DBL, latency_ms=DBL,
    packet_loss_percent=DBL, bandwidth_usage_percent=DBL,
)
PROCESS = _struct(
    pid=INT, name=STR, cpu_percent=DBL, memory_mb=DBL, memory_percent=DBL, status=STR, username=STR,
)
PROCESSES = _struct(top_cpu=T.ArrayType(PROCESS), top_memory=T.ArrayType(PROCESS), total_processes=INT)
SERVICE = _struct(name=STR, status=STR, timestamp=STR, error=STR)
DEVICE_IO = _struct(read_bytes=INT, write_bytes=INT, read_count=INT, write_count=INT, read_time=INT, write_time=INT)
MOUNT = _struct(device=STR, mountpoint=STR, fstype=STR, opts=STR)
HEALTH = _struct(
    uptime=INT, load_average=T.ArrayType(DBL), service_status=T.ArrayType(SERVICE),
    disk_health=_struct(
        io_stats=T.MapType(STR, DEVICE_IO), mount_points=T.ArrayType(MOUNT), disk_errors=T.ArrayType(STR)
    ),
    network_connectivity=T.MapType(STR, DBL),
)

# One telemetry message. Replies share the envelope and carry a type.
SNAPSHOT = _struct(
    type=STR, agent_id=STR, timestamp=STR, platform=PLATFORM,
    cpu_usage=DBL, memory_usage=DBL, disk_usage=DBL, network_latency=DBL,
    cpu=CPU, memory=MEMORY, disk=DISK, network=NETWORK, processes=PROCESSES, health=HEALTH,
    error=STR, is_anomaly=BOOL, anomaly_score=DBL, severity=STR,
)

# Stored tables.
TABLES = {
    "system_metrics": T.StructType([
        T.StructField("event_id", INT, False), T.StructField("agent_id", STR, False),
        T.StructField("ts", T.TimestampNTZType()), T.StructField("raw_data", STR),
    ]),
    "agents": T.StructType([
        T.StructField("agent_id", STR, False), T.StructField("hostname", STR), T.StructField("platform", STR),
        T.StructField("status", STR), T.StructField("first_connected", T.TimestampNTZType()),
        T.StructField("last_seen", T.TimestampNTZType()),
    ]),
    "agent_logs": T.StructType([
        T.StructField("agent_id", STR, False), T.StructField("ts", T.TimestampNTZType()),
        T.StructField("level", STR), T.StructField("message", STR),
    ]),
    "alerts": T.StructType([
        T.StructField("alert_id", STR, False), T.StructField("agent_id", STR, False),
        T.StructField("alert_type", STR), T.StructField("severity", STR), T.StructField("description", STR),
        T.StructField("status", STR), T.StructField("first_seen", T.TimestampNTZType()),
        T.StructField("last_seen", T.TimestampNTZType()),
    ]),
}


def create_tables(spark: SparkSession, location: str) -> None:
    """Create the stored tables as Parquet below ``location`` where they do not exist yet."""
    for name, schema in TABLES.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        if name == "system_metrics":
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, `date` date) USING parquet "
                      f"PARTITIONED BY (`date`) LOCATION '{location}/{name}'")
        else:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet LOCATION '{location}/{name}'")

"""From nested snapshots to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.units import in_section

HEADLINE = {
    "cpu_usage": ("cpu", "usage_percent"),
    "memory_usage": ("memory", "usage_percent"),
    "disk_usage": ("disk", "usage_percent"),
    "network_latency": ("network", "latency_ms"),
}

# Slots of the feature vectors: name, section, key.
SYSTEM_SLOTS = [
    ("cpu_usage", "cpu", "usage_percent"),
    ("load_1m", "cpu", "load_avg_1m"),
    ("load_5m", "cpu", "load_avg_5m"),
    ("context_switches", "cpu", "context_switches"),
    ("memory_usage", "memory", "usage_percent"),
    ("memory_available", "memory", "available_mb"),
    ("swap_usage", "memory", "swap_usage_percent"),
    ("disk_usage", "disk", "usage_percent"),
    ("disk_read_rate", "disk", "read_bytes_per_sec"),
    ("disk_write_rate", "disk", "write_bytes_per_sec"),
    ("io_wait", "disk", "io_wait_percent"),
]
NETWORK_SLOTS = [
    ("latency", "network", "latency_ms"),
    ("packet_loss", "network", "packet_loss_percent"),
    ("bandwidth_usage", "network", "bandwidth_usage_percent"),
    ("connections", "network", "connections_count"),
    ("sent_rate", "network", "bytes_sent_per_sec"),
    ("received_rate", "network", "bytes_recv_per_sec"),
]


def detector_values(df: DataFrame) -> DataFrame:
    """The four detector inputs as columns; NULL where a section is absent."""
    return df.withColumns({name: in_section(*path) for name, path in HEADLINE.items()})


def headline(df: DataFrame) -> DataFrame:
    """The four headline values shown to readers: absent or failed collection reads 0."""
    def value(section: str, key: str) -> Column:
        lifted = F.coalesce(F.col(f"{section}.{key}"), F.lit(0.0))
        return F.when(F.col("error").isNotNull(), 0.0).otherwise(lifted)

    return df.withColumns({name: value(*path) for name, path in HEADLINE.items()})


def platform_columns(df: DataFrame) -> DataFrame:
    return df.select("event_id", "ts", "agent_id", "platform.*")


# Columns of a stored metric row inside its JSON text: type and default.
STORED = {
    **{name: ("double", 0.0) for name in HEADLINE},
    "is_anomaly": ("boolean", False), "anomaly_score": ("double", 0.0), "severity": ("string", "normal"),
}


def stored_metrics(df: DataFrame, raw: str = "raw_data") -> DataFrame:
    """Seven typed columns out of the stored JSON, parsed once, each with its default."""
    doc = F.from_json(raw, ", ".join(f"{name} {kind}" for name, (kind, _) in STORED.items()))
    return df.withColumn("_doc", doc).withColumns({
        name: F.coalesce(F.col(f"_doc.{name}"), F.lit(default)) for name, (_, default) in STORED.items()
    }).drop("_doc")


def feature_columns(df: DataFrame, slots: list[tuple[str, str, str]]) -> DataFrame:
    """One column per slot; all NULL when any needed section is absent.

    A slot whose key the schema does not carry is 0, as for a missing key.
    """
    sections = sorted({section for _, section, _ in slots})
    complete = F.lit(True)
    for section in sections:
        complete = complete & F.col(section).isNotNull()
    known = {s: set(df.schema[s].dataType.fieldNames()) for s in sections}

    def slot(section: str, key: str) -> Column:
        value = F.coalesce(F.col(f"{section}.{key}").cast("double"), F.lit(0.0)) if key in known[section] else F.lit(0.0)
        return F.when(complete, value)

    return df.withColumns({name: slot(section, key) for name, section, key in slots})


def system_features(df: DataFrame) -> DataFrame:
    return feature_columns(df, SYSTEM_SLOTS)


def network_features(df: DataFrame) -> DataFrame:
    return feature_columns(df, NETWORK_SLOTS)

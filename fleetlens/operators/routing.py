"""Routing of incoming messages and the envelopes sent out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.text import iso


def message_route(kind: str | Column) -> Column:
    """Messages without a type are telemetry; known replies and commands keep their name."""
    column = F.col(kind) if isinstance(kind, str) else kind
    return (
        F.when(column.isNull() | (column == "telemetry"), "telemetry")
        .when(column.isin(C.REPLY_TYPES + C.COMMAND_TYPES), column)
        .otherwise("quarantine")
    )


def route_messages(messages: DataFrame, kind: str = "msg_type") -> dict[str, DataFrame]:
    """One filtered branch per destination."""
    routed = messages.withColumn("route", message_route(kind))
    known = F.col("route").isin(C.REPLY_TYPES)
    return {
        "telemetry": routed.where(F.col("route") == "telemetry"),
        "replies": routed.where(known),
        "commands": routed.where(F.col("route").isin(C.COMMAND_TYPES)),
        "quarantine": routed.where(F.col("route") == "quarantine"),
    }


def anomaly_envelopes(lists: DataFrame) -> DataFrame:
    """One message per snapshot with all its anomalies, which arrive as an array."""
    body = F.struct(F.lit("anomaly_detected").alias("type"), "agent_id", "anomalies", iso("ts").alias("timestamp"))
    return lists.select("event_id", "agent_id", F.to_json(body).alias("message"))


def metric_envelopes(df: DataFrame, metrics: list[str]) -> DataFrame:
    body = F.struct(
        F.lit("metrics_update").alias("type"), "agent_id", F.struct(*metrics).alias("metrics"), iso("ts").alias("timestamp")
    )
    return df.select("event_id", "agent_id", F.to_json(body).alias("message"))


def critical_envelopes(issues: DataFrame) -> DataFrame:
    """One message per agent with critical issues on its latest snapshot."""
    item = F.struct("component", "issue", "value", "impact")
    grouped = (
        issues.where(F.col("level") == "critical").groupBy("agent_id", "ts")
        .agg(F.sort_array(F.collect_list(item)).alias("issues"))
    )
    body = F.struct(F.lit("critical_alert").alias("type"), "agent_id", "issues", iso("ts").alias("timestamp"))
    return grouped.select("agent_id", F.size("issues").alias("n_issues"), F.to_json(body).alias("message"))

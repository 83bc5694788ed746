"""Agent registry, liveness and command dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.text import iso
from fleetlens.sources.tables import constant_table


def agent_snapshot(conn_events: DataFrame, platforms: DataFrame | None = None, previous: DataFrame | None = None) -> DataFrame:
    """Registry rows from connects, merged into ``previous`` when given.

    ``platforms`` (agent_id, hostname, platform) names the host; without it the host name
    is the agent id and the platform unknown.
    """
    seen = conn_events.where(F.col("kind") == "connect").groupBy("agent_id").agg(
        F.min("ts").alias("first_connected"), F.max("ts").alias("last_seen")
    )
    if platforms is not None:
        seen = seen.join(platforms, "agent_id", "left")
    else:
        seen = seen.withColumns({"hostname": F.lit(None).cast("string"), "platform": F.lit(None).cast("string")})
    seen = seen.withColumn("status", F.lit("healthy"))
    if previous is not None:
        old = previous.select("agent_id", *[F.col(c).alias(f"_{c}") for c in previous.columns if c != "agent_id"])
        seen = seen.join(old, "agent_id", "full_outer").withColumns({
            "first_connected": F.least("first_connected", "_first_connected"),
            "last_seen": F.greatest("last_seen", "_last_seen"),
            "hostname": F.coalesce("hostname", "_hostname"),
            "platform": F.coalesce("platform", "_platform"),
            "status": F.coalesce("status", "_status"),
        })
    return seen.select(
        "agent_id", F.coalesce("hostname", F.col("agent_id").cast("string")).alias("hostname"),
        F.coalesce("platform", F.lit("Unknown")).alias("platform"), "status", "first_connected", "last_seen",
    )


def agent_listing(agents: DataFrame) -> DataFrame:
    return agents.select("agent_id", "hostname", "platform", "status", iso("last_seen").alias("last_seen"))


def connected(conn_events: DataFrame) -> DataFrame:
    """Agents whose last connection event is a connect."""
    last = conn_events.groupBy("agent_id").agg(
        F.max_by("kind", F.struct("ts", "event_id")).alias("kind"), F.max("ts").alias("since")
    )
    return last.where(F.col("kind") == "connect").select("agent_id", "since")


def liveness(telemetry: DataFrame, asof: Column, missed: int = 3) -> DataFrame:
    """Offline once no snapshot arrived for ``missed`` intervals before ``asof``."""
    limit = F.expr(f"INTERVAL {missed * C.SNAPSHOT_INTERVAL_S} SECONDS")
    last = telemetry.groupBy("agent_id").agg(F.max("ts").alias("last_seen"))
    return last.withColumn("status", F.when(F.col("last_seen") < asof - limit, "offline").otherwise("healthy"))


def deliverable(commands: DataFrame, online: DataFrame) -> DataFrame:
    return commands.join(online.select("agent_id"), "agent_id", "left_semi")


def undeliverable(commands: DataFrame, online: DataFrame) -> DataFrame:
    return commands.join(online.select("agent_id"), "agent_id", "left_anti")


def command_envelopes(commands: DataFrame) -> DataFrame:
    """Outbox messages: a restart without an issue, otherwise a remediation of that issue."""
    kind = F.when(F.col("issue_type").isNull(), "restart").otherwise("remediate")
    body = F.struct(kind.alias("type"), "issue_type", iso("ts").alias("timestamp"))
    return commands.select("event_id", "agent_id", F.to_json(body).alias("message"))


def _script_paths(commands: DataFrame, agents: DataFrame) -> DataFrame:
    spark = commands.sparkSession
    keys = constant_table(spark, C.ISSUE_SCRIPTS, "issue_type string, script_key string")
    paths = constant_table(spark, C.SCRIPT_PATHS, "script_key string, os string, script_path string")
    hosts = agents.select("agent_id", F.lower("platform").alias("os"))
    return (
        commands.join(hosts, "agent_id", "left")
        .join(F.broadcast(keys), "issue_type", "left")
        .join(F.broadcast(paths), ["script_key", "os"], "left")
    )


def script_lookup(commands: DataFrame, agents: DataFrame) -> DataFrame:
    """The script to run per command, by issue and by the operating system of its agent."""
    found = _script_paths(commands, agents).where(F.col("script_path").isNotNull())
    return found.select("event_id", "agent_id", "issue_type", "script_key", "os", "script_path")


def script_missing(commands: DataFrame, agents: DataFrame) -> DataFrame:
    """Commands for which no script exists."""
    missing = _script_paths(commands, agents).where(F.col("script_path").isNull())
    return missing.select("event_id", "agent_id", "issue_type", "os")


def fleet_status(agents: DataFrame, online: DataFrame, dashboards: DataFrame, anomalies: DataFrame,
                 health: DataFrame, asof: Column) -> DataFrame:
    """One row for the fleet: connected clients, healthy agents, anomalies of the last 24 hours, worst health."""
    recent = F.col("ts") > asof - F.expr("INTERVAL 24 HOURS")
    has = {level: F.bool_or(F.col("status") == level) for level in ("critical", "warning")}
    worst = F.when(has["critical"], "critical").when(has["warning"], "warning").otherwise("healthy")
    return agents.agg(
        F.count("*").alias("agents"), F.count_if(F.col("status") == "healthy").alias("healthy_agents")
    ).select(
        "*",
        (F.col("healthy_agents") / F.nullif("agents", F.lit(0)) * 100).alias("healthy_share"),
        online.agg(F.count("*")).scalar().alias("connected_agents"),
        dashboards.agg(F.count("*")).scalar().alias("active_dashboards"),
        anomalies.where(recent).agg(F.count("*")).scalar().alias("anomalies_24h"),
        health.agg(worst).scalar().alias("system_health"),
    )

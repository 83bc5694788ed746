"""Streaming jobs. Each takes a stream and a folder for its output and its checkpoint."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.operators import agents, alerts, detect, flatten, forest, health, routing
from fleetlens.sources.tables import corrupt, decode
from fleetlens.streaming.state import (
    REPEAT, Versions, count_hours, drop_repeats, each_batch, find_patterns, follow_alerts, in_order, late_rows, per_hour,
    send_all_anomalies,
)

ALL_NOW = {"availableNow": True}
EVERY_30_S = {"processingTime": "30 seconds"}
PAUSE_AFTER_ERROR_S = 60
EVERY_5_S = {"processingTime": "5 seconds"}


def append_table(stream: DataFrame, path: str, trigger: dict, partition: str | None = None) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/_job")
    if partition:
        writer = writer.partitionBy(partition)
    return writer.option("path", f"{path}/rows").trigger(**trigger).start()


def land_raw(stream: DataFrame, path: str, trigger: dict = EVERY_30_S) -> StreamingQuery:
    """Append every message, late ones too, partitioned by day."""
    return append_table(stream.withColumn("date", F.to_date("ts")), path, trigger, "date")


def detect_thresholds(telemetry: DataFrame, path: str, trigger: dict = EVERY_30_S) -> StreamingQuery:
    """Stateless detection with advice, straight on the stream."""
    return append_table(detect.with_remediation(detect.threshold_anomalies(telemetry)), path, trigger)


def messages(stream: DataFrame) -> DataFrame:
    """Decoded messages with their own time and an id made from their text; unreadable ones keep only the text.

    ``event_id`` breaks ties in time and finds repeats: equal messages have equal ids.
    """
    doc = decode(stream, "value")
    return doc.select(
        F.xxhash64("value").alias("event_id"), F.to_timestamp_ntz("doc.timestamp").alias("ts"), "value",
        (corrupt() | F.col("doc.timestamp").try_cast("timestamp_ntz").isNull()).alias("unreadable"), "doc.*",
    )


def detect_messages(stream: DataFrame, path: str, trigger: dict = EVERY_30_S) -> StreamingQuery:
    """From message text to anomalies: decode, quarantine, route, land, detect. One write per table and batch."""
    def step(batch: DataFrame, number: int) -> None:
        rows = messages(batch)
        branches = routing.route_messages(rows.where("NOT unreadable"), "type")
        unread = rows.where("unreadable").select("value")
        unread = unread.unionByName(branches["quarantine"].select("value"))
        values = flatten.detector_values(branches["telemetry"])
        tables = {
            "quarantine": unread,
            "replies": branches["replies"].select("event_id", "ts", "agent_id", "route", "value"),
            "commands": branches["commands"].select("event_id", "ts", "agent_id", "route", "value"),
            "landed": branches["telemetry"].select("event_id", "ts", "agent_id", "value"),
            "anomalies": detect.with_remediation(detect.threshold_anomalies(values)),
        }
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return each_batch(stream, step, path, trigger)


def telemetry_of(stream: DataFrame) -> DataFrame:
    """Snapshots out of message text, with their own time: what can be read and is telemetry. Replies, commands and the rest stay out."""
    rows = messages(stream).where("NOT unreadable")
    return routing.route_messages(rows, "type")["telemetry"].select("event_id", "ts", "agent_id", "cpu", "memory", "disk", "network")


def detect_all_in_messages(stream: DataFrame, path: str, prepare: Callable[[DataFrame], DataFrame], forests: list[tuple[str, tuple, float]],
                           trigger: dict = EVERY_30_S, lateness_s: int = 600) -> StreamingQuery:
    """From message text to the anomalies of all four detectors (see ``state.send_all_anomalies``), in the order of the messages' own times."""
    return in_order(telemetry_of(stream), path, send_all_anomalies(path, prepare, forests), trigger, lateness_s)


def fan_out(telemetry: DataFrame, metrics: list[str], path: str, trigger: dict = EVERY_30_S) -> list[StreamingQuery]:
    """The two message feeds: anomalies per snapshot, and the metric values of every snapshot."""
    feeds = {
        "anomalies": routing.anomaly_envelopes(detect.threshold_lists(telemetry)),
        "metrics": routing.metric_envelopes(telemetry, metrics),
    }
    return [append_table(rows, f"{path}/{name}", trigger) for name, rows in feeds.items()]


def detect_patterns(telemetry: DataFrame, path: str, trigger: dict = EVERY_30_S, lateness_s: int = 600) -> StreamingQuery:
    """CPU jumps and memory leaks, by the batch operator on rows in order (see ``state.in_order``)."""
    rows = telemetry.select("event_id", "ts", "agent_id", "cpu_usage", "memory_usage")
    return in_order(rows, path, find_patterns(path), trigger, lateness_s)


def detect_with_saved_forest(telemetry: DataFrame, model: str, path: str, kind: str, description: str, action: str,
                             high_below: float, trigger: dict = EVERY_30_S) -> StreamingQuery:
    """Score each micro-batch with the forest last saved under ``model``; a batch job refits it, under another path."""
    held: list = []

    def score(batch: DataFrame, number: int) -> None:
        if not held:  # a saved forest never changes, so it is read once
            held.append(forest.load_forest(batch.sparkSession, model))
        nodes, offset, features = held[0]
        decided = forest.decide(forest.score_forest(batch, nodes, features), offset)
        found = forest.forest_anomalies(decided, kind, description, action, high_below)
        found.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    return each_batch(telemetry, score, path, trigger)


def track_alerts(events: DataFrame, path: str, trigger: dict = EVERY_30_S, lateness_s: int = 600) -> StreamingQuery:
    """Alert episodes: closed ones are appended, open ones kept as a table of one row per type and agent; notifications are appended."""
    return in_order(events, path, follow_alerts(path), trigger, lateness_s)


def track_alerts_purged(events: DataFrame, path: str, trigger: dict = EVERY_30_S, lateness_s: int = 600, keep_hours: int = 24) -> StreamingQuery:
    """As ``track_alerts``, but alerts resolved longer ago than ``keep_hours`` leave the state (see ``kept_alerts``)."""
    return in_order(events, path, follow_alerts(path, keep_hours), trigger, lateness_s)


def kept_alerts(spark: SparkSession, path: str, asof: Column, keep_hours: int = 24) -> DataFrame:
    """Open alerts, and those resolved within ``keep_hours`` before ``asof``, which is no earlier than the stream has come."""
    versions = Versions(spark, path)
    every = versions.newest("resolved").unionByName(alerts.open_episodes(versions.newest("open")))
    return alerts.purge(every, asof, keep_hours)


def tracked_alerts(spark: SparkSession, path: str) -> DataFrame:
    """All episodes that ``track_alerts`` has seen, open and closed."""
    return spark.read.parquet(f"{path}/closed").drop("batch").unionByName(alerts.open_episodes(Versions(spark, path).newest("open")))


def keep_latest(telemetry: DataFrame, path: str, trigger: dict = EVERY_5_S) -> StreamingQuery:
    """A table with the newest snapshot per agent, rewritten by every batch as a new version."""
    def upsert(batch: DataFrame, number: int) -> None:
        merge(batch, number, path, health.latest_per_agent)

    return each_batch(telemetry, upsert, path, trigger)


def keep_registry(conn_events: DataFrame, path: str, trigger: dict = EVERY_30_S) -> StreamingQuery:
    """The agent registry, with the connects of every batch merged in."""
    def upsert(batch: DataFrame, number: int) -> None:
        versions = Versions(batch.sparkSession, path)
        last, _ = versions.pointer(number)
        versions.write("rows", number, agents.agent_snapshot(batch, None, versions.read("rows", last)))
        versions.point(number)

    return each_batch(conn_events, upsert, path, trigger)


def merge(batch: DataFrame, number: int, path: str, reduce_rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Version ``number`` from the version before it; running a batch again gives the same version."""
    versions = Versions(batch.sparkSession, path)
    last, _ = versions.pointer(number)
    before = versions.read("rows", last)
    rows = reduce_rows(batch)
    if before is not None:
        rows = reduce_rows(before.unionByName(rows))
    merged = versions.write("rows", number, rows)
    versions.point(number)
    return merged


def newest_version(spark: SparkSession, path: str) -> DataFrame:
    """The last complete version of a kept table, also while the stream is idle or has ended."""
    return Versions(spark, path).newest("rows")


def anomalies_last_day(anomalies: DataFrame, path: str, trigger: dict = EVERY_30_S, lateness_s: int = 600) -> StreamingQuery:
    """Anomalies per hour; ``last_day`` adds up 24 of them. Later anomalies go to the table ``late`` (see ``hours_counted``)."""
    return in_order(anomalies.select("event_id", "ts", "agent_id", "type"), path, count_hours(path), trigger, lateness_s)


def hours_counted(spark: SparkSession, path: str) -> DataFrame:
    """All counts per hour that ``anomalies_last_day`` has made, and those of the anomalies that came later than allowed."""
    counted = spark.read.parquet(f"{path}/rows").drop("batch")
    late = late_rows(spark, path, "event_id bigint, ts timestamp_ntz, agent_id bigint, type string")
    return counted.unionByName(per_hour(late.where("ts IS NOT NULL")))


def watermark(spark: SparkSession, path: str) -> str:
    """Up to when the rows of a stream in order are complete, as text; late rows aside."""
    until = Versions(spark, path).pointer()[1]
    return spark.range(1).select(F.timestamp_micros(F.lit(until)).cast("string")).first()[0]


def last_day(hours: DataFrame, until: str) -> DataFrame:
    """Anomalies within the last 24 hours, at every full hour up to the watermark ``until``; hours may lack anomalies of their own."""
    later = F.explode(F.sequence(F.lit(0), F.lit(23)))
    spread = hours.select("hour_end", "n", later.alias("h")).select(
        (F.col("hour_end") + F.make_dt_interval(hours=F.col("h"))).alias("hour_end"), "n")
    return spread.groupBy("hour_end").agg(F.sum("n").alias("n")).where(F.col("hour_end") <= F.lit(until).cast("timestamp"))


def keep_once(telemetry: DataFrame, path: str, trigger: dict = EVERY_30_S, lateness_s: int = 600) -> StreamingQuery:
    """Every snapshot once, whatever the number of its repeats; later rows go to the table ``late`` (see ``kept_once``)."""
    return in_order(telemetry, path, drop_repeats(path), trigger, lateness_s)


def kept_once(spark: SparkSession, path: str) -> DataFrame:
    """What ``keep_once`` has kept, and the snapshots of which all rows came later than allowed, once too."""
    kept = spark.read.parquet(f"{path}/rows").drop("batch")
    late = late_rows(spark, path, kept.schema).dropDuplicates(REPEAT)
    again = [late[c].eqNullSafe(kept[c]) for c in REPEAT]
    return kept.unionByName(late.join(kept, again, "left_anti"))


def critical_feed(telemetry: DataFrame, path: str, trigger: dict = EVERY_30_S, pause_s: float = PAUSE_AFTER_ERROR_S) -> StreamingQuery:
    """Messages on critical issues of the latest snapshot of every agent so far, checked with every batch.

    A failed check is tried once more after a pause, then fails the batch.
    """
    def check(batch: DataFrame, number: int) -> None:
        latest = merge(batch, number, path, health.latest_per_agent)
        envelopes = routing.critical_envelopes(health.health_issues(latest))
        envelopes.write.mode("overwrite").parquet(f"{path}/checks/batch={number}")

    def patient(batch: DataFrame, number: int) -> None:
        try:
            check(batch, number)
        except Exception:
            time.sleep(pause_s)
            check(batch, number)

    return each_batch(telemetry, patient, path, trigger)


def newest_check(spark: SparkSession, path: str) -> DataFrame:
    """The messages of the last complete check."""
    return spark.read.parquet(f"{path}/checks/batch={Versions(spark, path).pointer()[0]}")

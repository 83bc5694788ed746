"""State of a stream as small tables: one version per micro-batch, and a pointer to the last one that is complete.

A batch reads the version of the batch before it and writes its own, so a batch that runs again gives the same tables.
The pointer is a one-row table per batch, written last; readers take the newest one. Old versions are overwritten in turn.

``in_order`` gives rows to the batch operators in the order of their time, however they arrive: rows wait until no row
that is in time can come before them. Rows that come later than the allowed lateness, and rows without time, go to a table of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.operators import alerts, detect, forest, report, routing
from fleetlens.operators.slices import micros
from fleetlens.session import written

KEPT_VERSIONS = 4
HISTORY = 20
REPEAT = ["agent_id", "ts", "event_id"]  # equal in a snapshot that arrives again
LATENESS_S = 600


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], path: str, trigger: dict,
               mode: str = "append") -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write).outputMode(mode)
        .option("checkpointLocation", f"{path}/_job").trigger(**trigger).start()
    )


class Versions:
    """Tables below ``path``, a version of each per batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _slot(self, name: str, number: int) -> str:
        return f"{self.path}/{name}/v{number % KEPT_VERSIONS}"

    def read(self, name: str, number: int) -> DataFrame | None:
        return None if number < 0 else self.spark.read.parquet(self._slot(name, number))

    def write(self, name: str, number: int, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(self._slot(name, number))
        return self.read(name, number)

    def point(self, number: int, watermark: int | None = None) -> None:
        """Declare version ``number`` complete."""
        row = self.spark.createDataFrame([(number, watermark)], "batch bigint, watermark bigint").coalesce(1)
        row.write.mode("overwrite").parquet(f"{self.path}/_pointer/p{number % KEPT_VERSIONS}")

    def pointer(self, before: int | None = None) -> tuple[int, int | None]:
        """The last complete version (below ``before``) and its watermark; (-1, None) if there is none."""
        try:
            rows = self.spark.read.schema("batch bigint, watermark bigint").parquet(f"{self.path}/_pointer/p*")
        except AnalysisException:
            return -1, None
        found = rows.where(F.lit(True) if before is None else F.col("batch") < before).agg(F.max(F.struct("batch", "watermark")).alias("p"))
        last = found.first()["p"]
        return (-1, None) if last is None else (last["batch"], last["watermark"])

    def newest(self, name: str) -> DataFrame | None:
        return self.read(name, self.pointer()[0])


def in_order(stream: DataFrame, path: str, process: Callable[[DataFrame, int, int | None, Versions], None],
             trigger: dict, lateness_s: int = LATENESS_S) -> StreamingQuery:
    """Call ``process(rows, batch, since, versions)`` with rows whose time is complete; ``since`` bounds their times from below.

    Rows wait in a table for ``lateness_s`` seconds of event time. Rows that are later still are appended to ``late``,
    and so are rows without time, which have no place in the order.
    """
    spark = stream.sparkSession
    versions = Versions(spark, path)

    def step(batch: DataFrame, number: int) -> None:
        before, since = versions.pointer(number)
        batch = versions.write("batch", number, batch)  # read several times below, and decoded once
        at = micros("ts")
        arrived = batch.where(at.isNotNull() if since is None else at >= since)
        late = batch.where(at.isNull() if since is None else at.isNull() | (at < since))
        late.write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        waiting = versions.read("waiting", before)
        rows = arrived if waiting is None else waiting.unionByName(arrived)
        newest = batch.agg(F.max(at)).first()[0]
        until = max(since or 0, (newest or 0) - lateness_s * 1_000_000)
        process(rows.where(at < until), number, since, versions)
        versions.write("waiting", number, rows.where(at >= until))
        versions.point(number, until)

    return each_batch(stream, step, path, trigger)


def finish(spark: SparkSession, path: str, process: Callable[[DataFrame, int, int | None, Versions], None]) -> None:
    """Process the rows that still wait, once a stream has ended."""
    versions = Versions(spark, path)
    last, since = versions.pointer()
    waiting = versions.read("waiting", last)
    if waiting is not None:
        process(waiting, last + 1, since, versions)
        versions.write("waiting", last + 1, waiting.limit(0))
        versions.point(last + 1, since)


def late_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """What came too late to be processed."""
    try:
        return spark.read.parquet(f"{path}/late").drop("batch")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def find_patterns(path: str):
    """The pattern detectors over rows in order, with the last rows of every agent carried from batch to batch."""
    def process(rows: DataFrame, number: int, since: int | None, versions: Versions) -> None:
        last, _ = versions.pointer(number)
        tail = versions.read("tail", last)
        both = rows if tail is None else tail.unionByName(rows)
        found = detect.pattern_anomalies(both)
        if since is not None:
            found = found.where(micros("ts") >= since)  # what the tail gave was found before
        found.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        versions.write("tail", number, report.newest_per_agent(both, HISTORY - 1).drop("rank"))

    return process


def drop_repeats(path: str):
    """Every snapshot once. Repeats have equal times, so those in time are processed together."""
    def process(rows: DataFrame, number: int, since: int | None, versions: Versions) -> None:
        rows.dropDuplicates(REPEAT).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    return process


def per_hour(rows: DataFrame) -> DataFrame:
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")) + F.make_dt_interval(hours=F.lit(1))
    return rows.groupBy(hour.alias("hour_end")).agg(F.count("*").alias("n"))


def count_hours(path: str):
    """Rows per hour; an hour whose rows are processed in several batches has a count for each."""
    def process(rows: DataFrame, number: int, since: int | None, versions: Versions) -> None:
        per_hour(rows).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    return process


def send_all_anomalies(path: str, prepare: Callable[[DataFrame], DataFrame], forests: list[tuple[str, tuple, float]]):
    """One message per snapshot with all its anomalies: thresholds, patterns and those of the saved forests.

    ``prepare`` adds the detector values and features to snapshots; it sees the last rows of every agent too, so values may
    depend on the snapshot before. ``forests`` lists where a forest is saved, what it finds (type, text, action), and
    the decision below which its severity is high.
    """
    loaded: list = []

    def process(rows: DataFrame, number: int, since: int | None, versions: Versions) -> None:
        if not loaded:
            loaded.extend(forest.load_forest(rows.sparkSession, model) for model, _, _ in forests)
        last, _ = versions.pointer(number)
        tail = versions.read("tail", last)
        both = rows if tail is None else tail.unionByName(rows)
        values = written(prepare(both), "stream-values")  # read by every detector
        found = detect.all_anomalies(values)
        for (nodes, offset, features), (_, kind, high_below) in zip(loaded, forests):
            decided = forest.decide(forest.score_forest(values, nodes, features), offset)
            found = found.unionByName(forest.forest_anomalies(decided, *kind, high_below))
        if since is not None:
            found = found.where(micros("ts") >= since)
        record = F.struct("type", "severity", "score", "value", "threshold", "description", "suggested_action")
        lists = found.groupBy(*detect.IDS).agg(F.sort_array(F.collect_list(record)).alias("anomalies"))
        routing.anomaly_envelopes(lists).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        versions.write("tail", number, report.newest_per_agent(both, HISTORY - 1).drop("rank"))

    return process


def follow_alerts(path: str, keep_hours: int | None = None):
    """Alert episodes and notifications over anomalies and resolutions in order, with the open alerts carried from batch to batch.

    Closed episodes are appended for ever, or, with ``keep_hours``, are a table of those not resolved more than
    that many hours of event time before the rows of the batch.
    """
    def process(rows: DataFrame, number: int, since: int | None, versions: Versions) -> None:
        last, _ = versions.pointer(number)
        closed, state, notices = alerts.continue_episodes(
            rows.where("resolve = 0").drop("resolve"), rows.where("resolve = 1").select("event_id", "ts", "agent_id", "type"),
            versions.read("open", last))
        versions.write("open", number, state)
        if keep_hours is None:
            closed.write.mode("overwrite").parquet(f"{path}/closed/batch={number}")
        else:
            resolved = versions.read("resolved", last)
            resolved = closed if resolved is None else resolved.unionByName(closed)
            if since is not None:
                resolved = alerts.purge(resolved, F.timestamp_micros(F.lit(since)).cast("timestamp_ntz"), keep_hours)
            versions.write("resolved", number, resolved)
        notices.write.mode("overwrite").parquet(f"{path}/notifications/batch={number}")

    return process

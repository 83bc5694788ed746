"""Which agents fall silent and return, on a stream: a silence has no message, so a timer per agent reports it.

Snapshots of an agent are kept as runs without a silence in between: two numbers each, not rows. A run that is reported
and over is dropped, so an agent has one value of state, with as many runs as silences fit into the lateness, and an agent that
stays silent has none. A change is reported once the watermark has passed it, so it never has to be taken back, and does
not depend on how rows are dealt to batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from fleetlens import constants as C
from fleetlens.operators.slices import micros
from fleetlens.streaming.jobs import EVERY_30_S, append_table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "online boolean, starts array<bigint>, ends array<bigint>"
CHANGES = "agent_id bigint, status string, since bigint, last_seen bigint"


def runs_of(times: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Times as (first, last) of the runs in which no two neighbours lie more than ``limit`` apart."""
    times = np.sort(times)
    if not len(times):
        return []
    breaks = np.flatnonzero(np.diff(times) > limit)
    return list(zip(times[np.r_[0, breaks + 1]].tolist(), times[np.r_[breaks, len(times) - 1]].tolist()))


def joined(runs: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """Runs in order, those at most ``limit`` apart as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start - out[-1][1] <= limit:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def settled(online: bool, runs: list[tuple[int, int]], until: int, limit: int):
    """The changes before ``until`` (status, since, last seen), and what is left: (online, runs)."""
    changes, runs = [], list(runs)
    while runs:
        start, end = runs[0]
        if not online:
            if start >= until:
                break
            changes.append(("online", start, start))
            online = True
        if end + limit >= until:
            break
        changes.append(("offline", end + limit, end))
        online = False
        runs.pop(0)
    return changes, online, runs


class Watch(StatefulProcessor):
    """Runs and one timer per agent. Times are microseconds since the epoch."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("runs", STATE)

    def _settle(self, key, runs: list[tuple[int, int]], online: bool, until: int, late: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        changes, online, runs = settled(online, joined(runs, self.limit), until, self.limit)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if runs:
            self.state.update((online, [s for s, _ in runs], [e for _, e in runs]))
            due = runs[0][1] + self.limit if online else runs[0][0]
            self.handle.registerTimer(due // 1000 + 1)
        else:
            self.state.clear()
        changes += [("late", start, end) for start, end in late]
        if changes:
            frame = pd.DataFrame(changes, columns=["status", "since", "last_seen"])
            frame.insert(0, "agent_id", key[0])
            yield frame

    def _held(self) -> tuple[bool, list[tuple[int, int]]]:
        if not self.state.exists():
            return False, []
        online, starts, ends = self.state.get()
        return online, list(zip(starts, ends))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        until = max(timerValues.getCurrentWatermarkInMs(), 0) * 1000
        online, runs = self._held()
        late: list[tuple[int, int]] = []
        for batch in rows:
            at = batch["at"].to_numpy()
            runs = joined(runs + runs_of(at[at >= until], self.limit), self.limit)
            late = joined(late + runs_of(at[at < until], self.limit), self.limit)
        yield from self._settle(key, runs, online, until, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        online, runs = self._held()
        yield from self._settle(key, runs, online, timerValues.getCurrentWatermarkInMs() * 1000, [])

    def close(self) -> None:
        pass


def watch_liveness(telemetry: DataFrame, path: str, missed: int = 3, trigger: dict = EVERY_30_S, lateness_s: int = 600) -> StreamingQuery:
    """Append a row per change: ``online`` since the first snapshot after a silence, ``offline`` since ``missed`` intervals after the last.

    ``last_seen`` is the snapshot that the change follows from. Snapshots that come later than ``lateness_s`` change nothing; they
    are reported as runs with status ``late``. Snapshots without time say nothing on liveness and are left out; so are those without agent.
    """
    telemetry.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    seen = telemetry.where("ts IS NOT NULL AND agent_id IS NOT NULL").withColumn("clock", F.col("ts").cast("timestamp"))
    # The operator must see late rows, so the column of the watermark does not reach it.
    rows = seen.withWatermark("clock", f"{lateness_s} seconds").select(F.col("agent_id").cast("bigint").alias("agent_id"), micros("ts").alias("at"))
    changes = rows.groupBy("agent_id").transformWithStateInPandas(
        Watch(missed * C.SNAPSHOT_INTERVAL_S * 1_000_000), CHANGES, "Append", "EventTime")
    time = [F.timestamp_micros(c).cast("timestamp_ntz").alias(c) for c in ("since", "last_seen")]
    return append_table(changes.select("agent_id", "status", *time), path, trigger)

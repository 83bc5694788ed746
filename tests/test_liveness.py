"""Agents that fall silent and return, from a stream in several batches."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.session import shared_dir
from fleetlens.streaming import jobs, liveness
from fleetlens.streaming.sources import table_stream

LIMIT_S = 90  # three intervals
START = datetime.datetime(2024, 3, 1)


def run(spark, batches, lateness_s):
    """Changes found on files of (agent, second), one per batch."""
    path, out = shared_dir(spark, "silent"), shared_dir(spark, "changes")

    def write(number, rows):
        df = spark.createDataFrame([(a, s) for a, s in rows], "agent_id bigint, s double")
        df = df.select("agent_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint") + int(START.replace(tzinfo=datetime.UTC).timestamp()) * 1_000_000)
                       .cast("timestamp_ntz").alias("ts"))
        df.coalesce(1).write.parquet(f"{path}/{number:02d}")
        return df.schema

    for number, rows in enumerate(batches):
        schema = write(number, rows)
        # One stream per file, over one checkpoint: every file is a batch, and every batch a restart.
        jobs_stream = table_stream(spark, f"{path}/*", schema)
        liveness.watch_liveness(jobs_stream, out, 3, jobs.ALL_NOW, lateness_s).awaitTermination()
    found = spark.read.parquet(f"{out}/rows").collect()
    return sorted((r["agent_id"], (r["since"] - START).total_seconds(), r["status"], (r["last_seen"] - START).total_seconds()) for r in found)


def expected(rows, until):
    out = []
    for agent in {a for a, _ in rows}:
        times = sorted(s for a, s in rows if a == agent)
        for i, s in enumerate(times):
            if (i == 0 or s - times[i - 1] > LIMIT_S) and s < until:
                out.append((agent, s, "online", s))
            if (i == len(times) - 1 or times[i + 1] - s > LIMIT_S) and s + LIMIT_S < until:
                out.append((agent, s + LIMIT_S, "offline", s))
    return sorted(out)


def test_silent_agents_go_offline_and_return(spark):
    """Agent 2 sends nothing more; agent 3 returns; agent 4 comes back at the very limit; agent 1 keeps time going."""
    rows = [(1, 30.0 * i) for i in range(40)] + [(2, 0.0), (2, 30.0), (3, 0.0), (3, 500.0), (4, 0.0), (4, 90.0), (4, 180.5)]
    rows.sort(key=lambda r: r[1])
    got = run(spark, [rows[:20], rows[20:35], rows[35:]], 60)
    assert got == expected(rows, 39 * 30 - 60)
    assert (2, 120.0, "offline", 30.0) in got and (3, 500.0, "online", 500.0) in got
    assert [r[1:3] for r in got if r[0] == 4] == [(0.0, "online"), (180.0, "offline"), (180.5, "online"), (270.5, "offline")]


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_and_disorder_change_nothing(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(1, 4), float(rng.randint(0, 3000))) for _ in range(90)] + [(9, 3300.0)]
    arrival = sorted(rows, key=lambda r: r[1] + rng.random() * 190)
    want = expected(rows, 3300 - 200)
    assert run(spark, [arrival[:30], arrival[30:60], arrival[60:]], 200) == want
    assert run(spark, [rows], 200) == want


def test_late_snapshots_are_reported_and_change_nothing(spark):
    rows = [[(1, 0.0), (9, 1000.0)], [(1, 300.0), (9, 1100.0)], [(9, 1200.0)]]
    got = run(spark, rows, 60)
    assert (1, 300.0, "late", 300.0) in got
    assert [r for r in got if r[2] != "late"] == expected([(1, 0.0), (9, 1000.0), (9, 1100.0), (9, 1200.0)], 1140)


def test_state_is_runs_only():
    runs = liveness.runs_of(np.arange(0, 10_000), 5)
    assert runs == [(0, 9999)]
    assert liveness.joined([(10, 20), (0, 4), (24, 30)], 5) == [(0, 4), (10, 30)]
    changes, online, left = liveness.settled(True, [(0, 10), (40, 50)], 100, 20)
    assert [c[0] for c in changes] == ["offline", "online", "offline"] and not online and left == []

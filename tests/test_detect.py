"""Boundaries of the detectors on hand-made rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import detect, flatten, health, trend
from fleetlens.schema import SNAPSHOT
from fleetlens.sources.tables import corrupt, decode

T0 = dt.datetime(2024, 1, 1)
SCHEMA = ("event_id bigint, ts timestamp_ntz, agent_id bigint, cpu_usage double, memory_usage double, "
          "disk_usage double, network_latency double")


def frame(spark, rows, agent=1):
    """Rows of (cpu, memory, disk, latency), 30 seconds apart."""
    return spark.createDataFrame(
        [(i, T0 + dt.timedelta(seconds=30 * i), agent, *r) for i, r in enumerate(rows)], SCHEMA)


def floats(*values):
    return tuple(None if v is None else float(v) for v in values)


@pytest.mark.parametrize("values, expected", [
    ((80, 85, 90, 200), []),
    ((80.01, 0, 0, 0), [("cpu_threshold_breach", "high")]),
    ((95, 0, 0, 0), [("cpu_threshold_breach", "high")]),
    ((95.01, 0, 0, 0), [("cpu_threshold_breach", "critical")]),
    ((0, 85.01, 0, 0), [("memory_threshold_breach", "high")]),
    ((0, 95.01, 0, 0), [("memory_threshold_breach", "critical")]),
    ((0, 0, 98, 0), [("disk_threshold_breach", "high")]),
    ((0, 0, 98.01, 0), [("disk_threshold_breach", "critical")]),
    ((0, 0, 0, 200.01), [("network_latency_high", "medium")]),
    ((None, None, None, None), []),
    ((99, 99, 99, 999), [("cpu_threshold_breach", "critical"), ("disk_threshold_breach", "critical"),
                         ("memory_threshold_breach", "critical"), ("network_latency_high", "medium")]),
])
def test_thresholds(spark, values, expected):
    found = detect.threshold_anomalies(frame(spark, [floats(*values)]))
    assert sorted((r["type"], r["severity"]) for r in found.collect()) == expected


def test_threshold_text(spark):
    row = detect.threshold_anomalies(frame(spark, [floats(80.5, 0, 0, 0)])).first()
    assert row["description"] == "CPU usage 80.5% exceeds threshold"
    assert (row["value"], row["threshold"], row["suggested_action"]) == (80.5, 80.0, "identify_cpu_intensive_processes")


def test_empty_input(spark):
    empty = frame(spark, [])
    assert detect.all_anomalies(empty).count() == 0
    assert trend.insights(empty).count() == 0


@pytest.mark.parametrize("entries, found", [(19, 0), (20, 1)])
def test_jump_needs_twenty_entries(spark, entries, found):
    rows = [floats(10, 50, 0, 0)] * (entries - 5) + [floats(41, 50, 0, 0)] * 5
    assert detect.cpu_jump(frame(spark, rows)).count() == found


def test_jump_is_strict(spark):
    rows = [floats(10, 50, 0, 0)] * 15 + [floats(40, 50, 0, 0)] * 5
    assert detect.cpu_jump(frame(spark, rows)).count() == 0


def test_jump_skips_missing_sections(spark):
    rows = [floats(10, 50, 0, 0)] * 10 + [floats(None, 50, 0, 0)] * 5 + [floats(41, 50, 0, 0)] * 5
    # 15 values are present among the last 20 entries; one fewer is too few.
    assert detect.cpu_jump(frame(spark, rows)).count() == 1
    assert detect.cpu_jump(frame(spark, [floats(None, 50, 0, 0), *rows[1:]])).count() == 0


def test_jump_text_rounds_half_even(spark):
    rows = [floats(10.25, 50, 0, 0)] * 15 + [floats(45.25, 50, 0, 0)] * 5
    assert detect.cpu_jump(frame(spark, rows)).first()["description"] == "Rapid CPU increase detected: 10.2% → 45.2%"


def test_leak_slope_equals_least_squares(spark):
    rng = np.random.default_rng(3)
    memory = [None if rng.random() < 0.25 else float(np.round(rng.random() * 100, 2)) for _ in range(200)]
    rows = detect.trailing(frame(spark, [(1.0, m, 1.0, 1.0) for m in memory]), 20, detect.pattern_inputs)
    got = {r["event_id"]: (r["_memory_n"], r["_slope"]) for r in rows.collect()}
    for i in range(len(memory)):
        window = [m for m in memory[max(0, i - 14):i + 1] if m is not None]
        assert got[i][0] == len(window)
        if len(window) >= 2:
            assert got[i][1] == pytest.approx(np.polyfit(range(len(window)), window, 1)[0], abs=1e-9)


@pytest.mark.parametrize("entries, found", [(9, 0), (10, 1)])
def test_forecast_needs_ten_entries(spark, entries, found):
    rows = [floats(0, 0, 50 + i, 0) for i in range(entries)]
    got = trend.forecast_exhaustion(frame(spark, rows), "disk_usage").collect()
    assert len(got) == found
    if found:
        assert (got[0]["time_to_failure"], got[0]["confidence"], got[0]["current_usage"]) == (41, 0.9, 59.0)
        assert got[0]["trend"] == pytest.approx(1.0)


def test_forecast_truncates_toward_zero(spark):
    # Memory above its ceiling of 95 gives a negative time.
    rows = [floats(0, 90.0 + i * 0.9, 0, 0) for i in range(10)]
    assert trend.forecast_exhaustion(frame(spark, rows), "memory_usage").first()["time_to_failure"] == -3


def test_insights_count_missing_as_zero(spark):
    rows = [floats(30, 30, 0, 0)] * 7 + [floats(None, 30, 0, 0)] * 3
    row = trend.insights(frame(spark, rows)).first()
    assert (row["cpu_direction"], row["cpu_change"], row["memory_direction"]) == ("decreasing", -30.0, "stable")
    assert row["efficiency_score"] == int(100 - (21.0 * 0.4 + 30.0 * 0.4))


def test_efficiency_is_never_negative(spark):
    rows = [floats(250, 250, 0, 0)] * 10
    assert trend.insights(frame(spark, rows)).first()["efficiency_score"] == 0


def test_rates(spark):
    base = [(0, T0, 1, 100), (1, T0 + dt.timedelta(seconds=10), 1, 350), (2, T0 + dt.timedelta(seconds=10), 1, 400),
            (3, T0 + dt.timedelta(seconds=20), 1, 0)]
    df = spark.createDataFrame(base, "event_id bigint, ts timestamp_ntz, agent_id bigint, c bigint")
    got = {r["event_id"]: r["rate"] for r in trend.counter_rates(df, {"c": "rate"}).collect()}
    # First sample 0, no progress in time no rate, a reset keeps its negative rate.
    assert got == {0: 0.0, 1: 25.0, 2: None, 3: -40.0}


def test_scaling_matches_population_deviation(spark):
    rng = np.random.default_rng(5)
    values = rng.random(60) * 100
    df = frame(spark, [(float(v), 7.0, 1.0, 1.0) for v in values])
    got = {r["event_id"]: r for r in trend.scaled(df, ["cpu_usage", "memory_usage"], 50).collect()}
    assert sorted(got) == list(range(50, 60))
    for i, row in got.items():
        window = values[i - 49:i + 1]
        assert row["z_cpu_usage"] == pytest.approx((values[i] - window.mean()) / window.std())
        assert row["z_memory_usage"] == 0.0


def test_latest_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, T0, 1, 5.0), (2, T0, 1, 6.0)], "event_id bigint, ts timestamp_ntz, agent_id bigint, cpu_usage double")
    assert health.latest_per_agent(df).first()["event_id"] == 2


def test_health_without_sections(spark):
    row = health.health_check(frame(spark, [floats(96, None, 91, 0)])).first()
    assert (row["status"], row["overall_score"], row["critical_issues"], row["warnings"]) == ("critical", 55, 1, 1)
    assert (row["cpu_score"], row["memory_score"], row["disk_score"]) == (4.0, None, 9.0)


def test_json_sections_and_corrupt_text(spark):
    texts = ['{"cpu": {"usage_percent": 5.5}, "memory": {}, "disk": null}', '{"cpu": {"usage_percent"', "[1]", "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "event_id bigint, value string")
    parsed = decode(df)
    assert sorted(r["event_id"] for r in parsed.where(corrupt()).collect()) == [1, 2]
    good = flatten.detector_values(parsed.where(~corrupt()).select("event_id", "doc.*")).orderBy("event_id").collect()
    # A section without the key reads 0, an absent or null section stays NULL.
    assert [(r["cpu_usage"], r["memory_usage"], r["disk_usage"], r["network_latency"]) for r in good] == [
        (5.5, 0.0, None, None), (None, None, None, None)]


def test_features_need_every_section(spark):
    doc = SNAPSHOT
    rows = spark.createDataFrame([(1,), (2,)], "event_id bigint").select(
        "event_id", F.from_json(F.when(F.col("event_id") == 1, '{"cpu":{"usage_percent":1},"memory":{},"disk":{}}')
                                .otherwise('{"cpu":{},"memory":{}}'), doc).alias("d")).select("event_id", "d.*")
    got = {r["event_id"]: r for r in flatten.system_features(rows).collect()}
    names = [s[0] for s in flatten.SYSTEM_SLOTS]
    assert [got[1][n] for n in names] == [1.0] + [0.0] * 10
    assert all(got[2][n] is None for n in names)

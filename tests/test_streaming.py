"""A stream over many small files gives what the batch query gives."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import alerts, detect, flatten, forest, health
from fleetlens.plans import inventory, streams
from fleetlens.plans import views as V
from fleetlens.session import shared_dir
from fleetlens.sources.tables import decode, land_raw, landed
from fleetlens.streaming import jobs, state
from fleetlens.streaming.sources import json_stream, table_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def telemetry(spark):
    return V.tel(spark, SF)


@pytest.fixture
def stream(spark, telemetry, tmp_path):
    """The telemetry in six files of consecutive times, one per micro-batch."""
    for i in range(6):
        telemetry.where((F.col("event_id") >= i * 170) & (F.col("event_id") < (i + 1) * 170)).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    return table_stream(spark, str(tmp_path / "in"), telemetry.schema, files_per_batch=1)


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


DAY = 86_400


def test_patterns_over_batches(spark, telemetry, stream):
    path = shared_dir(spark, "t")
    finish(jobs.detect_patterns(stream, path, jobs.ALL_NOW))
    state.finish(spark, path, state.find_patterns(path))
    columns = ["event_id", "agent_id", "type", "description"]
    got = spark.read.parquet(f"{path}/rows").select(columns)
    want = detect.pattern_anomalies(telemetry).select(columns)
    assert rows(got) == rows(want)
    assert want.count() > 0


@pytest.fixture
def disordered(spark, telemetry, tmp_path):
    """Text ids, one agent with a third of all rows, equal times, and half of the rows a day late, in many batches."""
    odd = F.col("event_id") % 2 == 1
    agent = F.when(F.col("event_id") % 3 == 0, "agent-hot").otherwise(F.concat(F.lit("agent-"), (F.col("agent_id") % 9).cast("string")))
    mixed = telemetry.withColumns({"agent_id": agent, "ts": F.date_trunc("hour", "ts").cast("timestamp_ntz")})
    arrival = F.unix_micros(F.col("ts").cast("timestamp")) + F.when(odd, DAY * 1_000_000).otherwise(0)
    ends = mixed.agg(F.min(arrival).alias("a"), F.max(arrival).alias("b")).first()
    for k in range(8):
        part = mixed.where(F.floor((arrival - ends["a"]) * 8 / (ends["b"] - ends["a"] + 1)) == k)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "late"))
    return mixed, table_stream(spark, str(tmp_path / "late"), mixed.schema, files_per_batch=1)


def test_late_rows_hot_agents_and_text_ids(spark, disordered):
    mixed, stream = disordered
    path = shared_dir(spark, "t")
    finish(jobs.detect_patterns(stream, path, jobs.ALL_NOW, DAY))
    state.finish(spark, path, state.find_patterns(path))
    columns = ["event_id", "agent_id", "type", "description"]
    want = detect.pattern_anomalies(mixed).select(columns)
    assert rows(spark.read.parquet(f"{path}/rows").select(columns)) == rows(want)
    assert want.count() > 0 and state.late_rows(spark, path, mixed.schema).count() == 0
    assert len(spark.read.parquet(f"{path}/rows").select("batch").distinct().collect()) > 3


def test_late_alerts(spark, disordered):
    mixed, stream = disordered
    path = shared_dir(spark, "t")
    finish(jobs.track_alerts(streams._alert_events(stream), path, jobs.ALL_NOW, DAY))
    state.finish(spark, path, state.follow_alerts(path))
    resolves = mixed.where("event_type = 'signup'").select("event_id", "ts", "agent_id", F.lit(V.CPU_BREACH).alias("type"))
    want = alerts.alert_episodes(detect.threshold_anomalies(mixed), resolves)
    assert rows(jobs.tracked_alerts(spark, path).select(want.columns)) == rows(want)
    assert want.where("status = 'resolved'").count() > 0


def test_purged_alerts_leave_the_state(spark, disordered):
    mixed, stream = disordered
    path = shared_dir(spark, "t")
    finish(jobs.track_alerts_purged(streams._alert_events(stream), path, jobs.ALL_NOW, DAY, keep_hours=2))
    state.finish(spark, path, state.follow_alerts(path, 2))
    resolves = mixed.where("event_type = 'signup'").select("event_id", "ts", "agent_id", F.lit(V.CPU_BREACH).alias("type"))
    every = alerts.alert_episodes(detect.threshold_anomalies(mixed), resolves)
    now = F.lit(mixed.agg(F.max("ts")).first()[0])
    want = alerts.purge(every, now, 2)
    assert rows(jobs.kept_alerts(spark, path, now, 2).select(want.columns)) == rows(want)
    stored = state.Versions(spark, path).newest("resolved").count()
    assert stored < every.where("status = 'resolved'").count()


def test_rows_beyond_the_lateness_are_kept_apart(spark, disordered):
    mixed, stream = disordered
    path = shared_dir(spark, "t")
    finish(jobs.detect_patterns(stream, path, jobs.ALL_NOW, 3600))
    state.finish(spark, path, state.find_patterns(path))
    late = state.late_rows(spark, path, mixed.schema)
    assert 0 < late.count() < mixed.count()
    assert late.where("event_id % 2 = 0").count() == 0


def test_alert_state_over_batches(spark, telemetry, stream):
    path = shared_dir(spark, "t")
    finish(jobs.track_alerts(streams._alert_events(stream), path, jobs.ALL_NOW))
    state.finish(spark, path, state.follow_alerts(path))
    want = alerts.alert_episodes(
        detect.threshold_anomalies(telemetry),
        telemetry.where("event_type = 'signup'").select("event_id", "ts", "agent_id", F.lit(V.CPU_BREACH).alias("type")))
    assert rows(jobs.tracked_alerts(spark, path).select(want.columns)) == rows(want)


def test_latest_over_batches_and_while_idle(spark, telemetry, stream):
    """Six batches, more than versions are kept: the last one is served."""
    path = shared_dir(spark, "t")
    finish(jobs.keep_latest(stream.select("event_id", "ts", "agent_id", "cpu_usage"), path, jobs.ALL_NOW))
    want = health.latest_per_agent(telemetry.select("event_id", "ts", "agent_id", "cpu_usage"))
    assert state.Versions(spark, path).pointer()[0] == 5
    assert rows(jobs.newest_version(spark, path)) == rows(want)


def test_registry_over_batches(spark, stream):
    path = shared_dir(spark, "t")
    finish(jobs.keep_registry(V.connections_of(stream), path, jobs.ALL_NOW))
    got = jobs.newest_version(spark, path).select("agent_id", "first_connected", "last_seen")
    events = V.conn_events(spark, SF).where("kind = 'connect'")
    want = events.groupBy("agent_id").agg(F.min("ts").alias("first_connected"), F.max("ts").alias("last_seen"))
    assert rows(got) == rows(want)


def test_a_batch_that_runs_again_gives_the_same_table(spark, telemetry):
    path = shared_dir(spark, "t")
    batch = telemetry.select("event_id", "ts", "agent_id", "cpu_usage")
    for number in (0, 1, 1):
        jobs.merge(batch.where(F.col("event_id") % 2 == number), number, path, health.latest_per_agent)
    assert rows(jobs.newest_version(spark, path)) == rows(health.latest_per_agent(batch))


def test_an_agent_that_recovers_is_not_critical(spark, telemetry, tmp_path):
    worst = telemetry.limit(1).withColumns({"cpu_usage": F.lit(99.0), "memory_usage": F.lit(1.0), "disk_usage": F.lit(1.0)}).cache()
    better = worst.withColumns({"cpu_usage": F.lit(1.0), "event_id": F.col("event_id") + 1})
    for part in (worst, better):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for files, first in ((1, 1), (2, 0)):
        path = shared_dir(spark, "t")
        finish(jobs.critical_feed(table_stream(spark, str(tmp_path / "in"), worst.schema, files), path, jobs.ALL_NOW))
        assert jobs.newest_check(spark, path).count() == 0
        assert spark.read.parquet(f"{path}/checks/batch=0").count() == first


def test_a_failed_check_is_tried_again(spark, telemetry, tmp_path, monkeypatch):
    telemetry.coalesce(1).write.parquet(str(tmp_path / "in"))
    calls, real = [], jobs.merge

    def flaky(*args):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("away")
        return real(*args)

    monkeypatch.setattr(jobs, "merge", flaky)
    path = shared_dir(spark, "t")
    finish(jobs.critical_feed(table_stream(spark, str(tmp_path / "in"), telemetry.schema), path, jobs.ALL_NOW, pause_s=0))
    assert len(calls) == 2 and state.Versions(spark, path).pointer()[0] == 0


def test_two_snapshots_with_equal_time_both_stay(spark, telemetry, tmp_path):
    one = telemetry.limit(1).cache()
    two = one.withColumn("event_id", F.col("event_id") + 1)
    one.union(two).union(one).coalesce(1).write.parquet(str(tmp_path / "in"))
    path = shared_dir(spark, "t")
    finish(jobs.keep_once(table_stream(spark, str(tmp_path / "in"), one.schema), path, jobs.ALL_NOW))
    state.finish(spark, path, state.drop_repeats(path))
    assert jobs.kept_once(spark, path).count() == 2


def test_saved_forest_scores_the_stream(spark, tmp_path):
    batch = flatten.network_features(V.snapshots(spark, SF)).select("event_id", "ts", "agent_id", *streams.NETWORK)
    nodes = forest.fit_forest(batch, streams.NETWORK, 20).cache()
    scored = forest.score_forest(batch, nodes, streams.NETWORK)
    offset = forest.forest_offset(scored, 0.05)
    model, path = shared_dir(spark, "m"), shared_dir(spark, "t")
    forest.save_forest(nodes, offset, streams.NETWORK, model)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    telemetry = table_stream(spark, str(tmp_path / "in"), batch.schema, files_per_batch=1)
    finish(jobs.detect_with_saved_forest(telemetry, model, path, "network_anomaly", "d", "a", -0.3, jobs.ALL_NOW))
    got = spark.read.parquet(f"{path}/rows").select("event_id", "type", "severity", "score")
    want = forest.forest_anomalies(forest.decide(scored, offset), "network_anomaly", "d", "a", -0.3)
    assert rows(got) == rows(want.select("event_id", "type", "severity", "score"))


def test_messages_reach_all_detectors(spark, tmp_path):
    """Text in many files, unreadable and unknown messages between, and forests that were fitted and saved: as the batch operators find."""
    texts = V.message_texts(V.snapshots(spark, SF)).select("event_id", "value").cache()
    for i in range(4):
        texts.where(F.floor(F.col("event_id") / 250) == i).select("value").coalesce(1).write.mode("append").text(str(tmp_path / "in"))
    live = jobs.telemetry_of(texts.select("value")).cache()
    values = streams._all_values(live)
    forests, want = [], detect.all_anomalies(values)
    for features, kind, high in ((streams.NETWORK, streams.C.NETWORK_ANOMALY, -0.3), ([f"system_{n}" for n in streams.SYSTEM], streams.C.SYSTEM_ANOMALY, -0.5)):
        nodes, model = forest.fit_forest(values, features, 20).cache(), shared_dir(spark, "m")
        scored = forest.score_forest(values, nodes, features)
        offset = forest.forest_offset(scored, 0.1)
        forest.save_forest(nodes, offset, features, model)
        forests.append((model, kind, high))
        want = want.unionByName(forest.forest_anomalies(forest.decide(scored, offset), *kind, high))
    path, lateness = shared_dir(spark, "t"), 60 * 24 * 3600
    finish(jobs.detect_all_in_messages(
        json_stream(spark, str(tmp_path / "in"), files_per_batch=1), path, streams._all_values, forests, jobs.ALL_NOW, lateness))
    state.finish(spark, path, state.send_all_anomalies(path, streams._all_values, forests))
    got = inventory.anomaly_fields(spark.read.parquet(f"{path}/rows"), "string").select("event_id", "agent_id", "kind", "severity", "description")
    want = want.select("event_id", "agent_id", F.col("type").alias("kind"), "severity", "description")
    assert rows(got) == rows(want) and want.where("kind = 'system_anomaly'").count() and live.count() < texts.count()


@pytest.mark.parametrize("lateness_s", [600, streams.DELAY_S])
def test_late_snapshots_are_kept_once(spark, telemetry, lateness_s):
    columns = ["event_id", "ts", "agent_id", "v"]
    stream = streams._delayed(spark, SF).select(columns)
    path = shared_dir(spark, "t")
    finish(jobs.keep_once(stream.union(stream), path, jobs.ALL_NOW, lateness_s))
    state.finish(spark, path, state.drop_repeats(path))
    assert rows(jobs.kept_once(spark, path)) == rows(telemetry.select(columns))
    late = state.late_rows(spark, path, telemetry.select(columns).schema).count()
    assert late > 0 if lateness_s == 600 else late == 0
    assert spark.read.parquet(f"{path}/rows").count() == telemetry.count() - late / 2


@pytest.mark.parametrize("lateness_s", [600, streams.DELAY_S])
def test_late_anomalies_are_in_the_sums_of_the_day(spark, telemetry, lateness_s):
    path = shared_dir(spark, "t")
    finish(jobs.anomalies_last_day(detect.threshold_anomalies(streams._delayed(spark, SF)), path, jobs.ALL_NOW, lateness_s))
    until = jobs.watermark(spark, path)
    anomalies = detect.threshold_anomalies(telemetry)
    assert rows(jobs.last_day(jobs.hours_counted(spark, path), until)) == rows(jobs.last_day(state.per_hour(anomalies), until))
    late = state.late_rows(spark, path, "ts timestamp_ntz").count()
    assert late > 0 if lateness_s == 600 else late == 0


def test_rows_without_time_are_kept_apart(spark, telemetry, tmp_path):
    columns = ["event_id", "ts", "agent_id", "v"]
    timeless = telemetry.select(columns).withColumn("ts", F.when(F.col("event_id") % 5 != 0, F.col("ts")))
    for k in (0, 1):  # in the first batch and in a later one
        timeless.where((F.col("event_id") >= 500) == bool(k)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path = shared_dir(spark, "t")
    finish(jobs.keep_once(table_stream(spark, str(tmp_path / "in"), timeless.schema, files_per_batch=1), path, jobs.ALL_NOW))
    state.finish(spark, path, state.drop_repeats(path))
    late = state.late_rows(spark, path, timeless.schema)
    assert rows(late.where("ts IS NULL")) == rows(timeless.where("ts IS NULL"))
    assert late.where("ts IS NULL AND event_id < 500").count() > 0 and late.where("ts IS NULL AND event_id >= 500").count() > 0
    assert rows(jobs.kept_once(spark, path)) == rows(timeless)


def test_json_messages_and_landing(spark, tmp_path):
    messages = V.raw_messages(spark, SF)
    messages.select("value").write.text(str(tmp_path / "json"))
    path = shared_dir(spark, "t")
    finish(jobs.append_table(decode(json_stream(spark, str(tmp_path / "json")), sections=("cpu",)).select("doc.cpu"), path, jobs.ALL_NOW))
    assert spark.read.parquet(f"{path}/rows").count() == messages.count()
    landed = str(tmp_path / "landed")
    land_raw(messages, landed)
    land_raw(messages, landed)
    assert spark.read.parquet(landed).count() == 2 * messages.count()
    assert "date" in spark.read.parquet(landed).columns


def test_landed_days_are_pruned(spark, telemetry, tmp_path):
    path = str(tmp_path / "landed")
    land_raw(telemetry, path)
    start, end = datetime(2024, 1, 10, 6), datetime(2024, 1, 11, 12)
    got = landed(spark, path, start, end)
    want = telemetry.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))
    assert got.count() == want.count() > 0
    assert "PartitionFilters: [isnotnull(date" in got._jdf.queryExecution().executedPlan().toString()
    files = got.select(F.input_file_name().alias("f")).distinct().collect()
    assert {f["f"].split("date=")[1][:10] for f in files} == {"2024-01-10", "2024-01-11"}

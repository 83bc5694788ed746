"""Alert episodes, rules and the registry on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from fleetlens.operators import agents, alerts, inventory, report, routing

T0 = dt.datetime(2024, 1, 1)
ANOMALY = "event_id bigint, ts timestamp_ntz, agent_id bigint, type string, severity string, description string, suggested_action string"
RESOLVE = "event_id bigint, ts timestamp_ntz, agent_id bigint, type string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def anomalies(spark, rows):
    return spark.createDataFrame([(i, at(s), 1, "cpu", sev, f"d{i}", "a") for i, (s, sev) in enumerate(rows)], ANOMALY)


def resolves(spark, seconds, first_id=100):
    return spark.createDataFrame([(first_id + i, at(s), 1, "cpu") for i, s in enumerate(seconds)], RESOLVE)


def test_open_repeat_resolve_repeat(spark):
    found = anomalies(spark, [(0, "high"), (30, "critical"), (90, "medium")])
    got = alerts.alert_episodes(found, resolves(spark, [60, 61])).orderBy("first_seen").collect()
    assert [(r["count"], r["severity"], r["description"], r["status"], r["resolved_at"]) for r in got] == [
        (2, "high", "d0", "resolved", at(60)), (1, "medium", "d2", "active", None)]
    assert got[0]["alert_id"] == "cpu_1"
    assert got[0]["last_seen"] == at(30)


def test_resolve_without_alert_changes_nothing(spark):
    assert alerts.alert_episodes(anomalies(spark, []), resolves(spark, [5])).count() == 0


def test_anomaly_comes_before_a_resolve_at_the_same_time(spark):
    got = alerts.alert_episodes(anomalies(spark, [(10, "high")]), resolves(spark, [10], first_id=0)).first()
    assert (got["status"], got["resolved_at"]) == ("resolved", at(10))


def test_defaults(spark):
    row = spark.createDataFrame([(1, T0, 1, "cpu", None, None, None)], ANOMALY)
    got = alerts.alert_episodes(row, resolves(spark, [])).first()
    assert (got["severity"], got["description"]) == ("medium", "")


def test_purge_keeps_recent_and_active(spark):
    found = anomalies(spark, [(0, "high"), (100, "high"), (200, "high")])
    episodes = alerts.alert_episodes(found, resolves(spark, [50, 150]))
    asof = F.lit(T0 + dt.timedelta(hours=24, seconds=100)).cast("timestamp_ntz")
    assert {r["episode"] for r in alerts.purge(episodes, asof).collect()} == {1, 2}


def test_notifications_carry_the_first_text(spark):
    got = alerts.notifications(anomalies(spark, [(0, "high"), (30, "critical")]), resolves(spark, [])).collect()
    assert {(r["event_id"], r["description"], r["channel"]) for r in got} == {
        (1, "d0", "webhook"), (1, "d0", "email"), (1, "d0", "slack")}


def usage(spark, values):
    rows = [(i, at(s), 1, c, m, d) for i, (s, c, m, d) in enumerate(values)]
    return spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, agent_id bigint, cpu_usage double, memory_usage double, disk_usage double")


def test_breach_must_last(spark):
    df = usage(spark, [(0, 81.0, 0.0, 0.0), (299, 81.0, 0.0, 0.0), (300, 80.0, 0.0, 0.0), (400, 96.0, 0.0, 0.0), (460, 96.0, 0.0, 91.0)])
    got = {(r["rule"], r["samples"], r["started_at"], r["ended_at"]) for r in alerts.sustained_breaches(df).collect()}
    assert got == {("cpu_critical", 2, at(400), at(460)), ("disk_critical", 1, at(460), at(460))}


def test_missing_section_breaks_a_run(spark):
    df = usage(spark, [(0, 96.0, 0.0, 0.0), (30, None, 0.0, 0.0), (60, 96.0, 0.0, 0.0)])
    assert alerts.sustained_breaches(df).count() == 0


def test_apply_resolutions(spark):
    found = alerts.alert_table(alerts.alert_episodes(anomalies(spark, [(0, "high")]), resolves(spark, [])))
    requests = spark.createDataFrame([("cpu_1_0", at(99)), ("other", at(1))], "alert_id string, ts timestamp_ntz")
    row = alerts.apply_resolutions(found, requests).first()
    assert (row["status"], row["last_seen"]) == ("resolved", at(99))


def test_listing_filters_and_lookup(spark):
    table = alerts.alert_table(alerts.alert_episodes(anomalies(spark, [(0, "high"), (50, "critical")]), resolves(spark, [20])))
    assert report.alert_listing(table, status="active").first()["severity"] == "critical"
    assert report.alert_listing(table, severity="high").first()["timestamp"] == "2024-01-01T00:00:00"
    assert report.alert_listing(table, limit=1).count() == 1
    assert report.alert_detail(table, "nope").count() == 0


CONN = "event_id bigint, ts timestamp_ntz, agent_id bigint, kind string"


def test_connected_means_last_event_is_connect(spark):
    events = spark.createDataFrame([(1, at(0), 1, "connect"), (2, at(5), 1, "disconnect"), (3, at(0), 2, "connect"),
                                    (4, at(0), 3, "disconnect"), (5, at(0), 3, "connect")], CONN)
    assert {r["agent_id"] for r in agents.connected(events).collect()} == {2, 3}


def test_registry_merges_into_the_previous_one(spark):
    first = agents.agent_snapshot(spark.createDataFrame([(1, at(0), 1, "connect"), (2, at(1), 2, "connect")], CONN))
    second = agents.agent_snapshot(spark.createDataFrame([(3, at(9), 1, "connect"), (4, at(9), 3, "connect")], CONN), None, first)
    got = {r["agent_id"]: (r["hostname"], r["platform"], r["first_connected"], r["last_seen"]) for r in second.collect()}
    assert got == {1: ("1", "Unknown", at(0), at(9)), 2: ("2", "Unknown", at(1), at(1)), 3: ("3", "Unknown", at(9), at(9))}


def test_routes(spark):
    kinds = [None, "telemetry", "pong", "script_result", "restart", "ping", "strange"]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(kinds)], "i int, msg_type string")
    sizes = {name: branch.count() for name, branch in routing.route_messages(df).items()}
    assert sizes == {"telemetry": 2, "replies": 2, "commands": 2, "quarantine": 1}


def test_scripts(spark):
    texts = ["sudo RM -rf /", "DEL /F x", "reFormat", "echo ok"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "script_id int, text string")
    got = [r["decision"] for r in inventory.screen_scripts(df).orderBy("script_id").collect()]
    assert got == ["blocked", "blocked", "blocked", "accepted"]
    assert inventory.screen_scripts(df, allowed=False).where("decision = 'not_allowed'").count() == 4


def test_probe_text(spark):
    texts = ["64 bytes: time=12.5 ms", "Reply: time=7ms TTL", "timed out", "time=abc ms"]
    df = spark.createDataFrame([(1, t) for t in texts], "agent_id int, output string")
    assert sorted(r["latency_ms"] for r in inventory.parse_probes(df).collect()) == [-1.0, -1.0, 7.0, 12.5]
    assert inventory.mean_latency(df).first()["latency_ms"] == 9.75
    assert inventory.mean_latency(df.where("output like '%out'")).first()["latency_ms"] == 0.0


def test_zero_sized_partition(spark):
    df = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 2 ** 30, 2 ** 29)], "agent_id int, ordinal int, total_bytes bigint, used_bytes bigint")
    row = inventory.disk_rollup(df).first()
    # The first partition decides, and it has no usage.
    assert (row["total_gb"], row["used_gb"], row["usage_percent"]) == (1.0, 0.5, 0.0)


def test_rules_crossed_equal_a_plain_join(spark):
    """Equal thresholds, thresholds equal to values, one huge level, values below and above all, NULL on both sides, a metric without rules."""
    rows = [(i, 1, None if i % 11 == 0 else float(i % 40), float(-i), 7.0) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id bigint, agent_id bigint, a double, b double, c double").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    rules = [(i, "a", float(i % 37)) for i in range(500)] + [(1000 + i, "a", 20.0) for i in range(400)]
    rules += [(3000, "b", -150.5), (3001, "a", None), (3002, "other", 1.0), (3003, "b", -1000.0)]
    table = spark.createDataFrame(rules, "rule bigint, metric string, threshold double")
    want = []
    for event, _, *values in rows:
        for metric, value in zip("abc", values):
            below = [(t, r) for r, m, t in rules if m == metric and t is not None and value is not None and t < value]
            if below:
                want.append((event, metric, value, len(below), *max(below)))
    for cells in (2, 8, 256):
        got = alerts.rules_crossed(df, table, ["a", "b", "c"], cells).collect()
        assert sorted((r["event_id"], r["metric"], r["value"], r["n_rules"], r["threshold"], r["rule"]) for r in got) == sorted(want)
    assert alerts.rules_crossed(df, table.limit(0), ["a", "b", "c"]).count() == 0
    assert alerts.rules_crossed(df.limit(0), table, ["a", "b", "c"]).count() == 0

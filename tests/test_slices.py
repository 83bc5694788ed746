"""Cutting heavy keys into slices must not change any result."""

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import alerts, detect, report, trend
from fleetlens.operators.quantiles import exact_quantiles
from fleetlens.operators.slices import AGENT_SERIES, BUCKET_KEY, SLICE, cut_keys, numbered, running, trailing
from fleetlens.session import ROWS_PER_TASK_KEY


@pytest.fixture
def small_tasks(spark):
    """Lets a task hold few rows, so that keys are cut although the data is small."""
    def limit(rows):
        spark.conf.set(ROWS_PER_TASK_KEY, str(rows))
        spark.conf.set(BUCKET_KEY, "1")
    yield limit
    spark.conf.unset(ROWS_PER_TASK_KEY)
    spark.conf.unset(BUCKET_KEY)


@pytest.fixture(scope="module")
def skewed(spark):
    """One agent holds a third of the rows, half of those in one burst with equal times."""
    i = F.col("id")
    agent = F.when(i % 3 == 0, 7).otherwise(i % 40 + 100).cast("bigint")
    second = F.when((i % 3 == 0) & (i > 3000), 3000).otherwise(i)
    df = spark.range(6000).select(
        i.alias("event_id"), agent.alias("agent_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=second)).cast("timestamp_ntz").alias("ts"),
        F.when(i % 7 != 0, (F.xxhash64(i) % 10000 + 10000) / 200.0).alias("cpu_usage"),
        F.when(i % 5 != 0, (F.xxhash64(i, F.lit(1)) % 10000 + 10000) / 200.0).alias("memory_usage"),
        ((i * 13) % 10001 / 100.0).alias("disk_usage"), ((i * 3) % 30001 / 100.0).alias("network_latency"),
    )
    return df.cache()


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def same(small_tasks, build, limit=50):
    plain = rows(build())
    small_tasks(limit)
    assert rows(build()) == plain
    assert plain


def test_heavy_key_is_cut_into_small_slices(spark, skewed, small_tasks):
    small_tasks(110)
    cut = cut_keys(skewed, AGENT_SERIES)
    burst = skewed.groupBy("agent_id", "ts").count().agg(F.max("count")).first()[0]
    sizes = [r["count"] for r in cut.groupBy("agent_id", SLICE).count().collect()]
    assert sorted(sizes)[-1] <= 110 + burst and sorted(sizes)[-2] <= 111
    # The other agents have 100 rows each and stay whole.
    assert {r["agent_id"] for r in cut.where("_cut").select("agent_id").distinct().collect()} == {7}
    assert cut.count() == skewed.count()


def test_slices_keep_the_order(skewed, small_tasks):
    small_tasks(100)
    cut = cut_keys(skewed, AGENT_SERIES).where("_cut")
    got = [r["event_id"] for r in cut.orderBy(SLICE, "ts", "event_id").collect()]
    want = [r["event_id"] for r in cut.orderBy("ts", "event_id").collect()]
    assert got == want


def test_building_a_plan_runs_no_job(spark, skewed):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    detect.all_anomalies(skewed)
    running(skewed, {"a": F.col("event_id")})
    assert tracker.getJobIdsForGroup("building") == []


def test_rows_without_time_or_key(spark, skewed, small_tasks):
    odd = skewed.withColumns({
        "ts": F.when(F.col("event_id") % 13 != 0, F.col("ts")), "agent_id": F.when(F.col("event_id") % 17 != 0, F.col("agent_id")),
    })
    same(small_tasks, lambda: trailing(odd, 20, lambda d, w: d.withColumn("ids", F.collect_list("event_id").over(w.rowsBetween(-19, 0)))))
    same(small_tasks, lambda: running(odd, {"a": F.col("event_id")}))


@pytest.mark.parametrize("limit", [3, 50, 500])
def test_trailing_frames(skewed, small_tasks, limit):
    def build():
        return trailing(skewed, 20, lambda d, w: d.withColumns({
            "n": F.count("*").over(w.rowsBetween(-19, 0)),
            "ids": F.collect_list("event_id").over(w.rowsBetween(-19, 0)),
            "before": F.lag("event_id", 19).over(w),
        }))
    same(small_tasks, build, limit)


@pytest.mark.parametrize("limit", [3, 50, 500])
def test_running_sums(skewed, small_tasks, limit):
    same(small_tasks, lambda: running(skewed, {"a": F.col("event_id"), "b": F.lit(1).cast("bigint")}), limit)


def test_numbering(skewed, small_tasks):
    same(small_tasks, lambda: numbered(skewed, "position"))


def test_detectors_and_trends(skewed, small_tasks):
    same(small_tasks, lambda: detect.all_anomalies(skewed))
    same(small_tasks, lambda: trend.counter_rates(skewed.withColumn("c", F.col("event_id") * 5), {"c": "rate"}))

    def rounded(df, *names):
        return df.withColumns({n: F.round(n, 8) for n in names})
    same(small_tasks, lambda: rounded(trend.forecast_exhaustion(skewed, "memory_usage"), "trend", "confidence"))
    same(small_tasks, lambda: rounded(trend.insights(skewed), "cpu_change", "cpu_average", "memory_change", "memory_average"))
    same(small_tasks, lambda: rounded(trend.scaled(skewed, ["cpu_usage", "disk_usage"], 50), "z_cpu_usage", "z_disk_usage"))


def test_alerts_and_rules(skewed, small_tasks):
    found = detect.threshold_anomalies(skewed)
    resolves = skewed.where("event_id % 11 = 0").select("event_id", "ts", "agent_id", F.lit("cpu_threshold_breach").alias("type"))
    same(small_tasks, lambda: alerts.alert_episodes(found, resolves))
    same(small_tasks, lambda: alerts.notifications(found, resolves))
    same(small_tasks, lambda: alerts.sustained_breaches(skewed))


def test_severity_timeline(skewed, small_tasks):
    flagged = report.flagged(skewed)
    same(small_tasks, lambda: report.severity_timeline(flagged))


def test_quantiles(skewed, small_tasks):
    wanted = {"q0": 0.0, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99, "q100": 1.0}

    def build():
        found = exact_quantiles(skewed, ["cpu_usage", "disk_usage"], wanted)
        return found.withColumns({name: F.round(name, 9) for name in wanted})
    same(small_tasks, build, 10)

"""Distinct counts from stored sketches."""

from pyspark.sql import functions as F

from fleetlens.operators import report


def test_merged_sketches_are_near_the_exact_counts(spark):
    rows = spark.range(60_000).select(
        (F.col("id") * 7919 % 20_000).alias("agent_id"), (F.timestamp_seconds(F.col("id") * 15)).cast("timestamp_ntz").alias("ts"))
    sketches = report.distinct_sketches(rows.unionByName(rows.limit(5).withColumn("ts", F.lit(None).cast("timestamp_ntz"))), "agent_id")
    got = {r["day"]: r["n"] for r in report.distinct_in_spans(sketches, 3).collect()}
    days = rows.select("agent_id", F.explode(F.sequence(F.to_date("ts"), F.date_add(F.to_date("ts"), 2))).alias("day"))
    exact = {r["day"]: r["n"] for r in days.groupBy("day").agg(F.countDistinct("agent_id").alias("n")).collect()}
    assert len(got) == 11 and set(got) <= set(exact)
    assert max(exact.values()) > 15_000 and all(abs(n - exact[day]) <= 0.03 * exact[day] for day, n in got.items())


def test_no_rows_and_no_values(spark):
    rows = spark.createDataFrame([(None, None)], "agent_id bigint, ts timestamp_ntz")
    assert report.distinct_in_spans(report.distinct_sketches(rows, "agent_id"), 7).count() == 0
    rows = rows.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert [tuple(r)[1] for r in report.distinct_in_spans(report.distinct_sketches(rows, "agent_id"), 7).collect()] == [0]

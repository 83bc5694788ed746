"""Plans that large data depends on."""

import re

import pytest

from fleetlens.plans import ALL
from fleetlens.schema import TABLES, create_tables
from fleetlens.session import with_defaults

SF = "/root/testdata/sf0.001"
# Their work is done while the plan is built (streams, stored tables), so their plans say little.
EAGER = ("stream", "forest", "anomalies_four", "csv")


def plan(spark, name):
    return ALL[name][0](with_defaults(spark), SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, exchanges", [
    ("anomalies_threshold", 0), ("metrics_json_defaults", 0), ("json_decoded", 0), ("script_screen", 0), ("rule_matches", 0),
    ("anomaly_envelopes", 0), ("metrics_latest_per_agent", 1), ("top_processes_cpu", 1),
])
def test_number_of_shuffles(spark, name, exchanges):
    assert plan(spark, name).count("Exchange hashpartitioning") == exchanges


@pytest.mark.parametrize("name", ["anomalies_all_with_remediation", "forecast_disk_full", "insights_trend", "alert_episodes", "counter_rate"])
def test_windows_run_per_slice_at_every_size(spark, name):
    """The plan that runs at scale is the only one: windows over rows are partitioned by key and slice, starts are broadcast."""
    text = plan(spark, name)
    rows = [w for w in re.findall(r"Window \[[^\n]*windowspecdefinition\(([^\n]*)", text) if "event_id" in w or "_order" in w]
    assert rows and all("_slice" in w for w in rows)
    assert "BroadcastHashJoin" in text


def test_a_windowed_query_shuffles_its_rows_once_when_no_key_is_large(spark):
    """After execution the copies and the starts of slices have turned out empty."""
    df = ALL["anomalies_all_with_remediation"][0](with_defaults(spark), SF)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"Exchange hashpartitioning\(agent_id[^\n]*_slice", final)) <= 2


@pytest.mark.parametrize("name", ["top_processes_cpu", "dash_cpu_overload"])
def test_top_rows_are_cut_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert text.index("Exchange hashpartitioning") < text.rindex("WindowGroupLimit")


def test_newest_rows_are_not_sorted_globally(spark):
    assert "TakeOrderedAndProject" in plan(spark, "raw_table_preview")


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "agents_connected")
    assert "PushedFilters: [In(event_type" in text
    assert "value" not in text.split("ReadSchema: ")[1].splitlines()[0]


@pytest.mark.parametrize("name", sorted(n for n in ALL if not n.startswith(EAGER)))
def test_no_cross_join_and_no_single_partition_window(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text
    assert not re.search(r"Window[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", text)


def test_tables_can_be_created(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS fleet_test")
    spark.sql("USE fleet_test")
    try:
        create_tables(spark, str(tmp_path))
        create_tables(spark, str(tmp_path))
        assert {t.name for t in spark.catalog.listTables()} >= set(TABLES)
        for name in TABLES:
            spark.sql(f"DROP TABLE {name}")
    finally:
        spark.sql("USE default")
        spark.sql("DROP DATABASE fleet_test")

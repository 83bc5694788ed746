"""Trees that follow a window against trees grown anew for every window."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fleetlens.operators import forest, moving_forest
from fleetlens.operators.slices import BUCKET_KEY
from fleetlens.session import ROWS_PER_TASK_KEY

FEATURES = ["a", "b", "c"]


def series(kind: str, n: int, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    if kind == "spread":
        return rng.normal(size=(n, 3))
    if kind == "ties":
        return rng.integers(0, 3, size=(n, 3)).astype(float)
    if kind == "constant":
        return np.column_stack([np.full(n, 5.0), np.repeat(rng.random(n // 10 + 1), 10)[:n], rng.integers(0, 2, n)]).astype(float)
    if kind == "trend":
        return np.arange(n)[:, None] + rng.random((n, 3))
    return np.where(rng.random((n, 3)) < 0.05, np.nan, rng.normal(size=(n, 3)))


def anew(rows, complete, window, seeds, share):
    """The decisions by a whole forest per row."""
    out = []
    for p in range(window, len(rows)):
        inside = np.arange(p - window + 1, p + 1)
        inside = inside[complete[inside]]
        n = len(inside)
        if not complete[p] or n < moving_forest.LEAST:
            out.append(np.nan)
            continue
        sizes = np.full(len(seeds), n)
        paths, _, _ = forest.grow(np.tile(rows[inside], (len(seeds), 1)), sizes, seeds, forest.depth_limit(sizes))
        out += list(forest.window_decisions(paths.reshape(1, len(seeds), n), np.ones((1, n), dtype=bool), n - 1, share))
    return np.array(out)


@pytest.mark.parametrize("kind", ["spread", "ties", "constant", "trend", "not a number"])
@pytest.mark.parametrize("absent", [0.0, 0.3, 0.75])
def test_same_decisions_as_trees_grown_anew(kind, absent):
    """Also where the number of complete rows crosses the sizes at which the depth allowed changes."""
    seeds = forest.tree_seeds(20, 42)
    stretches = []
    for i, n in enumerate([50, 51, 130, 90]):
        rows = series(kind, n, i)
        complete = np.random.default_rng(i).random(n) >= absent
        complete[60:75] = False
        stretches.append((np.where(complete[:, None], rows, np.nan), complete))
    got = moving_forest.follow(stretches, 50, seeds, 0.1)
    for found, (rows, complete) in zip(got, stretches):
        assert np.array_equal(found, anew(rows, complete, 50, seeds, 0.1), equal_nan=True)


def test_few_rows_are_placed_again():
    seeds = forest.tree_seeds(100, 42)
    rows = series("spread", 150)
    trees = moving_forest.MovingTrees(1, 50, 3, seeds)
    whole = np.array([True])
    trees.present[0, :-1], trees.rows[0, :-1] = True, rows[1:50]
    placed = [trees.move(1, (49 + i) % 50, rows[50 + i][None], whole, anew=i == 0) for i in range(100)]
    assert placed[0] == 100 * 50
    assert np.mean(placed[1:]) < 100 * 50 / 2


@pytest.fixture(scope="module")
def table(spark):
    """One agent with most rows, rows without time, equal times, absent values, and agents with a short history."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(1400):
        agent = 1 if rng.random() < 0.7 else int(rng.integers(2, 6))
        values = [None if rng.random() < 0.05 else float(v) for v in np.round(rng.normal(size=3), 1)]
        rows.append((i, agent, None if i % 97 == 0 else int(i // 3), *values))
    rows += [(5000 + i, 9, i, 1.0, 1.0, 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id bigint, agent_id bigint, s bigint, a double, b double, c double")
    return df.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).cache()


def listed(df):
    return sorted((r["event_id"], r["agent_id"], str(r["ts"]), r["decision"]) for r in df.collect())


def test_same_rows_as_per_message(spark, table):
    expected = listed(forest.per_message_decision(table, FEATURES, 30, 50, 0.1))
    assert len(expected) > 500
    assert listed(moving_forest.decisions(table, FEATURES, 30, 50, 0.1)) == expected
    assert listed(moving_forest.decisions(table.repartition(7, "a"), FEATURES, 30, 50, 0.1)) == expected
    spark.conf.set(ROWS_PER_TASK_KEY, "60")
    spark.conf.set(BUCKET_KEY, "20")
    try:
        assert listed(moving_forest.decisions(table, FEATURES, 30, 50, 0.1)) == expected
    finally:
        spark.conf.unset(ROWS_PER_TASK_KEY)
        spark.conf.unset(BUCKET_KEY)


def test_empty_and_short_tables(spark, table):
    assert moving_forest.decisions(table.limit(0), FEATURES, 10, 50, 0.1).count() == 0
    assert moving_forest.decisions(table.where("agent_id = 9"), FEATURES, 10, 50, 0.1).count() == 0


@pytest.mark.parametrize("moving, whole", [("forest_incremental", "forest_system_per_message"), ("forest_incremental_network", "forest_network_per_message")])
def test_queries_equal_per_message(spark, moving, whole):
    import __spark_entry__ as entry

    named = entry.queries()
    got, expected = ([tuple(r) for r in named[q](spark, "/root/testdata/sf0.001").collect()] for q in (moving, whole))
    assert expected and sorted(got) == sorted(expected)

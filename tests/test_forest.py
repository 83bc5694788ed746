"""Properties of the isolation forest."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import forest
from fleetlens.session import shared_dir

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def points(spark):
    """2,000 ordinary points, a constant feature, and five planted outliers."""
    rng = np.random.default_rng(1)
    rows = [(i, i % 4, float(x), float(y), 1.0) for i, (x, y) in enumerate(rng.normal(size=(2000, 2)))]
    rows += [(2000 + i, 0, 9.0 + i, -9.0 - i, 1.0) for i in range(5)]
    rows += [(3000, 0, None, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "event_id bigint, agent_id bigint, a double, b double, c double")
    return df.withColumn("ts", F.timestamp_seconds(F.col("event_id")).cast("timestamp_ntz")).cache()


@pytest.fixture(scope="module")
def nodes(points):
    return forest.fit_forest(points, FEATURES, 50).cache()


def scores(points, nodes):
    return {r["event_id"]: r["score"] for r in forest.score_forest(points, nodes, FEATURES).collect()}


def test_planted_outliers_score_lowest(points, nodes):
    got = scores(points, nodes)
    lowest = sorted((s, i) for i, s in got.items() if s is not None)[:5]
    assert {i for _, i in lowest} == set(range(2000, 2005))
    assert got[3000] is None
    assert all(-1 < s < 0 for s in got.values() if s is not None)


def test_trees_are_complete(nodes):
    table = nodes.toPandas()
    for _, tree in table.groupby("tree"):
        inner = set(tree.loc[tree["feature"] >= 0, "node"])
        children = {2 * n for n in inner} | {2 * n + 1 for n in inner}
        assert set(tree["node"]) == {1} | children
    # A constant feature is never split on.
    assert 2 not in set(table["feature"])
    assert table["node"].max() < 512
    assert table["tree"].nunique() == 50


def test_flagged_share_is_the_contamination(points, nodes):
    scored = forest.score_forest(points, nodes, FEATURES)
    decided = forest.decide(scored, forest.forest_offset(scored, 0.1))
    share = decided.where("decision < 0").count() / 2005
    assert abs(share - 0.1) < 0.002


def test_same_seed_same_nodes_whatever_the_partitions(points, nodes):
    again = forest.fit_forest(points.repartition(7, "a"), FEATURES, 50)
    order = ["tree", "node"]
    assert again.orderBy(order).collect() == nodes.orderBy(order).collect()
    other = forest.fit_forest(points, FEATURES, 50, seed=43)
    assert other.orderBy(order).collect() != nodes.orderBy(order).collect()


def test_the_smallest_lots_are_drawn_at_every_size(spark):
    """One rule whatever the number of rows: no threshold that could round to zero."""
    df = spark.range(30_000).select(F.col("id").alias("event_id"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    table = forest.fit_forest(df, ["a", "b"], 4, sample=8).toPandas()
    assert table["tree"].nunique() == 4 and set(table["size"]) == {8}
    lots = forest._draw(np.arange(2**41, 2**41 + 1000), 3, 42)
    assert len(np.unique(lots)) == 1000 and lots.min() >= 0 and lots.max() > 2**60
    rows = df.orderBy("event_id").toPandas()
    one = forest.fit_forest(df.where(F.col("event_id").isin(
        [int(i) for t in range(4) for i in np.argsort(forest._draw(rows["event_id"].to_numpy(), t, 42))[:8]])), ["a", "b"], 4, sample=8)
    order = ["tree", "node"]
    assert one.toPandas().sort_values(order).reset_index(drop=True).equals(table.sort_values(order).reset_index(drop=True))


def test_no_usable_row_gives_no_model_and_no_score(spark):
    df = spark.createDataFrame([(1, None, 1.0)], "event_id bigint, a double, b double")
    nodes = forest.fit_forest(df, ["a", "b"], 5)
    scored = forest.score_forest(df, nodes, ["a", "b"])
    assert nodes.count() == 0 and scored.first()["score"] is None
    assert forest.forest_offset(scored, 0.1) is None
    assert forest.decide(scored, None).where("decision < 0").count() == 0


def test_one_feature_and_few_rows(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(20)], "event_id bigint, a double")
    nodes = forest.fit_forest(df, ["a"], 30)
    got = [r["score"] for r in forest.score_forest(df, nodes, ["a"]).collect()]
    assert set(nodes.toPandas()["size"]) == {20}
    # Scaled by the 20 rows that the trees have seen, ordinary points lie near -0.5.
    assert -0.62 < sum(got) / len(got) < -0.4


def test_save_and_load(spark, points, nodes):
    path = shared_dir(spark, "model")
    forest.save_forest(nodes, -0.5, FEATURES, path)
    again, offset, features = forest.load_forest(spark, path)
    assert (offset, features) == (-0.5, FEATURES)
    assert scores(points, again) == scores(points, nodes)


def test_growth_isolates_every_point_without_a_limit():
    rng = np.random.default_rng(2)
    values = rng.random((64, 3))
    paths, leaves, (_, node, feature, split, path, _, _) = forest.grow(values, np.array([64]), np.array([7]), np.array([60]))
    assert (feature < 0).sum() == 64
    # Walking down the stored nodes reaches the same path lengths.
    table = dict(zip(node.tolist(), zip(feature, split, path)))
    for value, expected, leaf in zip(values, paths, leaves):
        at = 1
        while table[at][0] >= 0:
            at = 2 * at + int(value[table[at][0]] > table[at][1])
        assert table[at][2] == expected and at == leaf


def test_mean_path_is_near_its_theory():
    rng = np.random.default_rng(4)
    n, trees = 256, 200
    values = np.tile(rng.random((n, 4)), (trees, 1))
    paths, _, _ = forest.grow(values, np.full(trees, n), np.arange(trees) * 31, np.full(trees, 60))
    assert paths.mean() == pytest.approx(float(forest.average_path(np.array([n]))[0]), rel=0.03)


def test_per_message_gate_and_outlier(spark):
    rng = np.random.default_rng(6)
    rows = [(i, 1, float(x), float(y), 1.0) for i, (x, y) in enumerate(rng.normal(size=(60, 2)))]
    rows[55] = (55, 1, 50.0, 50.0, 1.0)
    df = spark.createDataFrame(rows, "event_id bigint, agent_id bigint, a double, b double, c double").withColumn(
        "ts", F.timestamp_seconds(F.col("event_id")).cast("timestamp_ntz"))

    def decide(frame):
        return {r["event_id"]: r["decision"] for r in forest.per_message_decision(frame, FEATURES, 50, 50, 0.1).collect()}
    got = decide(df)
    assert sorted(got) == list(range(50, 60))
    assert min(got, key=got.get) == 55 and got[55] < 0
    assert decide(df.repartition(5)) == got

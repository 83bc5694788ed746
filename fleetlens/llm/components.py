"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a minimum per node (combined before the shuffle) and a join; no list of neighbours is built, so a node of
any degree is fine. Each round is written to the shared folder. Rounds grow with the logarithm of the component size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.session import stored


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = stored(down.groupBy("u").agg(F.min("v").alias("m")), "components-least")
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node), for every node of ``edges`` (two long columns); loops and repeats are fine."""
    u, v = edges.columns
    now = stored(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct(), "components")
    before = _state(now)
    for _ in range(rounds):
        if not before[0]:
            break
        now = stored(_small_star(stored(_large_star(now), "components")), "components")
        state = _state(now)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )

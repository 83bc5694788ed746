"""Isolation forest after Liu, Ting and Zhou (2008).

Two uses:

* ``fit_forest`` / ``score_forest``: one forest for a slice of telemetry. Trees are grown
  on small samples in parallel, the node table is small, and every snapshot is scored by a
  vectorised lookup. This is the form for large data.
* ``per_message_decision``: refit on the last entries of the agent for every message. Exact
  to the per-message rule, but each message costs a whole forest; ``moving_forest`` gives the
  same rows from trees that follow the window.

Random numbers are hashes of (seed, tree, node), so results do not depend on how the rows
are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from fleetlens.operators.detect import IDS
from fleetlens.operators.quantiles import exact_quantiles
from fleetlens.operators.slices import AGENT_SERIES, Order, trailing
from fleetlens.session import written

SAMPLE = 256
NODES = "tree int, node int, feature int, split double, path double, size int"
EULER = 0.5772156649015329


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    many = np.maximum(n, 3.0) - 1.0
    return np.where(n > 2, 2.0 * (np.log(many) + EULER) - 2.0 * many / (many + 1.0), np.where(n == 2, 1.0, 0.0))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 mixing function."""
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def _uniform(seed: np.ndarray, node: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) from integer keys."""
    with np.errstate(over="ignore"):
        x = seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + node.astype(np.uint64) * np.uint64(2) + np.uint64(salt)
    return (_mixed(x) >> np.uint64(11)).astype(float) / float(1 << 53)


def _draw(ident: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """The lot of each row for a tree: 62 bits, whatever the number of rows."""
    with np.errstate(over="ignore"):
        x = ident.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + tree) % (1 << 64))
    return (_mixed(_mixed(x)) >> np.uint64(2)).astype(np.int64)


def varying_within(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which features vary among the points of each tree."""
    starts = np.cumsum(sizes) - sizes
    if not len(points):
        return np.zeros((len(sizes), points.shape[1]), dtype=bool)
    return np.maximum.reduceat(points, starts) > np.minimum.reduceat(points, starts)


def grow(points: np.ndarray, sizes: np.ndarray, seeds: np.ndarray, limits: np.ndarray,
         top: np.ndarray | None = None, varying: np.ndarray | None = None):
    """Split the points of many trees level by level.

    The points of a tree follow each other, one at least; ``sizes``, ``seeds`` and ``limits`` are per tree. To grow a part of a
    tree again, ``top`` is the node that the points belong to and ``varying`` tells which features vary in the whole tree.
    What grows below a node depends on its points, its number and the varying features only.
    Returns the path length and the leaf per point, and the nodes (tree, node, feature, split, path, low, high); the
    children of node ``k`` are ``2k`` and ``2k + 1``, leaves have feature -1. ``low`` and ``high`` bound the chosen feature
    within the node; they are NaN for leaves and where the feature was drawn again.
    """
    paths, rows = np.zeros(len(points)), np.arange(len(points))
    leaves = np.zeros(len(points), dtype=np.int64)
    tree, node = np.arange(len(sizes)), np.ones(len(sizes), dtype=np.int64) if top is None else top
    varying = varying_within(points, sizes) if varying is None else varying
    choices, n_choices = np.argsort(~varying, axis=1, kind="stable"), varying.sum(axis=1)
    found: list[tuple[np.ndarray, ...]] = []
    depth = np.frexp(node)[1] - 1
    while len(rows):
        starts, member = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        seed = seeds[tree]
        may_split = (sizes > 1) & (depth < limits[tree])
        feature = choices[tree, np.floor(_uniform(seed, node, 0) * n_choices[tree]).astype(int)]
        value = points[rows, feature[member]]
        low, high = np.minimum.reduceat(value, starts), np.maximum.reduceat(value, starts)
        constant = may_split & ~(low < high)
        if constant.any():
            # Draw again, among the features that vary within the node.
            inside, n = constant[member], sizes[constant]
            values, at = points[rows[inside]], np.cumsum(n) - n
            lows, highs = np.minimum.reduceat(values, at), np.maximum.reduceat(values, at)
            varies = highs > lows
            pick = np.floor(_uniform(seed[constant], node[constant], 2) * varies.sum(axis=1))
            chosen = ((np.cumsum(varies, axis=1) > pick[:, None]) & varies).argmax(axis=1)
            one = np.arange(len(chosen))
            feature[constant], low[constant], high[constant] = chosen, lows[one, chosen], highs[one, chosen]
            value[inside] = values[np.arange(len(values)), np.repeat(chosen, n)]
        splits = may_split & (high > low) & np.isfinite(low) & np.isfinite(high)
        cut = np.minimum(low + _uniform(seed, node, 1) * (high - low), np.nextafter(high, low))
        path = depth + average_path(sizes)
        firm = splits & ~constant
        found.append((tree, node, np.where(splits, feature, -1), np.where(splits, cut, 0.0), path,
                      np.where(firm, low, np.nan), np.where(firm, high, np.nan)))
        kept = splits[member]
        paths[rows[~kept]], leaves[rows[~kept]] = path[member[~kept]], node[member[~kept]]
        if not kept.any():
            break
        # Both children of a node are never empty. Left points move before right ones.
        left, rows, n = (value <= cut[member])[kept], rows[kept], sizes[splits]
        starts, member = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        seen = np.cumsum(left)
        lefts = seen - (seen - left)[starts][member]
        n_left = np.add.reduceat(left.astype(int), starts)
        place = np.arange(len(rows)) - starts[member]
        target = starts[member] + np.where(left, lefts - 1, n_left[member] + place - lefts)
        moved = np.empty_like(rows)
        moved[target] = rows
        rows, sizes = moved, np.column_stack([n_left, n - n_left]).ravel()
        tree, node = np.repeat(tree[splits], 2), np.column_stack([2 * node[splits], 2 * node[splits] + 1]).ravel()
        depth = np.repeat(depth[splits] + 1, 2)
    return paths, leaves, [np.concatenate(column) for column in zip(*found)]


def depth_limit(n: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.maximum(n, 2))).astype(int)


def tree_seeds(trees: int, seed: int) -> np.ndarray:
    """The seeds of the trees over the last entries of an agent."""
    return seed * 1009 + np.arange(trees)


def complete_in(features: list[str]) -> Column:
    out = F.lit(True)
    for name in features:
        out = out & F.col(name).isNotNull()
    return out


def fit_forest(df: DataFrame, features: list[str], trees: int, sample: int = SAMPLE, seed: int = 42,
               ident: str = "event_id") -> DataFrame:
    """The node table of a forest: each tree grows on the ``sample`` rows with the smallest lots, or on all if there are fewer.

    The rule is the same at every size. Each task passes on its smallest lots per tree, so ``trees`` x ``sample`` rows
    at most leave a task. Without usable rows the table is empty.
    """
    usable = df.where(complete_in(features)).select(F.col(ident).cast("bigint").alias(ident), *[F.col(f).cast("double").alias(f) for f in features])

    def smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame | None] = [None] * trees
        for batch in batches:
            for tree in range(trees):
                lots = _draw(batch[ident].to_numpy(), tree, seed)
                if held[tree] is not None and len(held[tree]) >= sample:
                    some = lots <= held[tree]["lot"].iloc[-1]
                    if not some.any():
                        continue
                    rows = batch[some].assign(lot=lots[some])
                else:
                    rows = batch.assign(lot=lots)
                both = rows if held[tree] is None else pd.concat([held[tree], rows])
                held[tree] = both.sort_values(["lot", ident], kind="stable").head(sample)
        for tree, rows in enumerate(held):
            if rows is not None and len(rows):
                yield rows.assign(tree=tree)

    columns = ", ".join([f"`{ident}` bigint", *[f"`{f}` double" for f in features], "lot bigint, tree int"])
    drawn = usable.mapInPandas(smallest, columns)
    by_tree = Window.partitionBy("tree").orderBy("lot", ident)
    drawn = drawn.withColumn("_rank", F.row_number().over(by_tree)).where(F.col("_rank") <= sample)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(ident)
        number = int(rows["tree"].iloc[0])
        size, key = np.array([len(rows)]), np.array([seed * 1_000_003 + number])
        _, _, nodes = grow(rows[features].to_numpy(float), size, key, depth_limit(size))
        _, node, feature, split, path, _, _ = nodes
        return pd.DataFrame({
            "tree": number, "node": node, "feature": feature, "split": split, "path": path, "size": len(rows),
        })

    return drawn.groupBy("tree").applyInPandas(build, NODES)


def score_forest(df: DataFrame, nodes: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``score``: near -1 for isolated rows, near 0 for ordinary ones, NULL for incomplete rows and for an empty forest.

    The node table is collected: it has at most trees x (2 x sample - 1) rows. Scores are scaled by the number of rows
    that the trees were grown on.
    """
    spark = df.sparkSession
    table = nodes.toPandas()
    if not len(table):
        return df.withColumn("score", F.lit(None).cast("double"))
    trees = sorted(table["tree"].unique())
    width = int(table["node"].max()) + 1
    feature = np.full((len(trees), width), -1, dtype=np.int32)
    split, path = np.zeros((len(trees), width)), np.zeros((len(trees), width))
    at = (np.searchsorted(trees, table["tree"]), table["node"].to_numpy())
    feature[at], split[at], path[at] = table["feature"], table["split"], table["path"]
    model = spark.sparkContext.broadcast((feature, split, path))
    scale = float(average_path(np.array([table["size"].max()]))[0]) or 1.0

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        feature, split, path = model.value
        base = np.arange(len(feature)) * feature.shape[1]
        flat_feature, flat_split, flat_path = feature.ravel(), split.ravel(), path.ravel()
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)  # one feature comes alone
            values = np.column_stack([c.to_numpy(float) for c in columns])
            node = np.ones((len(values), len(feature)), dtype=np.int64)
            while True:
                chosen = flat_feature[base + node]
                inner = chosen >= 0
                if not inner.any():
                    break
                value = np.take_along_axis(values, np.maximum(chosen, 0), axis=1)
                node = np.where(inner, 2 * node + (value > flat_split[base + node]), node)
            yield pd.Series(-np.exp2(-flat_path[base + node].mean(axis=1) / scale))

    whole = complete_in(features)
    inputs = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    # Declared nondeterministic so that later uses of the column do not score again.
    return df.withColumn("score", score.asNondeterministic()(*inputs)).withColumn("score", F.when(whole, F.col("score")))


def forest_offset(scored: DataFrame, contamination: float) -> float | None:
    """The score below which the given share of the training rows lies; None without scores."""
    found = exact_quantiles(scored, ["score"], {"q": contamination}).first()
    return found["q"] if found else None


def window_decisions(paths: np.ndarray, present: np.ndarray, last: int | np.ndarray, share: float) -> np.ndarray:
    """How far the score of row ``last`` of each window lies above the quantile ``share`` of the scores in it.

    ``paths`` is windows x trees x rows, ``present`` windows x rows. The quantile is interpolated.
    """
    n = present.sum(axis=1)
    scores = -np.exp2(-paths.mean(axis=1) / average_path(n)[:, None])
    ranked = np.sort(np.where(present, scores, np.inf), axis=1)
    place, each = share * (n - 1), np.arange(len(n))
    below = np.floor(place).astype(int)
    lower, upper = ranked[each, below], ranked[each, np.minimum(below + 1, n - 1)]
    return scores[each, last] - (lower + (upper - lower) * (place - below))


def decide(scored: DataFrame, offset: float | None) -> DataFrame:
    return scored.withColumn("decision", F.col("score") - F.lit(offset).cast("double"))


def forest_anomalies(decided: DataFrame, kind: str, description: str, action: str, high_below: float) -> DataFrame:
    """Anomaly records for the rows with a negative decision."""
    return decided.where(F.col("decision") < 0).select(
        *IDS, F.lit(kind).alias("type"),
        F.when(F.col("decision") < high_below, "high").otherwise("medium").alias("severity"),
        F.col("decision").alias("score"), F.lit(None).cast("double").alias("value"),
        F.lit(None).cast("double").alias("threshold"), F.lit(description).alias("description"),
        F.lit(action).alias("suggested_action"),
    )


def detect_with_forest(df: DataFrame, features: list[str], trees: int, contamination: float) -> DataFrame:
    """Fit on ``df`` and decide on every row of it.

    The features are read for the fit and again for the scores, and the scores twice, so
    both are stored instead of computed anew.
    """
    rows = written(df.select(*IDS, *features), "features")
    nodes = written(fit_forest(rows, features, trees), "forest")
    scored = written(score_forest(rows, nodes, features).select(*IDS, "score"), "scores")
    return decide(scored, forest_offset(scored, contamination))


def save_forest(nodes: DataFrame, offset: float | None, features: list[str], path: str) -> None:
    spark = nodes.sparkSession
    nodes.write.mode("errorifexists").parquet(f"{path}/nodes")
    meta = spark.createDataFrame([(offset, features)], "offset double, features array<string>")
    meta.write.mode("errorifexists").parquet(f"{path}/meta")


def load_forest(spark: SparkSession, path: str) -> tuple[DataFrame, float | None, list[str]]:
    meta = spark.read.parquet(f"{path}/meta").first()
    return spark.read.schema(NODES).parquet(f"{path}/nodes"), meta["offset"], list(meta["features"])


def per_message_decision(df: DataFrame, features: list[str], trees: int, depth: int, contamination: float,
                         seed: int = 42, order: Order = AGENT_SERIES) -> DataFrame:
    """Decision per message from a forest fitted on the last ``depth`` entries of its agent.

    Needs more than ``depth`` entries of history and more than 10 complete ones. The draws are the same for every window.
    ``moving_forest.decisions`` gives the same rows and grows only what changes from one message to the next.
    """
    entry = F.when(complete_in(features), F.array(*[F.col(f).cast("double") for f in features]))

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumns({
            "_history": F.count("*").over(w.rowsBetween(-depth, 0)),
            "_entries": F.collect_list(entry).over(w.rowsBetween(1 - depth, 0)),
        })

    width = len(features)

    @F.pandas_udf("double")
    def decision(entries: pd.Series) -> pd.Series:
        out = np.empty(len(entries))
        windows = [np.asarray(e, dtype=float).reshape(-1, width) for e in entries]
        lengths = np.array([len(w) for w in windows], dtype=int)
        for n in np.unique(lengths):
            same = np.flatnonzero(lengths == n)
            for at in (same[i:i + 16] for i in range(0, len(same), 16)):
                sizes = np.full(len(at) * trees, n)
                points = np.concatenate([np.tile(windows[i], (trees, 1)) for i in at])
                paths, _, _ = grow(points, sizes, np.tile(tree_seeds(trees, seed), len(at)), depth_limit(sizes))
                out[at] = window_decisions(paths.reshape(len(at), trees, n), np.ones((len(at), n), dtype=bool), n - 1, contamination)
        return pd.Series(out)

    rows = trailing(df.select(*IDS, *features), depth + 1, build, order)
    ready = (F.col("_history") > depth) & (F.size("_entries") > 10) & complete_in(features)
    # Fitting costs far more than moving the rows, so spread them evenly, whatever their agent.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.where(ready).select(*IDS, F.flatten("_entries").alias("_entries")).repartition(parts, "event_id")
    return spread.select(*IDS, decision.asNondeterministic()("_entries").alias("decision"))

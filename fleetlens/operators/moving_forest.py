"""Isolation forests over the last entries of an agent, updated from message to message instead of grown anew.

Two following windows differ by one row in and one row out. The draws of a node depend on its tree and its number only, so
a node keeps its cut as long as the bounds of its feature hold: a row that lies strictly inside them may leave, and one that
does not lie outside may enter. Below the first node where this fails, the tree grows again from the rows that lie there;
everything else stays. The trees are those that ``forest.per_message_decision`` grows, and so are the decisions.

Series are cut into short stretches, each led by the window before it, so the work spreads evenly whatever the agent.
A task advances ``LANES`` stretches in step, all trees of all of them in one numpy call.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from fleetlens.operators.detect import IDS
from fleetlens.operators.forest import complete_in, depth_limit, grow, tree_seeds, window_decisions
from fleetlens.operators.slices import AGENT_SERIES, SLICE, Order, trailing

STRETCH, LANES = 256, 32
LEAST = 11  # complete entries that a window needs


class MovingTrees:
    """The trees over one window of rows per lane. A row stays in its slot until it leaves the window.

    ``place`` is the leaf of each row, shifted to the last level, so that the nodes above it are its leading bits.
    """

    def __init__(self, lanes: int, window: int, width: int, seeds: np.ndarray):
        self.levels = int(depth_limit(np.array([window]))[0])
        self.seeds = seeds
        self.level_of = np.frexp(np.arange(2 << self.levels))[1] - 1
        self.rows = np.zeros((lanes, window, width))
        self.present = np.zeros((lanes, window), dtype=bool)
        self.varying = np.zeros((lanes, width), dtype=bool)
        self.place = np.full((lanes, len(seeds), window), 1 << self.levels, dtype=np.int16 if self.levels < 14 else np.int64)
        self.paths = np.zeros((lanes, len(seeds), window))
        nodes = (lanes, len(seeds), 2 << self.levels)
        self.feature = np.zeros(nodes, dtype=np.int16)
        self.split, self.low, self.high = (np.full(nodes, np.nan) for _ in range(3))

    def _vary(self, lanes: int) -> np.ndarray:
        rows, present = self.rows[:lanes], self.present[:lanes, :, None]
        return np.where(present, rows, -np.inf).max(axis=1) > np.where(present, rows, np.inf).min(axis=1)

    def _below(self, lane: np.ndarray, tree: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Which slots hold a row that lies in a node."""
        shift = (self.levels - self.level_of[node]).astype(self.place.dtype)
        return (self.place[lane, tree] >> shift[:, None] == node.astype(self.place.dtype)[:, None]) & self.present[lane]

    def _walk(self, lane: np.ndarray, tree: np.ndarray, values: np.ndarray, stays, stop: np.ndarray | None = None) -> np.ndarray:
        """Per (lane, tree), the first node that must grow again as ``values`` (per lane) leave or enter.

        ``stays(value, low, high)`` tells whether the bounds of a node hold. Nodes of ``stop`` end a walk.
        """
        nodes = self.low.shape[2]
        base = (lane * len(self.seeds) + tree) * nodes  # positions in the flat tables
        first = lane * values.shape[1]
        feature, split, low, high, values = (x.reshape(-1) for x in (self.feature, self.split, self.low, self.high, values))
        node, out, active = np.ones(len(lane), dtype=np.int64), np.zeros(len(lane), dtype=np.int64), np.arange(len(lane))
        for _ in range(self.levels + 1):
            at = base + node
            value = values[first + np.maximum(feature[at], 0)]
            on = stays(value, low[at], high[at])
            if stop is not None:
                on &= node != stop[active]
            out[active[~on]] = node[~on]
            node = (2 * node + (value > split[at]))[on]
            active, base, first = active[on], base[on], first[on]
        return out

    def _left(self, lane: np.ndarray, tree: np.ndarray, values: np.ndarray) -> np.ndarray:
        return self._walk(lane, tree, values, lambda value, low, high: (value > low) & (value < high))

    def _entered(self, lane: np.ndarray, tree: np.ndarray, values: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return self._walk(lane, tree, values, lambda value, low, high: (value >= low) & (value <= high), stop)

    def move(self, lanes: int, slot: int, values: np.ndarray, complete: np.ndarray, anew: bool = False) -> int:
        """Replace the row in ``slot`` of the first ``lanes`` lanes; incomplete rows leave the slot empty.

        Trees grow again from the root if ``anew``, and where the depth allowed or the features that vary within the window
        change. Returns the number of rows that were placed again.
        """
        left, old = self.present[:lanes, slot].copy(), self.rows[:lanes, slot].copy()
        before = self.present[:lanes].sum(axis=1)
        self.present[:lanes, slot] = complete
        self.rows[:lanes, slot] = np.where(complete[:, None], values, 0.0)
        after, varying = self.present[:lanes].sum(axis=1), self._vary(lanes)
        limits = depth_limit(after)
        whole = (before < 2) | (after < 2) | (limits != depth_limit(before)) | (varying != self.varying[:lanes]).any(axis=1) | anew
        self.varying[:lanes] = varying

        trees = np.arange(len(self.seeds))
        top, new = np.zeros((lanes, len(trees)), dtype=np.int64), np.zeros((lanes, len(trees)), dtype=np.int64)
        some = np.flatnonzero(left & ~whole)
        if len(some):
            top[some] = self._left(np.repeat(some, len(trees)), np.tile(trees, len(some)), old).reshape(-1, len(trees))
        some = np.flatnonzero(complete & ~whole)
        if len(some):
            new[some] = self._entered(
                np.repeat(some, len(trees)), np.tile(trees, len(some)), values, top[some].ravel()).reshape(-1, len(trees))
        top[whole] = 1
        reached = np.maximum(new, 1)
        self.place[:lanes, :, slot] = reached << (self.levels - self.level_of[reached])
        # Where the row enters above the node that another left, the upper node covers both.
        deeper = np.maximum(self.level_of[top] - self.level_of[reached], 0)
        top[(new > 0) & (top >> deeper == new)] = 0

        lane, tree = (np.concatenate(pair) for pair in zip(np.nonzero(top), np.nonzero(new)))
        node = np.concatenate([top[top > 0], new[new > 0]])
        below = self._below(lane, tree, node)
        sizes = below.sum(axis=1)
        some = sizes > 0
        if not some.any():
            return 0
        lane, tree, node, below, sizes = lane[some], tree[some], node[some], below[some], sizes[some]
        group, slots = np.nonzero(below)
        of = (lane[group], tree[group], slots)
        paths, leaves, nodes = grow(self.rows[of[0], slots], sizes, self.seeds[tree], limits[lane], node, varying[lane])
        self.paths[of], self.place[of] = paths, leaves << (self.levels - self.level_of[leaves])
        member, node, feature, split, _, low, high = nodes
        at = (lane[member], tree[member], node)
        self.feature[at], self.split[at], self.low[at], self.high[at] = feature, split, low, high
        return len(group)


def follow(stretches: list[tuple[np.ndarray, np.ndarray]], window: int, seeds: np.ndarray, share: float) -> list[np.ndarray]:
    """The decision on every row after the first ``window`` of each stretch of (rows, complete); NaN for those without one."""
    order = sorted(range(len(stretches)), key=lambda i: -len(stretches[i][0]))
    held = [stretches[i] for i in order]
    lengths = np.array([len(rows) - window for rows, _ in held])
    out = [np.full(max(n, 0), np.nan) for n in lengths]
    held = [held[i] for i in range(len(held)) if lengths[i] > 0]
    if held:
        trees = MovingTrees(len(held), window, held[0][0].shape[1], seeds)
        for lane, (rows, complete) in enumerate(held):
            # The first decision is on row ``window``, whose window starts with row 1.
            trees.present[lane, :-1] = complete[1:window]
            trees.rows[lane, :-1] = np.where(complete[1:window, None], rows[1:window], 0.0)
        for step in range(lengths[0]):
            lanes, slot = int((lengths > step).sum()), (window - 1 + step) % window
            complete = np.array([held[i][1][window + step] for i in range(lanes)])
            values = np.array([held[i][0][window + step] for i in range(lanes)])
            trees.move(lanes, slot, values, complete, anew=step == 0)
            present = trees.present[:lanes]
            ready = np.flatnonzero(complete & (present.sum(axis=1) >= LEAST))
            for lane, value in zip(ready, window_decisions(trees.paths[ready], present[ready], slot, share)):
                out[lane][step] = value
    back = [np.empty(0)] * len(order)
    for place, i in enumerate(order):
        back[i] = out[place]
    return back


def decisions(df: DataFrame, features: list[str], trees: int, depth: int, contamination: float,
              seed: int = 42, order: Order = AGENT_SERIES) -> DataFrame:
    """What ``forest.per_message_decision`` gives, from trees that follow the window.

    Needs more than ``depth`` entries of history and more than 10 complete ones. Rows with an absent feature keep their
    place in the window but are in no tree and have no decision; an empty table gives none.
    """
    stretch, seeds = max(STRETCH, depth), tree_seeds(trees, seed)
    keys, parts = list(order.keys), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def in_step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def decided(rows: pd.DataFrame) -> pd.DataFrame:
            """``rows`` are whole stretches."""
            values, complete = rows[features].to_numpy(float), rows["_complete"].to_numpy(bool)
            starts = np.flatnonzero(rows["_at"].to_numpy() == 0)
            bounds = list(zip(starts, [*starts[1:], len(rows)]))
            found = follow([(values[a:b], complete[a:b]) for a, b in bounds], depth, seeds, contamination)
            kept = np.concatenate([np.arange(min(a + depth, b), b) for a, b in bounds])
            out = rows.iloc[kept][list(IDS)].assign(decision=np.concatenate(found))
            return out[out["decision"].notna()]

        waiting: list[pd.DataFrame] = []
        begun = 0
        for batch in batches:
            starts = np.flatnonzero(batch["_at"].to_numpy() == 0)
            first = 0
            for start in starts:
                if begun == LANES:
                    waiting.append(batch.iloc[first:start])
                    yield decided(pd.concat(waiting))
                    waiting, first, begun = [], start, 0
                begun += 1
            waiting.append(batch.iloc[first:])
        if begun:
            yield decided(pd.concat(waiting))

    kinds = {f.name: f.dataType.simpleString() for f in df.select(*IDS).schema}
    columns = ", ".join([*[f"`{name}` {kind}" for name, kind in kinds.items()], "decision double"])

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        at = F.row_number().over(w) - 1
        number, inside = F.floor(F.col("_at") / stretch), F.col("_at") % stretch
        # The last rows of a stretch lead the next one too.
        own = F.struct(number.alias("stretch"), (inside + F.when(number > 0, depth).otherwise(0)).alias("at"))
        lead = F.struct((number + 1).alias("stretch"), (inside - (stretch - depth)).alias("at"))
        both = F.when(inside >= stretch - depth, F.array(own, lead)).otherwise(F.array(own))
        dealt = rows.withColumn("_at", at).withColumn("_in", F.explode(both)).select(
            *IDS, *features, complete_in(features).alias("_complete"), *[F.col(k).alias(f"_key_{k}") for k in keys], SLICE,
            F.col("_in.stretch").alias("_stretch"), F.col("_in.at").alias("_at"))
        of = [*[f"_key_{k}" for k in keys], SLICE, "_stretch"]
        found = dealt.repartition(parts, *of).sortWithinPartitions(*of, "_at").mapInPandas(in_step, columns)
        return found.withColumns({SLICE: F.lit(0), "_copy": F.lit(False)})  # leading rows are gone already

    return trailing(df.select(*IDS, *[F.col(f).cast("double").alias(f) for f in features]), depth + 1, build, order)

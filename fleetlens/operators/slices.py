"""Per-key ordered windows that survive a key holding a large share of all rows.

A plain ``Window.partitionBy(agent).orderBy(ts)`` puts all rows of an agent into one task. Here every key is cut into
consecutive time slices of about ``fleetlens.rowsPerTask`` rows, and windows run per (key, slice):

* ``trailing``: frames that look back a fixed number of rows. The last rows before each slice are copied into it, so
  every frame is complete.
* ``running``: sums from the start of a key. Each slice adds the total of the slices before it.

Both give exactly the result of the plain window. The plan is one and the same at every size and is built without
running a job: rows are counted per key and time bucket, the counts give the starts of slices, and those of the keys
that have more than one are broadcast. A slice other than a key's last holds the limit at least, so there are at most
rows / limit of them, however many keys or rows there are. No slice holds more than the limit and one bucket.

Rows without time come first in their key, as in the plain window. The identifier must be an integer column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fleetlens.session import rows_per_task

SLICE = "_slice"
BUCKET_KEY, BUCKET_S = "fleetlens.bucketSeconds", 600


@dataclass(frozen=True)
class Order:
    """What a series is: its key columns, its time column and a tie-breaking integer id."""

    keys: tuple[str, ...] = ("agent_id",)
    ts: str = "ts"
    ident: str = "event_id"

    def window(self, *extra: str) -> WindowSpec:
        return Window.partitionBy(*self.keys, *extra).orderBy(self.ts, self.ident)


AGENT_SERIES = Order()


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch (the session time zone is pinned to UTC)."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def _reached(starts: Column, at: Column) -> Column:
    """How many of the sorted ``starts`` are at most ``at``, by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(starts, n + step - 1) <= at, n + step).otherwise(n))


def cut_keys(df: DataFrame, order: Order) -> DataFrame:
    """``df`` with the number of each row's slice, and whether its key has more than one."""
    spark = df.sparkSession
    limit = rows_per_task(spark)
    width = int(spark.conf.get(BUCKET_KEY, str(BUCKET_S))) * 1_000_000
    keys = list(order.keys)
    bucket = F.floor(micros(order.ts) / F.lit(width))
    counts = df.groupBy(*keys, bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    slices = counts.withColumn(SLICE, F.floor((upto - F.col("_n")) / limit)).where(F.col(SLICE) > 0)
    starts = slices.groupBy(*keys, SLICE).agg(F.min("_bucket").alias("_start"))
    starts = starts.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.sort_array(F.collect_list("_start")).alias("_starts"))
    same = reduce(and_, [F.col(k) == F.col(f"_key_{k}") for k in keys])
    return df.join(F.broadcast(starts), same, "left").select(
        *df.columns, F.coalesce(_reached(F.col("_starts"), bucket), F.lit(0)).alias(SLICE), F.col("_starts").isNotNull().alias("_cut"))


def trailing(
    df: DataFrame,
    depth: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    order: Order = AGENT_SERIES,
) -> DataFrame:
    """Apply ``build(df, window)``, whose frames reach at most ``depth - 1`` rows back."""
    cut = cut_keys(df, order)
    keys = list(order.keys)
    heavy = cut.where("_cut")

    # Last rows of every slice, numbered from its end. The rank filter runs before the shuffle.
    from_end = Window.partitionBy(*keys, SLICE).orderBy(F.desc(order.ts), F.desc(order.ident))
    tails = heavy.withColumn("_back", F.row_number().over(from_end)).where(F.col("_back") < depth)

    # Per slice: the slices after it that still see its tail, with the rows lying in between.
    by_slice = Window.partitionBy(*keys).orderBy(SLICE)
    ends = heavy.groupBy(*keys, SLICE).agg(F.count("*").alias("_n"))
    ends = ends.withColumn("_end", F.sum("_n").over(by_slice.rowsBetween(Window.unboundedPreceding, 0)))
    after = F.collect_list(F.struct(F.col(SLICE).alias("to"), (F.col("_end") - F.col("_n")).alias("start")))
    ends = ends.withColumn("_after", after.over(by_slice.rowsBetween(1, depth - 1)))
    copies = (
        tails.join(F.broadcast(ends.select(*keys, SLICE, "_end", "_after")), [*keys, SLICE])  # a row per slice
        .withColumn("_target", F.explode("_after"))
        .where(F.col("_target.start") - F.col("_end") + F.col("_back") < depth)
        .withColumn(SLICE, F.col("_target.to"))
        .select(*df.columns, SLICE, F.lit(True).alias("_copy"))
    )
    both = cut.drop("_cut").withColumn("_copy", F.lit(False)).unionByName(copies)
    return build(both, order.window(SLICE)).where(~F.col("_copy")).drop("_copy", SLICE)


def running(df: DataFrame, sums: dict[str, Column], order: Order = AGENT_SERIES) -> DataFrame:
    """Add running sums per key, each including the current row."""
    cut = cut_keys(df, order)
    keys = list(order.keys)
    totals = cut.where("_cut").groupBy(*keys, SLICE).agg(
        *[F.sum(value).alias(f"_before_{name}") for name, value in sums.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"_before_{name}": F.sum(f"_before_{name}").over(earlier) for name in sums})
    w = order.window(SLICE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = cut.withColumns({name: F.sum(value).over(w) for name, value in sums.items()})
    return (
        within.join(F.broadcast(totals), [*keys, SLICE], "left")  # a row per slice
        .withColumns({name: F.col(name) + F.coalesce(F.col(f"_before_{name}"), F.lit(0)) for name in sums})
        .select(*df.columns, *sums)
    )


def numbered(df: DataFrame, name: str, order: Order = AGENT_SERIES) -> DataFrame:
    """Position of each row in its series, from 0."""
    return running(df, {name: F.lit(1).cast("bigint")}, order).withColumn(name, F.col(name) - 1)

"""Mixing sources to target weights: a target per source, a repetition rate, and a whole number of copies of each document.

1. The words of all documents are summed by source.
2. Sources take weights in turn, by code point of their names. ``SHARE`` of all words is split by weight; a target stops at ``LIMIT``
   times its source's words, and what is left over is split again by weight among the others until none is above. That is one
   level: every target is its weight times the level or its limit, whichever is less. In order of limit by weight, the sources
   below the level come first, so running sums give it.
3. A document is emitted floor(rate) times, rate being target by words of its source, and once more with a probability equal to the
   fraction. The draw is a hash of seed, id and text, so a rerun, a retry or another partitioning makes the same copies.

A source's copies add up to its target in expectation; a draw decides on a whole document, so the deviation is that of its longest
documents, and a source of a few documents can miss its target by one of them.

Null text counts as empty: no words, no weight in any sum; its copies follow the rate of its source (none where the source
has no words). A null source is a source of its own, ordered last; an empty name is another. A null id draws as an empty one.
Rows that repeat both id and text draw alike. An empty table gives an empty result. Columns of any name pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.running import in_order
from fleetlens.llm.session import documents, stored

WEIGHTS, SHARE, LIMIT, SEED = (5, 2, 1), 1.5, 2, "mix-1"
SPACE = " \t\n\x0b\f\r"
DIGITS = 13  # of the digest: 52 bits, which a double holds


def n_words(text: Column) -> Column:
    """Runs of anything but white space: each becomes one letter, and the white space between them goes."""
    ones = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(ones, SPACE, "")).cast("long")


def draw(id_: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that follows from seed, id and text."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """source, source_size, target of each source; ``sizes`` holds source and size of each document."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = in_order(by_source, [F.asc_nulls_last("source")], "mix-sources")
    turn = F.array(*(F.lit(int(w)) for w in weights))
    ranked = ranked.select(
        "source", "source_size", (F.col("source_size") * limit).alias("most"),
        F.element_at(turn, (F.col("_place") % len(weights) + 1).cast("int")).cast("long").alias("weight"), F.col("_place").alias("rank"),
    ).withColumn("ratio", F.col("source_size").cast("double") / F.col("weight"))
    filled = in_order(ranked, [F.col("ratio"), F.col("rank")], "mix-levels", ["most", "weight"])
    left = ranked.agg(F.sum("source_size")).scalar() * F.lit(float(share)) - F.col("_before_most")
    room = (ranked.agg(F.sum("weight")).scalar() - F.col("_before_weight")).cast("double")
    tried = filled.withColumn("_left", left).withColumn("_room", room)
    free = tried.where(F.col("most") * F.col("_room") >= F.col("weight") * F.col("_left"))
    level = free.agg(F.min_by(F.col("_left") / F.col("_room"), "_place")).scalar()
    return ranked.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("weight") * level).alias("target"))


def with_copies(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` (with source, size and draw) and source_size, target and copies of each."""
    wanted = wanted.withColumnRenamed("source", "_of")
    joined = rows.join(wanted, rows["source"].eqNullSafe(wanted["_of"])).drop("_of")  # a hot source is split by Spark's skew join
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor("_rate") + (F.col("draw") < F.col("_rate") - F.floor("_rate")).cast("long")
    return joined.withColumn("_rate", rate).withColumn("copies", copies).drop("_rate")


def copies_of(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = WEIGHTS, share: float = SHARE, limit: int = LIMIT, seed: str = SEED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies."""
    id_, text = F.col(id_col), F.col(text_col)
    sizes = docs.select(id_.alias("doc_id"), F.col(source_col).alias("source"), n_words(text).alias("size"), draw(id_, text, seed).alias("draw"))
    sizes = stored(sizes, "mix-sizes")
    return with_copies(sizes, targets(sizes, weights, share, limit)).drop("draw")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = WEIGHTS, share: float = SHARE, limit: int = LIMIT, seed: str = SEED,
) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as it has copies."""
    id_, text = F.col(id_col), F.col(text_col)
    sizes = docs.select(F.col(source_col).alias("source"), n_words(text).alias("size"))
    wanted = targets(sizes, weights, share, limit)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(source_col).alias("source"), draw(id_, text, seed).alias("draw"))
    taken = with_copies(rows, wanted).where("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")


def op11_source_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = copies_of(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = f"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
           CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, {DIGITS}) AS BIGINT) AS DOUBLE)
               / {16**DIGITS}.0::DOUBLE AS draw
    FROM documents
), s AS (
    SELECT source, source_size, source_size * {LIMIT} AS most,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
           row_number() OVER (ORDER BY source NULLS LAST) AS rank
    FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)
), r AS (
    SELECT *, coalesce(sum(most) OVER w, 0) AS most_before, coalesce(sum(weight) OVER w, 0) AS weight_before,
           row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, rank) AS place
    FROM s WINDOW w AS (ORDER BY CAST(source_size AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
    SELECT *, CAST((SELECT sum(source_size) FROM s) AS DOUBLE) * {SHARE}::DOUBLE - CAST(most_before AS DOUBLE) AS remaining,
           CAST((SELECT sum(weight) FROM s) - weight_before AS DOUBLE) AS room
    FROM r
), l AS (SELECT arg_min(remaining / room, place) AS level FROM t WHERE most * room >= weight * remaining),
g AS (SELECT source, source_size, least(CAST(most AS DOUBLE), weight * (SELECT level FROM l)) AS target FROM s),
c AS (
    SELECT doc_id, size, source_size, target, draw, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, size * (CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM c
"""

QUERIES = {"op11_source_mixing": (op11_source_mixing, SQL)}

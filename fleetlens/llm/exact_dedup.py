"""Exact duplicates: 128-bit content hash, then a comparison of bytes inside each hash group. DataFrame functions only.

1. One pass writes a small table of id and digests; no text leaves its task.
2. Hash groups of one row are done. The texts of all others are grouped again by hash and text, so rows of equal hash
   but different bytes part. Both groupings combine before the shuffle: a group of any size sends one row per task.
3. The small table is joined with the groups that have copies.

Null text counts as empty, so all empty and null texts are copies of each other. A null id is kept only if no row of its
group has an id. Rows that repeat both id and text get the same decision. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.rows import without_rows
from fleetlens.llm.session import documents, stored
from fleetlens.llm.words import lower_az, sql_lower_az


def copy_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
    normalise: Callable[[Column], Column] = lower_az, digest: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` is "smallest" or "largest" id. ``digest`` is the grouping hash; any other one gives the same rows.
    """
    chosen = {"smallest": F.min, "largest": F.max}[keep]
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    norm = read.select("doc_id", normalise(F.col("_text")).alias("_norm"))
    small = stored(
        norm.select("doc_id", digest("_norm").alias("_hash"), F.sha2("_norm", 256).alias("text_sha256")), "exact-digests"
    )
    by_hash = stored(small.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("_hash"), "exact-hashes")

    # Texts of the rows that share a hash. The id only finds the text; the hash is computed again, as ids may repeat.
    wanted = small.join(by_hash, "_hash", "left_semi").select(F.col("doc_id").alias("_id")).distinct()
    texts = read.join(wanted.hint("shuffle_hash"), read.doc_id.eqNullSafe(wanted["_id"]), "left_semi")
    texts = texts.select("doc_id", normalise(F.col("_text")).alias("_norm")).withColumn("_hash", digest("_norm"))
    same = stored(
        texts.groupBy("_hash", "_norm").agg(F.count("*").alias("group_size"), chosen("doc_id").alias("keep_id"))
        .select("_hash", F.sha2("_norm", 256).alias("text_sha256"), "group_size", "keep_id").where("group_size > 1"),
        "exact-groups",
    )
    out = small.join(same, ["_hash", "text_sha256"], "left")
    out = out.withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    out = out.withColumn("keep_id", F.when(F.col("group_size") > 1, F.col("keep_id")).otherwise(F.col("doc_id")))
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def without_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """``docs`` with one row of each group of equal texts and all its columns; of rows that repeat id and text, one stays."""
    groups = stored(copy_groups(docs, keep=keep), "exact-decisions")
    gone = groups.where("NOT kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("key")).distinct()
    again = groups.where("kept").groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("key")).agg(F.count("*").alias("_n"))
    single = stored(again.where("_n > 1").select("id", "key"), "exact-repeats")
    return without_rows(docs, gone, single, F.sha2(lower_az(F.col("_row.text")), 256))


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return copy_groups(documents(spark, sf_dir), keep="largest")


SQL = f"""
WITH t AS (SELECT doc_id, sha256({sql_lower_az("text")}) AS text_sha256 FROM documents),
     g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""

QUERIES = {"op4_exact_dedup": (op4_exact_dedup, SQL)}

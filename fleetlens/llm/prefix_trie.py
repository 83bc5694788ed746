"""Prefix trie of conversations by van Emde Boas recursion: cut at half depth, name the cut prefixes, go on above and below at once.

A sequence is a conversation's turns. A block of 2w turns is cut into its first w and the rest. The first halves that are equal below
the same node become one row with the number of their conversations, and are named: that node is the top of the tries of the
second halves. Upper tries and all lower forests are rows of one table, so each step is one grouping of all of them, and a trie
of depth D takes log2(D) steps. In the end a row is a single turn below its parent: a node.

Totals go back in the same order. For each cut, from the highest to the lowest, the sums of every lower forest are added to
the node that it hangs from: with the forest's totals in that node, the upper trie holds all that lies below it.

Turns are compared by the first 128 bits of SHA-256 of role and text, as names of nodes are. A sequence is kept as chunks of ``CHUNK`` turns, long ones as chunks of
digests of chunks, so no row grows with a conversation; turns are ranked by range, so none fills a task either. Groups are
summed before the shuffle, so a turn that a third of all conversations share costs a row per task.

A null role or text counts as empty. Turns are in order of ``turn``, null first; equal ones in order of SHA-256 of role and text, and repeated rows
are turns of their own. Rows without conv_id belong to no conversation. An empty table has no nodes, not even a root.
Columns of other names are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.running import in_order
from fleetlens.llm.session import documents, stored

CHUNK_BITS = 6
CHUNK = 1 << CHUNK_BITS
ENDS_BITS = 12  # ids of one part of a node's list of conversations: 2**ENDS_BITS at most
HUNDRED, SHARED = 100, 6
_ROW = ["chain", "under", "at", "items", "cut", "end"]


def _name(of: Column) -> Column:
    """128 bits of a SHA-256 digest, as 22 letters."""
    return F.substring(F.base64(F.unhex(F.substring(F.sha2(of.cast("binary"), 256), 1, 32))), 1, 22)


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, token (role and text by name, then the code points of the text) and digest, which orders equal turns."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    token = F.concat(_name(said), F.lit(":"), F.length(text).cast("string"))
    digest = F.sha2(said.cast("binary"), 256)
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", token.alias("token"), digest.alias("digest"))


def with_shared_turns(turns: DataFrame, hundred: int = HUNDRED, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place, token) and lengths (conv_id, length) once each conversation starts with the first h turns of the first
    conversation of its hundred, h being a checksum of its id modulo ``shared``; its own first h turns go."""
    turns = turns.withColumn("digest", F.substring("digest", 1, 16))  # hexadecimal: keeps the order of all but one pair in 2**64
    laid = in_order(turns, [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("digest")], "trie-turns")
    # A long conversation lies in many ranges: what its rows need to know of it goes to each by range, not to one place.
    parts = stored(laid.groupBy("conv_id", "_part").agg(F.min("_place").alias("_lo"), F.count("*").alias("_n")), "trie-parts")
    convs = parts.groupBy("conv_id").agg(F.min("_lo").alias("_first"), F.sum("_n").alias("_own"))
    convs = convs.withColumn("_h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared)
    convs = convs.withColumn("_base", F.col("conv_id") - F.col("conv_id") % hundred)
    bases = convs.where("conv_id = _base").select(F.col("_base").alias("_b"), F.col("_own").alias("_b_own"))
    convs = convs.join(bases, convs["_base"] == bases["_b"], "left")
    convs = stored(convs.withColumn("_given", F.least("_h", F.coalesce("_b_own", F.lit(0)))).drop("_b", "_b_own"), "trie-convs")
    known = parts.select("conv_id", "_part").join(convs, "conv_id")
    placed = stored(laid.join(known, ["conv_id", "_part"]).withColumn("_at", F.col("_place") - F.col("_first")), "trie-places")
    own = placed.where("_at >= _h").select("conv_id", (F.col("_at") - F.col("_h") + F.col("_given")).alias("place"), "token")
    heads = placed.where((F.col("_at") < shared - 1) & (F.col("conv_id") == F.col("_base"))).select(F.col("conv_id").alias("_b"), "_at", "token")
    given = convs.where("_given > 0").join(heads, F.col("_base") == F.col("_b")).where("_at < _given")  # a base has its hundred only
    sequences = own.union(given.select("conv_id", F.col("_at").alias("place"), "token"))
    lengths = convs.select("conv_id", (F.col("_given") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0))).alias("length"))
    return sequences, lengths


def _chunks(items: DataFrame, item: str) -> DataFrame:
    """(conv_id, place, ``item``) as lists of ``CHUNK`` items, in order."""
    found = items.groupBy("conv_id", F.shiftright("place", CHUNK_BITS).alias("place")).agg(
        F.array_sort(F.collect_list(F.struct((F.col("place") % CHUNK).alias("i"), F.col(item).alias("x")))).alias("items")
    )
    return found.select("conv_id", "place", F.col("items.x").alias("items"))


def _cut(rows: DataFrame, half: int) -> DataFrame:
    """One step: blocks of up to ``2 * half`` items become blocks of up to ``half``, merged where they are equal below the same node.

    ``chain`` holds, per cut so far, the name of the node from which a row's forest hangs, or nothing for rows above the cut; ``under`` the
    last of these names. ``cut`` is the name that the last node of a row's block was given. A row with ``end`` follows
    the last turn of that conversation and is not merged.
    """
    left, right = F.slice("items", 1, half), F.slice("items", half + 1, half)
    name = _name(F.concat(F.col("under"), F.lit("/"), F.array_join(left, ",")))
    rows = rows.withColumn("_left", left).withColumn("_right", right).withColumn("_name", name)
    none, go_on = F.lit(None), F.size("_right") > 0
    above = F.array_append("chain", F.lit(""))

    def piece(chain, under, at, items, cut, end, n):
        values = {"chain": chain, "under": under, "at": at, "items": items, "cut": cut.cast("string"), "end": end.cast("long"), "c": F.col("c"), "n": n}
        return F.struct(*(v.alias(k) for k, v in values.items()))

    upper = piece(above, F.col("under"), F.col("at"), F.col("_left"), F.col("_name"), none, F.col("n"))
    lower = piece(F.array_append("chain", F.col("_name")), F.col("_name"), F.col("at") + half, F.col("_right"), F.col("cut"), F.col("end"), F.col("n"))
    ended = piece(above, F.col("under"), F.col("at"), F.col("_left"), none, F.col("end"), F.lit(0).cast("long"))
    made = rows.select(F.inline(F.when(go_on, F.array(upper, lower)).when(F.col("end").isNotNull(), F.array(upper, ended)).otherwise(F.array(upper))))
    return made.groupBy(*_ROW).agg(F.min("c").alias("c"), F.sum("n").alias("n"))


def _recursion(sequences: DataFrame, longest: int) -> tuple[DataFrame, int]:
    """Rows of single turns (see ``_cut``) and the number of cuts."""
    tiers = [stored(_chunks(sequences, "token"), "trie-chunks")]
    size = -(-longest // CHUNK)
    while size > 1:
        digest = tiers[-1].withColumn("_digest", _name(F.array_join("items", ",")))
        tiers.append(stored(_chunks(digest, "_digest"), "trie-chunks"))
        size = -(-size // CHUNK)
    top = tiers.pop()
    widest = top.agg(F.max(F.size("items"))).first()[0]
    conv = F.col("conv_id")
    rows = top.select(
        F.array().cast("array<string>").alias("chain"), F.lit("").alias("under"), F.lit(0).cast("long").alias("at"), "items",
        F.lit(None).cast("string").alias("cut"), conv.alias("end"), conv.alias("c"), F.lit(1).cast("long").alias("n"),
    )
    cuts, half = 0, (1 << (widest - 1).bit_length()) // 2
    while True:
        while half:
            rows, cuts, half = _cut(rows, half), cuts + 1, half // 2
        rows = stored(rows, "trie-rows")
        if not tiers:
            return rows, cuts
        below = tiers.pop().select(F.col("conv_id").alias("c"), F.col("place").alias("at"), "items")
        rows = rows.drop("items").join(below, ["c", "at"]).withColumn("at", F.col("at") * CHUNK)
        half = CHUNK // 2


def _grafted(nodes: DataFrame, cuts: int, totals: list[str]) -> DataFrame:
    """``nodes`` with ``totals`` summed over their subtrees."""
    for k in range(cuts):
        top = F.col("chain")[k]
        forests = nodes.where(top != "").groupBy(top.alias("_cut")).agg(*(F.sum(c).alias(f"_below_{c}") for c in totals))
        nodes = nodes.join(forests, nodes["cut"] == forests["_cut"], "left")
        for c in totals:
            nodes = nodes.withColumn(c, F.col(c) + F.coalesce(f"_below_{c}", F.lit(0)))
        nodes = stored(nodes.drop("_cut", *(f"_below_{c}" for c in totals)), "trie-totals")
    return nodes


def _ends_digests(ends: DataFrame) -> DataFrame:
    """id and ends_sha256 of (id, conv_id): SHA-256 of the ids in order, joined by commas; lists go through the hash part by part."""
    parts = ends.groupBy("id", F.shiftright("conv_id", ENDS_BITS).alias("part")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    parts = parts.select("id", "part", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            names, digests = [], []
            for id_, ids in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist()):
                if id_ == last:
                    digest.update(b"," + ids.encode())
                    continue
                if last is not None:
                    names.append(last)
                    digests.append(digest.hexdigest())
                last, digest = id_, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(digests, pa.string())], ["id", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([digest.hexdigest()])], ["id", "ends_sha256"])

    return parts.repartition("id").sortWithinPartitions("id", "part").mapInArrow(run, "id string, ends_sha256 string")


def prefix_trie(sequences: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node of (conv_id, place, token): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Places are 0, 1, ... without gaps; ``lengths`` (conv_id, length) lists all conversations, those without turns too. A token
    ends in ``:`` and its size.
    """
    longest = lengths.agg(F.max("length")).first()[0]
    if longest is None:
        return _named(sequences.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, "
                      "n_children long, n_leaves long, saved_tokens long, ends_sha256 string"))
    if not longest:
        rows, cuts = lengths.select(
            F.array().cast("array<string>").alias("chain"), F.lit("").alias("under"), F.lit(0).cast("long").alias("at"),
            F.array().cast("array<string>").alias("items"), F.lit(None).cast("string").alias("cut"), F.lit(None).cast("long").alias("end"),
            F.col("conv_id").alias("c"), F.lit(1).cast("long").alias("n"),
        ).where("false"), 0
    else:
        rows, cuts = _recursion(sequences, longest)
    token = F.get("items", 0)
    rows = rows.withColumn("id", _name(F.concat("under", F.lit("/"), token))).withColumn("token", token)
    nodes = rows.groupBy("id", "chain", "under", "at", "token").agg(F.min("c").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("cut").alias("cut"))
    children = rows.select("id", "under").distinct().groupBy(F.col("under").alias("_of")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, nodes["cut"] == children["_of"], "left").drop("_of")
    size = F.substring_index("token", ":", -1).cast("long")
    nodes = stored(nodes.select(
        "id", "chain", "under", "cut", "conv_id", (F.col("at") + 1).alias("depth"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * size).alias("saved_tokens"),
    ), "trie-nodes")

    every = lengths.select(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    zero = F.lit(0).cast("long")
    root = nodes.agg(
        F.coalesce(F.sum((F.col("depth") == 1).cast("long")), zero).alias("n_children"), F.coalesce(F.sum("n_leaves"), zero).alias("n_leaves"),
        F.coalesce(F.sum("saved_tokens"), zero).alias("saved_tokens"),
    ).first()
    least, n_convs = every.first()
    top = lengths.sparkSession.createDataFrame(
        [("", least, 0, None, n_convs, root.n_children, root.n_leaves or 1, root.saved_tokens)],
        "id string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long",
    )
    nodes = _grafted(nodes, cuts, ["n_leaves", "saved_tokens"])
    parents = nodes.where("cut IS NOT NULL").select(F.col("cut").alias("_cut"), F.col("conv_id").alias("_parent"))
    nodes = nodes.join(parents, nodes["under"] == parents["_cut"], "left")
    nodes = nodes.withColumn("parent_conv_id", F.when(F.col("under") == "", F.lit(least)).otherwise(F.col("_parent")))
    ends = rows.where("end IS NOT NULL").select("id", F.col("end").alias("conv_id"))
    ends = ends.union(lengths.where("length = 0").select(F.lit("").alias("id"), "conv_id"))
    out = top.unionByName(nodes.select(*top.columns)).join(_ends_digests(ends), "id", "left")
    return _named(out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))))


def _named(out: DataFrame) -> DataFrame:
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(*with_shared_turns(turns_of(documents(spark, sf_dir, "conversations"))))


# The checksum takes the bits of the decimal id one by one, the lowest of each byte first.
SQL = f"""
WITH t AS (
    SELECT conv_id, digest, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS place
    FROM (
        SELECT conv_id, turn, length(coalesce(text, '')) AS size,
               sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
        FROM conversations WHERE conv_id IS NOT NULL
    )
), h AS (
    SELECT conv_id, conv_id - conv_id % {HUNDRED} AS base, count(*) AS own,
           xor(list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(range(8 * length(CAST(conv_id AS VARCHAR))),
                   lambda i: CAST((ascii(CAST(conv_id AS VARCHAR)[i // 8 + 1]) >> CAST(i % 8 AS INT)) & 1 AS BIGINT))),
               lambda crc, bit: xor(crc >> 1, 3988292384 * (xor(crc, bit) & 1))), 4294967295) % {SHARED} AS h
    FROM t GROUP BY conv_id
), c AS (
    SELECT h.conv_id, h.base, h.h, least(h.h, coalesce(b.own, 0)) + greatest(h.own - h.h, 0) AS length, least(h.h, coalesce(b.own, 0)) AS given
    FROM h LEFT JOIN h b ON b.conv_id = h.base
), r AS (
    SELECT c.conv_id, t.place, t.digest, t.size FROM c JOIN t ON t.conv_id = c.base AND t.place < c.h
    UNION ALL
    SELECT t.conv_id, t.place - c.h + c.given, t.digest, t.size FROM t JOIN c ON t.conv_id = c.conv_id WHERE t.place >= c.h
), p AS (
    SELECT conv_id, place + 1 AS depth, size, sha256(string_agg(digest, ',') OVER (PARTITION BY conv_id ORDER BY place)) AS node FROM r
    UNION ALL SELECT conv_id, 0, 0, '' FROM c
), n AS (
    SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved FROM p GROUP BY node, depth
), q AS (
    SELECT n.*, a.node AS parent FROM n LEFT JOIN p a ON a.conv_id = n.conv_id AND a.depth = n.depth - 1
), k AS (SELECT parent, count(*) AS n_children FROM q WHERE parent IS NOT NULL GROUP BY parent),
v AS (SELECT q.*, coalesce(k.n_children, 0) AS n_children FROM q LEFT JOIN k ON k.parent = q.node),
s AS (
    SELECT a.node, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(v.saved) AS saved_tokens
    FROM v JOIN p a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY a.node
), e AS (
    SELECT p.node, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids
    FROM p JOIN c ON c.conv_id = p.conv_id AND c.length = p.depth GROUP BY p.node
)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM v JOIN s ON s.node = v.node LEFT JOIN n u ON u.node = v.parent LEFT JOIN e ON e.node = v.node
"""

QUERIES = {"op12_prefix_trie": (op12_prefix_trie, SQL)}

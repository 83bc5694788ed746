"""Jaccard self-join of documents on word shingles, by a chosen-path tree that is repeated until the target recall.

A document is the set of its runs of ``WORDS`` words (a text of fewer words, but not none, is one run). Documents of equal
sets are copies and take part once. Each set is embedded as ``COORDINATES`` minimum hashes.

The tree: a run samples ``BRANCH`` coordinates at its root, and sets that share the sampled token (the minimum) of a
coordinate share a node. A node of at most ``NODE`` sets is searched whole. A larger node is split again on ``BRANCH`` more
sampled coordinates, unless its sets agree on them so often that splitting would not part them (dense); dense nodes are searched
whole too, cut into blocks, a task for each pair of blocks. A pair of similarity s is lost by a run with probability q at
most, where q = (1 - s + s q) ** BRANCH, so ``runs`` follows from the target recall of links at the threshold itself.

Search: estimates from the coordinates drop pairs far below the threshold, then exact set sizes and intersections decide.
A pair counts in one node only, the smallest that both sets share. Nodes return each set's number of links and its
smallest linked set, never the pairs. Components of links are the classes.

Null text counts as empty. Documents without words have no links and are classes of their own; a null id counts as no id for
the smallest id of a class. Rows that repeat id and text are copies. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.components import components
from fleetlens.llm.rows import without_rows
from fleetlens.llm.session import documents, stored
from fleetlens.llm.words import find_words, pieces, shingles, splitmix

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.99999
COORDINATES, BRANCH, NODE, BLOCK, DEPTH, DENSE = 64, 3, 256, 1024, 8, 0.4
SEED = 20_113
_MULTIPLY = splitmix(np.arange(COORDINATES) + SEED) | np.uint64(1)
_ADD = splitmix(np.arange(COORDINATES) + 2 * SEED)


def loss_of_a_run(similarity: float, branch: int = BRANCH) -> float:
    """The chance at most that a run of any depth parts a pair of this similarity: the fixed point of the branching process."""
    q = 0.0
    for _ in range(10_000):
        q = (1 - similarity + similarity * q) ** branch
    return q


def runs_needed(similarity: float, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(loss_of_a_run(similarity))))


def agreement_needed(similarity: float, coordinates: int = COORDINATES, loss: float = 1e-7) -> int:
    """The number of equal coordinates that a pair of this similarity reaches but for a chance of ``loss``."""
    below, k = 0.0, 0
    while True:
        below += math.comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k)
        if below > loss:
            return k
        k += 1


def sets_of(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, and the n + 1 places where the texts' sets start."""
    hashes, text, _ = shingles(find_words(column), k)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[fresh], text[fresh]
    return hashes, np.searchsorted(text, np.arange(len(column) + 1))


def signatures(texts: DataFrame, k: int) -> DataFrame:
    """uid, doc_id, digest, size, a 128-bit hash of the set (h1, h2), and its minimum hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in pieces(batch, "_text"):
                n = part.num_rows
                hashes, at = sets_of(part.column("_text"), k)
                size = np.diff(at)
                some = np.flatnonzero(size)
                first = at[:-1][some]
                sums = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
                least = np.zeros((n, COORDINATES), np.uint32)
                if len(some):
                    for i in (0, 1):
                        sums[i][some] = np.add.reduceat(splitmix(hashes + np.uint64(i + 1)), first)
                    for c in range(COORDINATES):
                        mixed = ((hashes * _MULTIPLY[c] + _ADD[c]) >> np.uint64(32)).astype(np.uint32)
                        least[some, c] = np.minimum.reduceat(mixed, first)
                ints = pa.array(least.view(np.int32).ravel())
                minima = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * COORDINATES, COORDINATES, dtype=np.int32)), ints)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(uid, uid + n)), part.column("doc_id"), part.column("_digest"), pa.array(size.astype(np.int64)),
                        pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), minima,
                    ],
                    ["uid", "doc_id", "digest", "size", "h1", "h2", "minima"],
                )
                uid += n

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"uid long, doc_id {kind}, digest string, size long, h1 long, h2 long, minima array<int>")


def tree_nodes(sets: DataFrame, runs: int) -> DataFrame:
    """node, rep, m (sets in the node): the nodes to be searched, of all runs."""
    if runs * BRANCH > COORDINATES:
        raise ValueError(f"{runs} runs need {runs * BRANCH} coordinates; there are {COORDINATES}: raise the similarity or lower the recall")
    root = F.array(*[F.xxhash64(F.lit(SEED + i), F.element_at("minima", i + 1)) for i in range(runs * BRANCH)])
    members = sets.select("rep", F.explode(F.array_distinct(root)).alias("node"))
    shared = members.groupBy("node").agg(F.count("*").alias("m")).where("m > 1")
    members = stored(members.join(shared, "node").select("node", "rep", "m"), "nodes")
    closed = members.where(F.col("m") <= NODE)
    for _ in range(DEPTH):
        large = members.where(F.col("m") > NODE)
        if large.isEmpty():
            return closed
        used = min(runs * BRANCH, COORDINATES // 2)
        pick = [F.pmod(F.xxhash64("node", F.lit(j)), F.lit(COORDINATES - used)).cast("int") + used + 1 for j in range(BRANCH)]
        below = large.join(sets.select("rep", "minima"), "rep").select(
            "node", "m", "rep",
            F.posexplode(F.array(*[F.xxhash64("node", F.lit(j), F.element_at("minima", p)) for j, p in enumerate(pick)])).alias("j", "child"),
        )
        below = stored(below, "children")
        counted = below.groupBy("node", "m", "j", "child").agg(F.count("*").alias("c"))
        counted = stored(counted, "child-counts")
        agree = (F.sum(F.col("c").cast("double") * F.col("c")) / (BRANCH * F.col("m").cast("double") * F.col("m"))).alias("agree")
        dense = stored(counted.groupBy("node", "m").agg(agree).where(F.col("agree") >= DENSE).select("node"), "dense")
        closed = closed.union(large.join(dense, "node", "left_semi"))
        sparse = counted.where("c > 1").join(dense, "node", "left_anti").select("node", "j", "child", "c")
        members = stored(
            below.select("node", "j", "child", "rep").join(sparse, ["node", "j", "child"])
            .select(F.col("child").alias("node"), "rep", F.col("c").alias("m")), "nodes",
        )
        closed = closed.union(members.where(F.col("m") <= NODE))
    return closed.union(members.where(F.col("m") > NODE))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut a stream of sorted batches into tables that end where a key does."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for k, values in zip(keys, columns):
            change[1:] |= values[1:] != values[:-1]
            if held:
                change[0] |= values[0] != held[-1].column(k)[-1].as_py()
        cuts = np.flatnonzero(change)
        if not len(cuts):
            held.append(batch)
            continue
        if cuts[-1] or held:
            yield pa.Table.from_batches([*held, batch.slice(0, cuts[-1])])
        held = [batch.slice(cuts[-1])]
    if held:
        yield pa.Table.from_batches(held)


def _matrix(table: pa.Table, column: str, width: int, kind) -> np.ndarray:
    flat = table.column(column).combine_chunks().flatten().to_numpy()
    return flat.view(kind).reshape(-1, width)


def likely(searched: DataFrame, agreement: int) -> DataFrame:
    """node, rep of the sets that have a partner of enough equal coordinates in a node that is the pair's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["node"]):
            node = table.column("node").to_numpy()
            minima = _matrix(table, "minima", COORDINATES, np.int32)
            lists = table.column("nodes").combine_chunks()
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            length, last = np.diff(at), np.iinfo(np.int64).max
            paths = np.full((len(node), int(length.max())), last)
            paths[np.arange(paths.shape[1])[None, :] < length[:, None]] = flat[at[0] : at[-1]]
            marked = np.zeros(len(node), bool)
            for by in range(1, NODE):
                a = np.flatnonzero(node[by:] == node[:-by])
                if not len(a):
                    break
                a = a[(minima[a] == minima[a + by]).sum(axis=1) >= agreement]
                a = a[~(marked[a] & marked[a + by])]
                if len(a):
                    both = (paths[a][:, :, None] == paths[a + by][:, None, :]).any(axis=2)
                    a = a[np.where(both, paths[a], last).min(axis=1) == node[a]]
                    marked[a] = marked[a + by] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[marked]), pa.array(table.column("rep").to_numpy()[marked])], ["node", "rep"]
            )

    sorted_rows = searched.select("node", "rep", "nodes", "minima").repartition("node").sortWithinPartitions("node")
    return sorted_rows.mapInArrow(run, "node long, rep long")


def _common(lists: np.ndarray, at: np.ndarray, most: int = 4096) -> np.ndarray:
    """For each two of n sets, the number of common elements."""
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    _, element, times = np.unique(lists, return_inverse=True, return_counts=True)
    shared = times[element] > 1
    row, element = row[shared], element[shared]
    out = np.zeros((n, n), np.float32)
    if not len(row):
        return out
    rank = np.cumsum(times > 1) - 1
    element = rank[element]
    order = np.argsort(element, kind="stable")
    row, element = row[order], element[order]
    for lo in range(0, int(element[-1]) + 1, most):
        a, b = np.searchsorted(element, [lo, lo + most])
        held = np.zeros((n, min(most, int(element[-1]) + 1 - lo)), np.float32)
        held[row[a:b], element[a:b] - lo] = 1
        out += held @ held.T
    return out


def _slice_lists(column: pa.ListArray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    at = column.offsets.to_numpy()[lo : hi + 1]
    return column.values.to_numpy()[at[0] : at[-1]], at - at[0]


def verified(searched: DataFrame, similarity: float) -> DataFrame:
    """rep, links (linked documents, copies included), least (the smallest rep that it is connected with), per node searched."""
    ratio = Fraction(similarity).limit_denominator(10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["node", "block_a", "block_b"]):
            table = table.combine_chunks()
            node, rep = table.column("node").to_numpy(), table.column("rep").to_numpy()
            one, other, own = (table.column(c).to_numpy() for c in ("block_a", "block_b", "block"))
            copies = table.column("copies").to_numpy().astype(np.float64)
            sets, nodes = table.column("shingles").combine_chunks(), table.column("nodes").combine_chunks()
            sets, nodes = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (sets, nodes))
            cut = np.flatnonzero((node[1:] != node[:-1]) | (one[1:] != one[:-1]) | (other[1:] != other[:-1])) + 1
            found = [[], [], []]
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(node)]):
                if hi - lo < 2:
                    continue
                lists, at = _slice_lists(sets, lo, hi)
                common = _common(lists, at).astype(np.int64)
                size = np.diff(at)
                link = ratio.denominator * common >= ratio.numerator * (size[:, None] + size[None, :] - common)
                paths, path_at = _slice_lists(nodes, lo, hi)
                row = np.repeat(np.arange(hi - lo), np.diff(path_at))
                before = paths < node[lo]
                link &= _common(paths[before], np.searchsorted(row[before], np.arange(hi - lo + 1))) == 0
                if one[lo] != other[lo]:
                    link &= own[lo:hi][:, None] != own[lo:hi][None, :]
                np.fill_diagonal(link, False)
                count = link @ copies[lo:hi]
                linked = np.flatnonzero(count)
                if not len(linked):
                    continue
                link = link[np.ix_(linked, linked)]
                least, ids = rep[lo:hi][linked], rep[lo:hi][linked]
                while True:
                    lower = np.minimum(least, np.where(link, least[None, :], np.iinfo(np.int64).max).min(axis=1))
                    if (lower == least).all():
                        break
                    least = lower
                for to, values in zip(found, (ids, count[linked].astype(np.int64), least)):
                    to.append(values)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], ["rep", "links", "least"])

    columns = ["node", "block_a", "block_b", "block", "rep", "copies", "nodes", "shingles"]
    keys = columns[:3]
    return searched.select(*columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "rep long, links long, least long")


def shingle_sets(texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """rep, shingles (sorted distinct hashes) of the wanted documents, found again by id and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                hashes, at = sets_of(part.column("_text"), k)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("rep"), lists], ["rep", "shingles"])

    mark = wanted.select("rep", F.col("doc_id").alias("_id"), F.col("digest").alias("_key"))
    found = texts.join(mark.hint("shuffle_hash"), texts.doc_id.eqNullSafe(mark["_id"]) & (texts["_digest"] == mark["_key"]))
    return found.select("rep", "_text").mapInArrow(run, "rep long, shingles array<long>").dropDuplicates(["rep"])


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS,
    similarity: float = SIMILARITY, recall: float = RECALL,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest id of the component), copy_id (smallest id of the equal sets),
    n_copies (rows of that set), n_links (all other rows at or above the similarity), uid (row number), digest (MD5 of the text).
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).withColumn(
        "_digest", F.md5(F.coalesce(F.col("_text"), F.lit("")))
    )
    rows = stored(signatures(texts, k), "signatures")
    groups = rows.where("size > 0").groupBy("h1", "h2", "size").agg(
        F.min("uid").alias("rep"), F.count("*").alias("copies"), F.min("doc_id").alias("copy_id")
    )
    groups = stored(groups, "copies")
    sets = stored(
        rows.join(groups.select("rep", "copies"), rows.uid == F.col("rep")).select("rep", "copies", "doc_id", "digest", "minima"), "sets"
    )
    nodes = stored(tree_nodes(sets, runs_needed(similarity, recall)), "searched")
    paths = nodes.groupBy("rep").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    paths = stored(paths, "paths")
    small = nodes.where(F.col("m") <= NODE).select("node", "rep").distinct()
    searched = small.join(paths, "rep").join(sets.select("rep", "minima"), "rep")
    marked = likely(searched, agreement_needed(similarity)).withColumn("parts", F.lit(1).cast("long"))
    dense = nodes.where(F.col("m") > NODE).select("node", "rep", F.ceil(F.col("m") / BLOCK).alias("parts")).distinct()
    marked = stored(marked.union(dense), "marked")
    wanted = sets.select("rep", "doc_id", "digest").join(marked.select("rep").distinct(), "rep")
    full = stored(
        shingle_sets(texts, wanted, k).join(paths, "rep").join(sets.select("rep", "copies"), "rep"), "shingles"
    )
    block = F.pmod(F.xxhash64("rep", "node"), F.col("parts"))
    dealt = marked.withColumn("block", block).withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("node", "rep", "block", F.least("block", "_with").alias("block_a"), F.greatest("block", "_with").alias("block_b"))
    links = stored(verified(dealt.join(full, "rep"), similarity), "links")

    joined = components(links.select("rep", "least"))
    least_id = groups.select(F.col("rep").alias("node"), "copy_id").join(joined, "node")
    least_id = least_id.groupBy("component").agg(F.min("copy_id").alias("class_id"))
    classes = joined.join(least_id, "component").select(F.col("node").alias("rep"), "component", "class_id")
    summed = links.groupBy("rep").agg(F.sum("links").alias("links"))
    by_set = groups.join(classes, "rep", "left").join(summed, "rep", "left").select(
        "h1", "h2", "size", "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"), F.coalesce("component", "rep").alias("component"),
        F.col("copies").alias("n_copies"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    by_set = stored(by_set, "classes")
    out = rows.select("uid", "doc_id", "digest", "h1", "h2", "size").join(by_set, ["h1", "h2", "size"], "left")
    return out.select(
        "doc_id", F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("size") > 0, F.col("copy_id")).otherwise(F.col("doc_id")).alias("copy_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "uid", F.coalesce("component", "uid").alias("component"), "digest",
    )


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class and all its columns: the row of the smallest id, one of them if it repeats."""
    found = stored(similar_documents(docs), "similar")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    stay = found.groupBy("component").agg(F.min(order).alias("o")).select("o.uid", F.lit(1).alias("_stays"))
    by_row = found.select("uid", F.col("doc_id").alias("id"), F.col("digest").alias("key")).join(stay, "uid", "left")
    # Documents without words are classes of their own, so of rows that repeat id and text, any number may stay.
    decided = by_row.groupBy("id", "key").agg(F.count("*").alias("_rows"), F.count("_stays").alias("_stay"))
    decided = stored(decided.where("_stay < _rows"), "near-decisions")
    gone, single = (decided.where(c).select("id", "key") for c in ("_stay = 0", "_stay > 0"))
    return without_rows(docs, gone, single, F.md5(F.coalesce(F.col("_row.text"), F.lit(""))))


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir)).drop("uid", "component", "digest")


QUERIES = {"op1_ngram_jaccard_join": (op1_ngram_jaccard_join, None)}

"""Language-model scores of whole documents, by the recurrent model of ``recurrent``.

1. Words are found and hashed once. Those of the training documents are counted, all of them, summed per task and then by Spark.
2. The most frequent words, fewer than ``KNOWN``, go to all tasks; of equally frequent ones those of the smaller hashes.
   Documents become ids; words beyond those are listed by hash.
3. Training, in ``ROUNDS`` rounds that together read every training document once: documents are dealt by a hash of id and
   text to learners of about ``LEARNER_TOKENS`` tokens, each of which trains from the common parameters, and the results are
   averaged by Spark, weighted by tokens (parallel gradient descent with averaging). Learners, their documents and the order
   of both follow from the table alone, not from its partitions.
4. Scoring runs over every whole document, the state carried from window to window. The listed words are joined with the
   counts, where their share of the rarest band comes from.

A word's probability is P(class | state) times P(word | class, state) for the words of the model's head; for rarer words
times their smoothed share of the counts of their band, where one part stands for all words never seen. So the
probabilities of all tokens add up to 1, and with all weights at their start the score is the unigram score.

Tokens are runs of anything but white space after lower-casing A-Z, then one end. Null text counts as empty: the end alone. A null
id is treated as empty text where documents are split. Repeated rows are scored each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import recurrent
from fleetlens.llm.session import documents, stored
from fleetlens.llm.words import SPACE_BYTES, find_words, pieces, text_bytes

KNOWN = recurrent.HEAD << (recurrent.BANDS - 1)  # words that every task knows: the model's head and its bands
ROUNDS, BLOCK_TOKENS, SLICE = 3, 4_000_000, 4096
LEARNER_TOKENS = 2_000_000  # what one learner trains on in a round, about
TASKS = 50_000  # beyond it a task holds several learners, one after the other; results do not depend on it
END_KEY = -1  # the end of a document among the counts


def held_out(id_col: str = "doc_id") -> Column:
    """One document in seven, by a checksum of its id."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def hashed(texts: DataFrame) -> DataFrame:
    """``texts`` with ``keys``, the hashes of the tokens of ``_text`` in order, instead of it: found once, read by all that follows."""
    others = [c for c in texts.columns if c != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                keys, first = _token_keys(part.column("_text"))
                found = pa.Array.from_buffers(
                    pa.large_binary(), part.num_rows, [None, pa.py_buffer(first.astype(np.int64) * 8), pa.py_buffer(np.ascontiguousarray(keys))])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), found.cast(pa.binary())], [*others, "keys"])

    kinds = "".join(f"{c} {texts.schema[c].dataType.simpleString()}, " for c in others)
    return texts.mapInArrow(run, f"{kinds}keys binary")


def count_tokens(tokens: DataFrame) -> DataFrame:
    """key, n of all tokens of ``keys`` (see ``hashed``); the end has ``END_KEY``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, ends = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            key, inverse = np.unique(every, return_inverse=True)
            return key, np.bincount(inverse, np.concatenate(counts) if counts else None, len(key)).astype(np.int64)

        for batch in batches:
            ends += batch.num_rows
            for part in pieces(batch, "keys"):
                key, n = np.unique(_stored_keys(part.column("keys"))[0], return_counts=True)
                keys.append(key)
                counts.append(n.astype(np.float64))
            if sum(map(len, keys)) > 3_000_000:
                key, n = merged()
                keys, counts = [key], [n.astype(np.float64)]
                if len(key) > 1_500_000:  # the worker's memory, not the corpus, bounds what is held back
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])
                    keys, counts = [], []
        key, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[key, END_KEY]), pa.array(np.r_[n, ends])], ["key", "n"])

    return tokens.select("keys").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 0")


def _token_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = find_words(column, SPACE_BYTES)
    keys = words.hash.view(np.int64)
    return np.where(keys == END_KEY, END_KEY + 1, keys), words.first


def _stored_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = text_bytes(column)
    return data.view(np.int64), at // 8


class Vocabulary:
    """The known words, by falling count: the end first, then ids up to ``HEAD``, then the bands; ``keys`` are sorted for look-up."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("key") == END_KEY, F.col("n")))).first()
        self.tokens, self.distinct, ends = (int(x or 0) for x in total)
        keys, n = self._most_frequent(counts.where(F.col("key") != END_KEY))
        rank = np.arange(1, len(keys) + 1)
        band = np.maximum(np.floor(np.log2(rank / recurrent.HEAD)), 0).astype(np.int64)
        ids = np.where(rank < recurrent.HEAD, rank, recurrent.HEAD + band)
        self.head_counts = np.zeros(recurrent.HEAD)
        self.head_counts[0] = ends
        inside = rank < recurrent.HEAD
        self.head_counts[rank[inside]] = n[inside]
        mass = np.bincount(band[~inside], n[~inside] + 1.0, recurrent.BANDS)
        # The last band holds all other words of the training documents, and one part for those never seen.
        known = len(keys) + (1 if ends else 0)
        mass[-1] = (self.tokens - ends - int(n.sum())) + max(self.distinct - known, 0) + 1
        self.mass = mass
        order = np.argsort(keys)
        share = np.zeros(len(keys))
        share[~inside] = np.log10((n[~inside] + 1) / mass[band[~inside]])
        self.keys, self.ids, self.counts, self.share = keys[order], ids[order].astype(np.uint16), n[order], share[order]

    @staticmethod
    def _most_frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of the first ``KNOWN`` - 1 words by falling count, then by key.

        Words are cut by levels of counts (eighths of a power of two, a few hundred at most), the level that does not fit by
        counts, the count that does not fit by the first 12 bits of its keys, and only what is left of one such part is sorted:
        no task ranks the words of all others, and at most ``KNOWN`` rows come to the driver.
        """
        room = KNOWN - 1
        tied, chosen = F.lit(True), F.lit(False)
        for part in (F.floor(F.log2("n") * 8), F.col("n"), -F.shiftright("key", 52)):
            over = None
            for row in sorted(counts.where(tied).groupBy(part.alias("part")).count().collect(), reverse=True):
                if row["count"] > room:
                    over = row["part"]
                    break
                room -= row["count"]
            if over is None:
                tied, chosen = F.lit(False), chosen | tied
                break
            tied, chosen = tied & (part == over), chosen | (tied & (part > over))
        top = counts.where(chosen).select("key", "n")
        if over is not None and room:
            top = top.unionByName(counts.where(tied).select("key", "n").orderBy("key").limit(room))
        top = top.toArrow()  # fewer than KNOWN
        keys, n = (top.column(c).to_numpy() for c in ("key", "n"))
        order = np.lexsort((keys, -n))
        return keys[order], n[order]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.keys, self.ids, self.counts, self.share


def encode(tokens: DataFrame, words: Vocabulary) -> DataFrame:
    """One row per document of ``hashed`` texts: uid, doc_id, held_out, n_tokens, ids, what the known words add up to, and the hashes of the others."""
    shared = tokens.sparkSession.sparkContext.broadcast(words.arrays())  # KNOWN words at most
    ends = float(words.head_counts[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, counts, share = shared.value
        logs = np.log10(counts + 1.0)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in pieces(batch, "keys"):
                keys, first = _stored_keys(part.column("keys"))
                size, text = np.diff(first), np.repeat(np.arange(part.num_rows), np.diff(first))
                if len(known):
                    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    hit = known[place] == keys
                else:
                    place, hit = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
                code = np.full(len(keys), recurrent.HEAD + recurrent.BANDS - 1, np.uint16)
                code[hit] = ids[place[hit]]
                with_end = np.zeros(len(keys) + part.num_rows, "<u2")
                with_end[np.arange(len(keys)) + text] = code
                at = (first + np.arange(part.num_rows + 1)) * 2
                n = part.num_rows
                sums = [np.bincount(text[hit], w[place[hit]], n).astype(np.float64) for w in (logs, share)]
                rare = pa.ListArray.from_arrays(
                    pa.array(np.r_[0, np.cumsum(np.bincount(text[~hit], minlength=n))].astype(np.int32)), pa.array(keys[~hit])
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(uid, uid + n)), part.column("doc_id"), part.column("held_out"),
                        pa.array(size + 1), pa.array(np.bincount(text[hit], minlength=n) + (ends > 0)),
                        pa.array(sums[0] + np.log10(ends + 1)), pa.array(sums[1]),
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(with_end)]), rare,
                    ],
                    ["uid", "doc_id", "held_out", "n_tokens", "n_known", "log_counts", "log_shares", "ids", "rare"],
                )
                uid += n

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.mapInArrow(
        run,
        f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, log_counts double, log_shares double, "
        "ids binary, rare array<long>",
    )


def _blocks(texts: Iterator[bytes]) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for ids in texts:
        held.append(np.frombuffer(ids, "<u2"))
        size += len(held[-1])
        if size >= BLOCK_TOKENS:
            yield held
            held, size = [], 0
    if held:
        yield held


def dealt(encoded: DataFrame, train_tokens: int) -> tuple[DataFrame, int]:
    """The training documents with ``round``, ``learner`` and ``lot`` (their place in a learner), and the number of learners.

    All of it follows from ids, texts and their number. Rows equal in id and text share a learner, which reads them in turn.
    """
    learners = max(1, round(train_tokens / ROUNDS / LEARNER_TOKENS))
    lot = F.xxhash64(F.col("doc_id").cast("string"), "ids")
    rows = encoded.where("NOT held_out").select("ids", lot.alias("lot"))
    return rows.select(
        "ids", "lot", F.pmod("lot", F.lit(ROUNDS)).cast("int").alias("round"),
        F.pmod(F.xxhash64("lot"), F.lit(learners)).cast("int").alias("learner"),
    ), learners


def train(encoded: DataFrame, flat: np.ndarray, train_tokens: int) -> np.ndarray:
    """The parameters after all rounds. A round reads its share of the training documents, one in ``ROUNDS``."""
    spark = encoded.sparkSession
    training, learners = dealt(encoded, train_tokens)
    slices = -(-recurrent.SIZE // SLICE)
    shape = "slice int, part int, learner int, tokens double, weights binary"
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(flat.tobytes())  # of fixed size

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            begin = np.frombuffer(shared.value, np.float32)
            rows = (row for b in batches for row in zip(b.column("learner").to_pylist(), b.column("ids").to_pylist()))
            for learner, texts in groupby(rows, itemgetter(0)):  # sorted, so a learner's documents follow each other
                after, tokens = recurrent.train(begin, _blocks(ids for _, ids in texts))
                cut = [after[i * SLICE : (i + 1) * SLICE].tobytes() for i in range(slices)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(slices), pa.int32()), pa.array([learner % 64] * slices, pa.int32()),
                        pa.array([learner] * slices, pa.int32()), pa.array([float(tokens)] * slices), pa.array(cut, pa.binary()),
                    ],
                    ["slice", "part", "learner", "tokens", "weights"],
                )

        def mean(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["part", "learner"])  # sums of floats depend on their order
            total = rows["tokens"].sum()
            weights = sum(t / total * np.frombuffer(w, np.float32).astype(np.float64) for t, w in zip(rows["tokens"], rows["weights"]))
            return pd.DataFrame({
                "slice": [rows["slice"].iloc[0]], "part": [rows["part"].iloc[0]], "learner": [0], "tokens": [total],
                "weights": [weights.astype(np.float32).tobytes()],
            })

        read = training.where(F.col("round") == turn).select("learner", "lot", "ids")
        made = read.repartition(min(learners, TASKS), "learner").sortWithinPartitions("learner", "lot", "ids").mapInArrow(run, shape)
        made = made.groupBy("slice", "part").applyInPandas(mean, shape).groupBy("slice").applyInPandas(mean, shape)
        parts = {r["slice"]: r["weights"] for r in made.collect()}  # the parameters, once
        shared.destroy()
        if len(parts) == slices:
            flat = np.concatenate([np.frombuffer(parts[i], np.float32) for i in range(slices)])
    return flat


def model_scores(encoded: DataFrame, flat: np.ndarray) -> DataFrame:
    """The columns of ``encoded`` but the tokens, and log_model: log10 of the model's probability, shares within bands left out."""
    shared = encoded.sparkSession.sparkContext.broadcast(flat.tobytes())
    others = [c for c in encoded.columns if c not in ("ids", "rare")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(shared.value, np.float32)
        held: list[pa.RecordBatch] = []

        def scored() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            texts = [np.frombuffer(ids, "<u2") for ids in table.column("ids").to_pylist()]
            logs = recurrent.score(weights, texts) / np.log(10)
            columns = [table.column(c).combine_chunks() for c in others]
            return pa.RecordBatch.from_arrays([*columns, pa.array(logs)], [*others, "log_model"])

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += sum(len(ids) for ids in batch.column("ids").to_pylist()) // 2
            if size >= BLOCK_TOKENS:
                yield scored()
                held, size = [], 0
        if held:
            yield scored()

    kinds = ", ".join(f"{c} {encoded.schema[c].dataType.simpleString()}" for c in others)
    return encoded.drop("rare").mapInArrow(run, f"{kinds}, log_model double")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), (held_out(id_col) if held is None else held).alias("held_out")
    )
    tokens = stored(hashed(texts), "token-hashes")
    counts = stored(count_tokens(tokens.where("NOT held_out")), "token-counts")
    words = Vocabulary(counts)
    encoded = stored(encode(tokens, words), "encoded")
    flat = train(encoded, recurrent.start(words.head_counts, words.mass), words.tokens)
    rare = encoded.select("uid", F.explode("rare").alias("key")).join(counts, "key", "left")
    seen = F.coalesce("n", F.lit(0))
    rare = rare.groupBy("uid").agg(
        F.count("n").alias("rare_known"), F.sum(F.log10(seen + 1)).alias("rare_logs"), F.count("*").alias("rare_all")
    )
    scored = stored(model_scores(encoded, flat), "model-scores")
    out = scored.join(rare, "uid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    base = F.col("log_counts") + zero("rare_logs") - F.col("n_tokens") * float(np.log10(words.tokens + words.distinct + 1))
    inside = F.col("log_shares") + zero("rare_logs") - zero("rare_all") * float(np.log10(words.mass[-1]))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("rare_known")).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("log_model") + inside).alias("score"),
    )


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


QUERIES = {"op2_lm_scoring": (op2_lm_scoring, None)}

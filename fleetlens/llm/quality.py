"""Quality classifier from weak labels: heuristic labellers, expectation-maximisation, a hashed linear scorer.

1. Each labeller votes good (1), bad (-1) or nothing (0) from simple figures of the whole text.
2. Votes are counted by pattern: 3 to the number of labellers at most, whatever the number of documents. On these counts, which
   cover all documents, expectation-maximisation estimates the share of good documents and each labeller's chance of each vote
   given the true class. The posterior of a pattern is the weak label of its documents.
3. A logistic scorer over hashed features (shapes of tokens, words, repeats) is trained on the weak labels of a sample of
   ``SAMPLE`` documents at most, chosen by a hash of the text, and scores every document.

No gold labels are used. Null text counts as empty; a text without tokens has no votes, no features and score 0, so it is
rejected. Repeated rows are scored each; equal texts get equal scores. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.session import documents, stored
from fleetlens.llm.words import SPACE_BYTES, find_words, pieces, text_bytes

SAMPLE, DIMENSION_BITS, THRESHOLD = 10_000, 15, 0.5
STEPS, RATE, RIDGE = 150, 0.5, 1e-6
EM_ROUNDS = 200
DIMENSIONS = 1 << DIMENSION_BITS

LABELLERS = (
    "symbols", "capitals", "exclamations", "symbol_runs", "bare_symbols", "repeats", "diversity", "sentences", "word_length",
)


def _shape_table() -> np.ndarray:
    """Bytes to the shape of their character: letters to a or A, digits to 0, other marks to themselves, white space to a blank."""
    out = np.arange(256).astype(np.uint8)
    for b in range(256):
        if b >= 0x80:
            out[b] = ord("a")
        elif chr(b).isalpha():
            out[b] = ord("A") if chr(b).isupper() else ord("a")
        elif chr(b).isdigit():
            out[b] = ord("0")
    out[SPACE_BYTES == 0x20] = 0x20
    return out


SHAPES = _shape_table()
_PLAIN_MARKS = b".,;:'\"?!()-"
_SYMBOL = np.array([0x21 <= b < 0x7F and not chr(b).isalnum() for b in range(256)])
_ODD_SYMBOL = np.array([_SYMBOL[b] and b not in _PLAIN_MARKS for b in range(256)])
_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])
_LETTER = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[at[1:]] - total[at[:-1]]


def votes(column: pa.Array) -> np.ndarray:
    """Texts x labellers: 1, -1 or 0."""
    raw, at = text_bytes(column)
    words = find_words(column, SPACE_BYTES)
    n = np.diff(words.first)
    some = np.maximum(n, 1)
    size = np.maximum(np.diff(at), 1)
    symbol = _SYMBOL[raw]
    behind = np.r_[False, symbol[:-1]] & symbol if len(raw) else symbol
    letters = _per_text(_LETTER[raw], at)
    upper = _per_text(_UPPER[raw], at) / np.maximum(letters, 1)
    odd = _per_text(_ODD_SYMBOL[raw], at) / size
    shout = _per_text(raw == ord("!"), at) / some
    runs = _per_text(behind, at) / some
    stops = _per_text(raw == ord("."), at) / some
    marks = np.r_[0, np.cumsum(symbol, dtype=np.int64)]
    bare = _per_text(marks[words.end] - marks[words.start] == words.end - words.start, words.first) / some
    same = np.zeros(len(words.hash), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
    repeats = _per_text(same, words.first) / some
    order = np.lexsort((words.hash, words.text))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (words.text[order][1:] != words.text[order][:-1])
    distinct = _per_text(fresh, words.first) / some
    length = _per_text(np.ones(len(raw), bool) & (SPACE_BYTES[raw] != 0x20), at) / some

    def vote(bad, good, enough=5) -> np.ndarray:
        return np.where(n < enough, 0, np.where(bad, -1, np.where(good, 1, 0)))

    return np.stack([
        vote(odd > 0.03, odd < 0.005),
        vote((letters >= 20) & (upper > 0.4), (letters >= 20) & (upper < 0.15)),
        vote(shout > 0.2, shout < 0.02),
        vote(runs > 0.2, runs < 0.02),
        vote(bare > 0.15, bare < 0.02),
        vote(repeats > 0.15, repeats < 0.05, 10),
        vote((n < 400) & (distinct < 0.3), (n < 4000) & (distinct > 0.4), 40),
        vote(stops == 0, (stops > 0.01) & (stops < 0.5), 40),
        vote((length < 2) | (length > 14), (length > 3) & (length < 10)),
    ], axis=1)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, value and text number of each feature: share of the tokens with a shape, with a hashed word, equal to the one before."""
    half = np.uint64(64 - (DIMENSION_BITS - 1))
    shapes, words = find_words(column, SHAPES, collapse=True), find_words(column, SPACE_BYTES)
    share = 1.0 / np.maximum(np.diff(words.first), 1)
    same = np.zeros(len(words.hash), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
    again = np.full(int(same.sum()), DIMENSIONS, np.int64)
    place = np.r_[(shapes.hash >> half).astype(np.int64), (words.hash >> half).astype(np.int64) + DIMENSIONS // 2, again]
    text = np.r_[shapes.text, words.text, words.text[same]]
    return place, share[text], text


def estimate(counts: dict[tuple[int, ...], int], rounds: int = EM_ROUNDS) -> dict[tuple[int, ...], float]:
    """Chance of good for each pattern of votes, by expectation-maximisation over the counts of patterns."""
    if not counts:
        return {}
    patterns = sorted(counts)
    seen = np.array(patterns)
    weight = np.array([counts[p] for p in patterns], np.float64)
    # To start with: a defect that one labeller sees is a doubt, one that two see is bad, however many see none.
    good = np.select([(seen == -1).sum(axis=1) == 0, (seen == -1).sum(axis=1) == 1], [0.95, 0.5], 0.05)
    for _ in range(rounds):
        share = np.clip((weight @ good + 1) / (weight.sum() + 2), 1e-6, 1 - 1e-6)
        odds = np.full(len(patterns), np.log(share / (1 - share)))
        for j in range(seen.shape[1]):
            for v in (-1, 0, 1):
                cast = seen[:, j] == v
                if v and cast.any():  # silence tells nothing about the class
                    voted = seen[:, j] != 0
                    yes = (weight[cast] @ good[cast] + 1) / (weight[voted] @ good[voted] + 2)
                    no = (weight[cast] @ (1 - good[cast]) + 1) / (weight[voted] @ (1 - good[voted]) + 2)
                    odds[cast] += np.log(yes / no)
        fresh = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        moved = np.abs(fresh - good).max()
        good = fresh
        if moved < 1e-9:
            break
    return dict(zip(patterns, good.tolist()))


def train(rows: pd.DataFrame) -> np.ndarray:
    """Weights (the last one is the constant) of a logistic scorer; ``places``, ``shares`` and the weak ``label`` of each row."""
    rows = rows.sort_values("key", kind="stable")
    at = np.r_[0, np.cumsum(rows["places"].map(len).to_numpy())].astype(np.int64)
    place = np.concatenate(rows["places"].to_list()) if len(rows) else np.zeros(0, np.int64)
    value = np.concatenate(rows["shares"].to_list()) if len(rows) else np.zeros(0)
    row = np.repeat(np.arange(len(rows)), np.diff(at))
    label = rows["label"].to_numpy(np.float64)
    weights, squares = np.zeros(DIMENSIONS + 2), np.full(DIMENSIONS + 2, 1e-8)
    for _ in range(STEPS if len(rows) else 0):
        margin = np.bincount(row, weights[place] * value, len(rows)) + weights[-1]
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label
        slope = np.bincount(place, error[row] * value, DIMENSIONS + 2) / len(rows)
        slope[-1] = error.mean()
        slope += RIDGE * weights
        squares += slope**2
        weights -= RATE * slope / np.sqrt(squares)
    return weights


_CODE = 3 ** np.arange(len(LABELLERS) - 1, -1, -1)


def _vote_table(texts: DataFrame) -> DataFrame:
    """digest, code of the pattern of votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                code = (votes(part.column("_text")) + 1) @ _CODE
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(code.astype(np.int32))], ["digest", "code"])

    return texts.select("digest", "_text").mapInArrow(run, "digest string, code int")


def weak_labels(voted: DataFrame) -> np.ndarray:
    """Chance of good by code of a pattern of votes; patterns that do not occur are not numbers."""
    out = np.full(3 ** len(LABELLERS), np.nan)
    counted = voted.groupBy("code").count().collect()  # at most 3 ** 9 patterns
    patterns = list(product((-1, 0, 1), repeat=len(LABELLERS)))
    for pattern, chance in estimate({patterns[r["code"]]: r["count"] for r in counted}).items():
        out[patterns.index(pattern)] = chance
    return out


def fit(texts: DataFrame, voted: DataFrame, posterior: np.ndarray, sample: int) -> np.ndarray:
    """Train on the documents of the smallest text hashes, about ``sample``. One task holds their features."""
    distinct = voted.agg(F.approx_count_distinct("digest")).first()[0]
    share = min(1.0, sample / max(distinct, 1))
    key = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    picked = texts.where(key < share * 2**32).select("digest", "_text").dropDuplicates(["digest"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                place, value, text = features(part.column("_text"))
                joint = text * (DIMENSIONS + 2) + place
                joint, inverse = np.unique(joint, return_inverse=True)
                value = np.bincount(inverse, value, len(joint)).astype(np.float32)
                text, place = joint // (DIMENSIONS + 2), (joint % (DIMENSIONS + 2)).astype(np.int32)
                at = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32))
                label = posterior[(votes(part.column("_text")) + 1) @ _CODE]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("digest"), pa.ListArray.from_arrays(at, pa.array(place)),
                        pa.ListArray.from_arrays(at, pa.array(value)), pa.array(label),
                    ],
                    ["key", "places", "shares", "label"],
                )

    rows = picked.mapInArrow(hashed, "key string, places array<int>, shares array<float>, label double")
    fitted = rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda pdf: pd.DataFrame({"weights": [train(pdf)]}), "weights array<double>").first()
    return np.array(fitted.weights) if fitted else np.zeros(DIMENSIONS + 2)


def _scored(texts: DataFrame, sample: int) -> DataFrame:
    """Columns of ``texts`` but ``_text`` and ``digest``, and votes, posterior and score."""
    voted = stored(_vote_table(texts), "votes")
    posterior = weak_labels(voted)
    weights = fit(texts, voted, posterior, sample)
    shared = texts.sparkSession.sparkContext.broadcast((weights.tobytes(), posterior.tobytes()))  # of fixed size
    others = [c for c in texts.columns if c not in ("_text", "digest")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, weak = map(np.frombuffer, shared.value)
        for batch in batches:
            for part in pieces(batch, "_text"):
                place, value, text = features(part.column("_text"))
                margin = np.bincount(text, w[place] * value, part.num_rows) + w[-1]
                held = np.bincount(text, minlength=part.num_rows) > 0
                score = np.where(held, 1 / (1 + np.exp(-np.clip(margin, -30, 30))), 0.0)
                cast = votes(part.column("_text"))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, cast.size + 1, len(LABELLERS), dtype=np.int32)), pa.array(cast.astype(np.int32).ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in others), lists, pa.array(weak[(cast + 1) @ _CODE]), pa.array(score)],
                    [*others, "votes", "posterior", "score"],
                )

    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in others)
    return texts.mapInArrow(run, f"{kinds}, votes array<int>, posterior double, score double")


def _digest(text: str) -> F.Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, votes, posterior (weak label), score, keep."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), _digest(text_col).alias("digest"))
    return _scored(texts, sample).withColumn("keep", F.col("score") >= THRESHOLD)


def without_rejected(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, with all their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"), _digest("text").alias("digest"))
    return _scored(rows, sample).where(F.col("score") >= THRESHOLD).select("_row.*")


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    found = judge(documents(spark, sf_dir))
    return found.select("doc_id", "posterior", "score", "keep", F.array_join("votes", " ").alias("votes"))


QUERIES = {"op3_quality_classifier": (op3_quality_classifier, None)}

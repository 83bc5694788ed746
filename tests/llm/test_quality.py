import random

import numpy as np
import plain
import pyarrow as pa
import pyarrow.parquet as pq

from fleetlens.llm import quality

SF = "/root/testdata/sf0.01"


def test_labellers_see_the_defects_they_are_named_after():
    rng = random.Random(1)
    letters = "abdefiklmnorstu"
    clean = ". ".join(" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(9)) for _ in range(20)) + "."
    texts = {
        "clean": clean, "symbols": " ".join(w + "$$$" for w in clean.split()), "capitals": clean.upper(),
        "bare_symbols": clean.replace(" ", " | "), "repeats": "again " * 200, "exclamations": clean.replace(" ", "!! "),
    }
    cast = quality.votes(pa.array(list(texts.values())))
    for row, name in zip(cast, texts):
        if name == "clean":
            assert (row >= 0).all()
        else:
            assert row[quality.LABELLERS.index(name)] == -1
    assert not quality.votes(pa.array(["", None, "a b"])).any()


def test_estimation_finds_the_accuracies_it_was_drawn_from():
    rng = np.random.default_rng(2)
    good = rng.random(40_000) < 0.8
    right = [0.95, 0.9, 0.85, 0.8, 0.75, 0.9, 0.7, 0.85, 0.9]
    cast = np.stack([np.where(rng.random(len(good)) < r, np.where(good, 1, -1), np.where(good, -1, 1)) for r in right], axis=1)
    cast[rng.random(cast.shape) < 0.2] = 0
    counts = {}
    for row in map(tuple, cast.tolist()):
        counts[row] = counts.get(row, 0) + 1
    chance = quality.estimate(counts)
    found = np.array([chance[tuple(r)] for r in cast.tolist()]) >= 0.5
    assert (found == good).mean() > 0.97
    assert quality.estimate({}) == {}


def test_held_out_accuracy_against_gold_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    got = {r.doc_id: r for r in quality.op3_quality_classifier(spark, SF).collect()}
    assert len(got) == pq.read_table(f"{SF}/documents.parquet").num_rows
    clean = [got[i].keep for i, q in labels.items() if q == 1]
    junk = [not got[i].keep for i, q in labels.items() if q == 0]
    assert sum(clean) >= 0.99 * len(clean)
    assert sum(junk) >= 0.9 * len(junk)


def test_awkward_documents(spark):
    rows = plain.awkward()
    got = quality.judge(plain.frame(spark)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert all(0 <= r.score <= 1 and len(r.votes) == len(quality.LABELLERS) for r in got)
    empty = [r for r in got if r.doc_id in (4, 5, 6)]
    assert len(empty) == 3 and all(r.score == 0 and not r.keep for r in empty)
    assert len({r.score for r in got if r.doc_id == 1}) == 1


def test_rejected_rows_go_and_columns_stay(spark):
    frame = plain.frame(spark)
    left = quality.without_rejected(frame)
    assert left.columns == frame.columns
    kept = sorted(str(r.doc_id) for r in quality.judge(frame).where("keep").collect())
    assert sorted(str(r.doc_id) for r in left.collect()) == kept


def test_empty_table(spark):
    assert quality.judge(plain.frame(spark, [])).count() == 0
    assert quality.without_rejected(plain.frame(spark, [])).count() == 0

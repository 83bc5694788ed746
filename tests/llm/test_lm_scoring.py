import math

import numpy as np
import plain
import pyarrow.parquet as pq
import pytest

from fleetlens.llm import lm_scoring, recurrent

SF = "/root/testdata/sf0.001"


def check(rows, got):
    """Counts and base score like brute force; returns the scores."""
    total, want = plain.base_scores(rows)
    found = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=lambda r: (str(r[0]), r[2], r[5]))
    want = sorted(((i, *w[:3], total, w[3]) for (i, _), w in zip(rows, want)), key=lambda r: (str(r[0]), r[2], r[5]))
    assert [f[:5] for f in found] == [w[:5] for w in want]
    assert [f[5] for f in found] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert all(math.isfinite(r.score) and r.score <= 1e-6 for r in got)


def test_awkward_documents(spark):
    rows = [(r[0], r[1]) for r in plain.awkward()]
    check(rows, lm_scoring.score_documents(plain.frame(spark)).collect())


def test_registered_query_beats_the_counts(spark):
    table = pq.read_table(f"{SF}/documents.parquet")
    rows = list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))
    got = lm_scoring.op2_lm_scoring(spark, SF).collect()
    check(rows, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def parameters(seed=0, noise=0.3):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 50, recurrent.HEAD).astype(float)
    counts[0] = 20
    return recurrent.start(counts, rng.integers(1, 500, recurrent.BANDS).astype(float)) + rng.normal(0, noise, recurrent.SIZE).astype(np.float32)


def test_probabilities_add_up_to_one():
    flat = parameters()
    p = recurrent.views(flat)
    h = np.random.default_rng(1).normal(0, 1, (3, recurrent.STATE)).astype(np.float32)
    ids = np.arange(recurrent.HEAD + recurrent.BANDS)
    for state in h:
        logs = recurrent.likelihood(p, np.tile(state, (len(ids), 1)), ids)
        assert np.exp(logs.astype(np.float64)).sum() == pytest.approx(1, abs=1e-4)


def test_state_is_carried_over_windows_and_not_over_documents():
    rng = np.random.default_rng(3)
    flat = parameters(2)
    p = recurrent.views(flat)
    documents = [np.r_[rng.integers(1, recurrent.HEAD + recurrent.BANDS, n), 0].astype("<u2") for n in (0, 1, 15, 16, 17, 100, 1000, 3)] * 3
    got = recurrent.score(flat, documents)
    for d, value in zip(documents, got):
        h, total = np.zeros((1, recurrent.STATE), np.float32), 0.0
        for x in d.astype(int):  # one token at a time, no windows, no lanes
            total += recurrent.likelihood(p, h, np.array([x]))[0]
            _, h = recurrent._steps(p, np.array([[x]]), h, None)
        assert value == pytest.approx(total, rel=1e-4)


def test_long_documents_are_trained_on_in_their_own_context(monkeypatch):
    """With parameters that stay, the likelihood seen in training is that of scoring."""
    rng = np.random.default_rng(6)
    flat = parameters(7)
    recurrent.views(flat)["classes"][:] *= 10  # the state matters
    documents = [np.r_[rng.integers(1, recurrent.HEAD, n), 0].astype("<u2") for n in (2500, 1023, 1024, 5000, 20, 700)]
    seen, real = [], recurrent.gradient

    def watched(p, g, ids, weight, h):
        states, _ = recurrent._steps(p, ids, h, None)
        logs = recurrent.likelihood(p, states.reshape(-1, recurrent.STATE), ids.ravel())
        seen.append(float((logs * weight.ravel()).sum(dtype=np.float64)))
        return real(p, g, ids, weight, h)

    monkeypatch.setattr(recurrent, "gradient", watched)
    monkeypatch.setattr(recurrent, "RATE", 0.0)
    _, tokens = recurrent.train(flat, [documents])
    assert tokens == sum(map(len, documents))
    assert sum(seen) == pytest.approx(recurrent.score(flat, documents).sum(), abs=0.05)


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(4)
    flat = parameters(5, 0.1)
    ids = rng.integers(0, recurrent.HEAD + recurrent.BANDS, (16, 100)).astype(np.int32)
    ids[rng.random(ids.shape) < 0.1] = 0
    weight = (rng.random(ids.shape) < 0.9).astype(np.float32)
    h = rng.normal(0, 0.5, (100, recurrent.STATE)).astype(np.float32)
    slope = np.zeros(recurrent.SIZE, np.float32)
    recurrent.gradient(recurrent.views(flat), recurrent.views(slope), ids, weight, h)

    def loss(values):
        p = recurrent.views(values)
        states, _ = recurrent._steps(p, ids, h, None)
        logs = recurrent.likelihood(p, states.reshape(-1, recurrent.STATE), ids.ravel()).astype(np.float64)
        return -(logs * weight.ravel()).sum() / weight.sum()

    for name, part in recurrent.views(slope).items():
        at = np.unravel_index(np.abs(part).argmax(), part.shape)
        up, down = flat.copy(), flat.copy()
        recurrent.views(up)[name][at] += 0.01
        recurrent.views(down)[name][at] -= 0.01
        assert (loss(up) - loss(down)) / 0.02 == pytest.approx(part[at], rel=0.02, abs=1e-5)


def test_each_word_of_the_head_has_its_own_id(spark):
    """2,047 words beside the end; the next ones share bands. All known words together stay 262,144."""
    rows = [(i, 10_000 - i) for i in range(2100)] + [(lm_scoring.END_KEY, 5)]
    words = lm_scoring.Vocabulary(spark.createDataFrame(rows, "key long, n long"))
    ids = dict(zip(words.keys.tolist(), words.ids.tolist()))
    assert [ids[i] for i in range(2047)] == list(range(1, 2048))
    assert {ids[i] for i in range(2047, 2100)} == {2048}
    p = recurrent.views(parameters())
    assert p["inputs"].shape[0] == 2048 + recurrent.BANDS and p["word_bias"].size == 2048
    assert lm_scoring.KNOWN == 262_144


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "LEARNER_TOKENS", 8_000)  # so that there are several learners
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    copies = docs.unionByName(docs.where("doc_id % 3 = 0"))  # repeated rows among them
    found = []
    for n in (1, 3, 7):
        got = lm_scoring.score_documents(copies.repartition(n)).collect()
        found.append(sorted((r.doc_id, r.n_tokens, r.score) for r in got))
    for other in found[1:]:
        assert [r[:2] for r in other] == [r[:2] for r in found[0]]
        assert [r[2] for r in other] == pytest.approx([r[2] for r in found[0]], rel=1e-5)


def test_learners_follow_from_the_table(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "LEARNER_TOKENS", 100)
    rows = [(i, False, bytes([i % 256, i // 256]) * 10) for i in range(900)] + [(1, True, b"xx")]
    encoded = spark.createDataFrame(rows, "doc_id long, held_out boolean, ids binary")
    dealt, learners = lm_scoring.dealt(encoded, 9000)
    sizes = {(r["round"], r["learner"]): r["count"] for r in dealt.groupBy("round", "learner").count().collect()}
    assert learners == 30 and sum(sizes.values()) == 900 and max(sizes.values()) < 40


@pytest.mark.parametrize("kind", ["equal", "levels", "one_level", "all"])
def test_vocabulary_fills_up_among_equal_counts(spark, monkeypatch, kind):
    """The first words by count, then key, however many share the count at which there is no more room."""
    monkeypatch.setattr(lm_scoring, "KNOWN", 500)
    rng = np.random.default_rng(8)
    keys = rng.choice(2**63 - 1, 3000, replace=False) * rng.choice([-1, 1], 3000)
    n = {
        "equal": np.ones(3000, int), "levels": rng.integers(1, 40, 3000), "one_level": rng.integers(1_000_000, 1_000_400, 3000),
        "all": rng.integers(1, 9, 3000),
    }[kind]
    rows = list(zip(keys.tolist(), n.tolist()))[: 400 if kind == "all" else None]
    got = lm_scoring.Vocabulary._most_frequent(spark.createDataFrame(rows, "key long, n long"))
    want = sorted(rows, key=lambda r: (-r[1], r[0]))[:499]
    assert list(zip(*(g.tolist() for g in got))) == want


def test_empty_and_all_held_out(spark):
    assert lm_scoring.score_documents(plain.frame(spark, [])).count() == 0
    held = [i for i in range(200) if plain.base_scores([(i, "a")])[1][0][0]][:3]
    rows = [(i, "some words") for i in held]
    check(rows, lm_scoring.score_documents(plain.small(spark, rows)).collect())


def test_a_long_document_takes_its_own_room_only():
    """600 short documents beside one of 60,000 tokens: lanes padded to the longest would hold 30 million places."""
    import tracemalloc

    rng = np.random.default_rng(3)
    flat = recurrent.start(np.ones(recurrent.HEAD), np.ones(recurrent.BANDS))
    documents = [np.r_[rng.integers(1, recurrent.HEAD, 20), 0].astype("<u2") for _ in range(600)]
    documents.append(np.r_[rng.integers(1, recurrent.HEAD, 60_000), 0].astype("<u2"))
    tracemalloc.start()
    scores = recurrent.score(flat, documents)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and np.allclose(scores[:600], recurrent.score(flat, documents[:600]), rtol=1e-4)

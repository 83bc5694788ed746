import random

import plain
import pyarrow.parquet as pq
import pytest

from fleetlens.llm import ngram_join
from fleetlens.llm.components import components

SF = "/root/testdata/sf0.001"


def expected(rows):
    texts = [t for _, t in rows]
    links = plain.jaccard_links(texts)
    roots = plain.component_of(len(rows), links)
    count = [0] * len(rows)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    ids = {}
    for (i, _), root in zip(rows, roots):
        ids.setdefault(root, []).append(i)
    out = []
    for k, (i, t) in enumerate(rows):
        known = [x for x in ids[roots[k]] if x is not None]
        same = [j for j, (_, other) in enumerate(rows) if plain.shingle_set(other) == plain.shingle_set(t)]
        some = bool(plain.shingle_set(t))
        out.append((i, (min(known) if known else None) if some else i, len(same) if some else 1, count[k]))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.class_id, r.n_copies, r.n_links) for r in df.collect()], key=str)


def variants(n, words, seed=3):
    """Near copies of one text with one to three words changed, chains of small changes, and texts of their own."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10_000)}" for _ in range(words)]
    rows, chain = [], list(base)
    for i in range(n):
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(words)] = f"v{rng.randint(0, 10_000)}"
        rows.append((i, " ".join(text)))
        chain[rng.randrange(words)] = f"c{i}"
        rows.append((1000 + i, " ".join(chain)))
        rows.append((2000 + i, " ".join(f"u{rng.randint(0, 300)}" for _ in range(rng.randint(1, 60)))))
    return rows


def test_awkward_documents_like_brute_force(spark):
    rows = [(r[0], r[1]) for r in plain.awkward()]
    assert got(ngram_join.similar_documents(plain.frame(spark))) == expected(rows)


def test_near_copies_chains_and_strangers(spark):
    rows = variants(60, 90)
    assert got(ngram_join.similar_documents(plain.small(spark, rows))) == expected(rows)


def test_deep_trees_and_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "NODE", 6)
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    rows = variants(40, 90, 4)
    assert got(ngram_join.similar_documents(plain.small(spark, rows))) == expected(rows)


def test_splitting_without_dense_nodes(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "NODE", 6)
    monkeypatch.setattr(ngram_join, "DENSE", 2.0)
    monkeypatch.setattr(ngram_join, "DEPTH", 3)
    rows = variants(25, 90, 5)
    assert got(ngram_join.similar_documents(plain.small(spark, rows))) == expected(rows)


def test_registered_query(spark):
    table = pq.read_table(f"{SF}/documents.parquet")
    rows = list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))
    assert got(ngram_join.op1_ngram_jaccard_join(spark, SF)) == expected(rows)


def test_one_row_of_each_class_stays(spark):
    rows = [(r[0], r[1]) for r in plain.awkward()]
    frame = plain.frame(spark)
    left = ngram_join.one_of_each_class(frame)
    assert left.columns == frame.columns
    roots = plain.component_of(len(rows), plain.jaccard_links([t for _, t in rows]))
    classes = {root for root, (_, t) in zip(roots, rows) if plain.shingle_set(t)}
    empty = [t for _, t in rows if not plain.shingle_set(t)]
    texts = [r.text for r in left.collect()]
    assert len(texts) == len(classes) + len(empty)
    assert plain.jaccard_links(texts) == []


def test_more_runs_than_coordinates_are_refused(spark):
    """A recall that cannot be reached is an error, not a lower recall."""
    assert ngram_join.runs_needed(0.38, 0.99999) * ngram_join.BRANCH > ngram_join.COORDINATES
    with pytest.raises(ValueError, match="coordinates"):
        ngram_join.similar_documents(plain.frame(spark), similarity=0.38, recall=0.99999)


def test_runs_follow_from_the_recall():
    for s in (0.5, 0.8, 0.95):
        loss = ngram_join.loss_of_a_run(s)
        assert abs(loss - (1 - s + s * loss) ** ngram_join.BRANCH) < 1e-9
        for recall in (0.9, 0.999, 0.99999):
            runs = ngram_join.runs_needed(s, recall)
            assert 1 - loss**runs >= recall
            assert runs == 1 or 1 - loss ** (runs - 1) < recall


@pytest.mark.parametrize("shape", ["chain", "star", "cycle", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(6)
    edges = {
        "chain": [(i, i + 1) for i in range(40)], "star": [(i, 100) for i in range(60)], "cycle": [(i, (i + 1) % 30) for i in range(30)],
        "random": [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)], "none": [(3, 3)],
    }[shape]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    roots = plain.component_of(101, edges)
    assert found == {i: roots[i] for e in edges if e[0] != e[1] for i in e}


def test_empty_table(spark):
    assert ngram_join.similar_documents(plain.frame(spark, [])).count() == 0
    assert ngram_join.one_of_each_class(plain.frame(spark, [])).count() == 0

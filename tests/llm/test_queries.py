"""The registered queries against their SQL twins, and the pipeline stage by stage against brute force."""

import os
import sys

import plain
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from fleetlens.llm.queries import QUERIES
from fleetlens.llm.session import stored

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_every_operator_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]


@pytest.mark.parametrize("name", sorted(n for n, (_, text) in QUERIES.items() if text))
def test_same_as_sql(spark, name):
    query, text = QUERIES[name]
    assert compare(spark, connect(SF), query, text, SF) is None


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_like_brute_force(spark):
    """Each stage on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    for name, stage in corpus_pipeline.STAGES:
        before = rows_of(docs)
        out = stored(stage(spark, docs, SF), f"test-{name}")
        if name == "packing":
            assert sum(r.length for r in out.collect()) == sum(r.doc_tokens for r in out.collect() if r.start == 0)
            assert {r.doc_id for r in out.collect()} == {i for i, _ in before}
            break
        assert out.columns == docs.columns
        after = rows_of(out)
        assert set(after) <= set(before) and len(after) == len(set(after))
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
            kept = {i for i, _ in after}
            good = [i in kept for i, q in labels.items() if q == 1]
            bad = [i not in kept for i, q in labels.items() if q == 0]
            assert sum(good) >= 0.98 * len(good) and sum(bad) >= 0.85 * len(bad)
        elif name == "exact_dedup":
            best = {}
            for i, t in before:
                best[plain.lower(t)] = max(best.get(plain.lower(t), i), i)
            assert sorted(i for i, _ in after) == sorted(best.values())
        elif name == "near_dedup":
            roots = plain.component_of(len(before), plain.jaccard_links([t for _, t in before]))
            least = {}
            for (i, _), root in zip(before, roots):
                least[root] = min(least.get(root, i), i)
            assert sorted(i for i, _ in after) == sorted(least.values())
        elif name == "decontamination":
            found = plain.contamination([t for _, t in before], items)
            assert sorted(after) == sorted((i, t) for (i, t), (n, hit, _) in zip(before, found) if not (hit and 20 * hit >= n))
        docs = out


def test_pipeline_with_awkward_documents(spark, tmp_path):
    plain.frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {"doc_id", "sequence_id", "offset"} <= set(out[0].asDict())

import plain
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import mixing
from fleetlens.llm.running import in_order

SF = "/root/testdata/sf0.001"


def sources(spark, rows):
    """(id, source, words)"""
    return plain.frame(spark, [(i, "w " * n, "en", s, None) + (None,) * plain.EXTRA for i, s, n in rows])


def check(rows, got):
    sizes, target = plain.mixture([(s, n) for _, s, n in rows])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.source or "", r.size) for r in got) == sorted((i is None, i or 0, s or "", n) for i, s, n in rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        rate = target[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert int(rate + 1e-9) <= r.copies + 1 and r.copies <= 2 and r.copies in (int(rate), int(rate) + 1, round(rate))


@pytest.mark.parametrize("shape", [
    [(1, "a", 100), (2, "b", 100), (3, "c", 100), (4, "d", 5), (5, "e", 900), (6, None, 40), (7, "", 12)],
    [(1, "a", 1), (2, "b", 1000), (3, "c", 1000)],
    [(1, "a", 0), (2, "b", 0)],
    [(1, None, 7), (1, None, 7), (None, None, 3), (None, "x", 3)],
    [(i, f"s{i}", i * i) for i in range(60)],
])
def test_targets_like_sharing_again_and_again(spark, shape):
    got = mixing.copies_of(sources(spark, shape)).collect()
    check(shape, got)
    _, target = plain.mixture([(s, n) for _, s, n in shape])
    assert sum(target.values()) == pytest.approx(1.5 * sum(n for *_, n in shape))


def test_awkward_documents(spark):
    rows = [(r[0], r[3], len(plain.TOKEN.findall(r[1] or ""))) for r in plain.awkward()]
    check(rows, mixing.copies_of(plain.frame(spark)).collect())


def test_the_mix_holds_each_document_as_often_as_it_has_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("size", F.lit("clash")).withColumn("copies", F.lit(-1)).withColumn("draw", F.lit(0))
    want = {r.doc_id: r.copies for r in mixing.copies_of(docs).collect() if r.copies}
    made = mixing.mix(docs)
    assert made.columns == docs.columns
    assert {r.doc_id: r["count"] for r in made.groupBy("doc_id").count().collect()} == want


def test_copies_do_not_depend_on_partitions_and_follow_the_rate(spark):
    rows = [(i, "half" if i % 3 else "other", 10) for i in range(6_000)]
    docs = sources(spark, rows)
    a, b = (sorted(tuple(r) for r in mixing.copies_of(docs.repartition(n)).collect()) for n in (1, 7))
    assert a == b
    for source in ("half", "other"):
        taken = sum(r[2] * r[5] for r in a if r[1] == source)
        target = next(r[4] for r in a if r[1] == source)
        assert abs(taken - target) < 0.05 * target
    other = sorted(tuple(r) for r in mixing.copies_of(docs, seed="another").collect())
    assert other != a


def test_own_weights_share_and_limit(spark):
    rows = [(i, "abc"[i % 3], 10) for i in range(30)]
    got = mixing.copies_of(sources(spark, rows), weights=(1,), share=2.5, limit=3).collect()
    assert {round(r.target, 6) for r in got} == {250.0} and {r.copies for r in got} <= {2, 3}


def test_empty_table(spark):
    assert mixing.copies_of(plain.frame(spark, [])).count() == 0
    assert mixing.mix(plain.frame(spark, [])).count() == 0


def test_running_sums_over_many_ranges(spark):
    df = spark.range(5_000).select((F.col("id") * 7919 % 5_000).alias("k"), (F.col("id") % 11).alias("x"), F.lit(1).cast("long").alias("one"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r.k, r.x, r._place, r._before_x, r._part) for r in in_order(df, [F.col("k")], "test-order", ["x"]).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r[4] for r in got}) > 1
    before = 0
    for i, (k, x, place, prior, _) in enumerate(got):
        assert (k, place, prior) == (i, i, before)
        before += x

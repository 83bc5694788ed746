import hashlib
from collections import Counter, defaultdict

import plain
from pyspark.sql import functions as F

from fleetlens.llm import exact_dedup


def expected(rows, best):
    groups = defaultdict(list)
    for i, text in rows:
        groups[plain.lower(text)].append(i)
    out = Counter()
    for i, text in rows:
        ids = groups[plain.lower(text)]
        known = [x for x in ids if x is not None]
        keep = best(known) if known else None
        out[i, keep, len(ids), i == keep, hashlib.sha256(plain.lower(text).encode()).hexdigest()] += 1
    return out


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_awkward_rows_like_brute_force(spark):
    rows = [(r[0], r[1]) for r in plain.awkward()]
    for keep, best in (("largest", max), ("smallest", min)):
        assert rows_of(exact_dedup.copy_groups(plain.frame(spark), keep=keep)) == expected(rows, best)


def test_a_hash_that_collides_gives_the_same_rows(spark):
    docs = plain.frame(spark)
    weak = exact_dedup.copy_groups(docs, digest=lambda c: F.length(c).cast("string") % 3)
    assert rows_of(weak) == rows_of(exact_dedup.copy_groups(docs))


def test_one_row_of_each_text_stays_with_all_columns(spark):
    docs = plain.frame(spark)
    left = exact_dedup.without_copies(docs)
    assert left.columns == docs.columns
    texts = [plain.lower(r.text) for r in left.collect()]
    assert sorted(texts) == sorted({plain.lower(r[1]) for r in plain.awkward()})
    assert 1 in {r.doc_id for r in left.collect()}


def test_empty_table(spark):
    assert exact_dedup.copy_groups(plain.frame(spark, [])).count() == 0
    assert exact_dedup.without_copies(plain.frame(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = exact_dedup.copy_groups(plain.frame(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "MapIn"))

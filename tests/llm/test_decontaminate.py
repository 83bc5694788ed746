import hashlib
import random

import plain

from fleetlens.llm import decontaminate

SF = "/root/testdata/sf0.001"


def cases():
    rng = random.Random(9)
    items = [
        (1, plain.sentence(rng, 40)), (2, plain.sentence(rng, 13)), (3, "seven words that make one whole window"), (4, "one"), (5, None), (6, ""),
        (7, "green hill"), (None, "an item that has no id of its own"), (2, "café größe naïve und so weiter bis zum schönen ende hier heute"), (8, "!!!"),
        (9, "twelve words are one window too so this is twelve words here"),
    ]
    first = items[0][1].split()
    docs = [(r[0], r[1]) for r in plain.awkward() if r[1] is None or len(r[1]) < 5_000] + [
        (30, "start " + items[0][1] + " end"), (31, " ".join(first[:13])), (32, " ".join(first[1:13])), (33, items[2][1].upper() + "!"),
        (34, "x, " + items[1][1].replace(" ", " - ")), (35, " ".join(first[5:30] + ["other"] * 600)), (36, "seven words that make one whole"),
        (37, "an item that has no id of its own"), (38, items[8][1] + " " + items[10][1]), (38, items[8][1]), (39, " ".join(first[:20] + first[:20])),
    ]
    return docs, items


def run(spark, docs, items):
    table = spark.createDataFrame([(i, t, None) for i, t in items], "item_id long, text string, window string")
    got = decontaminate.contamination(plain.small(spark, docs), table).collect()
    found = plain.contamination([t for _, t in docs], items)
    want = []
    for (i, _), (n, hit, names) in zip(docs, found):
        want.append((i, n, hit, len(names - {None}), sorted(str(x) for x in names if x is not None)))
    assert sorted([(g.doc_id, g.n_words, g.n_hit, g.n_items, g["items"]) for g in got], key=str) == sorted(want, key=str)


def test_awkward_documents_like_brute_force(spark):
    docs, items = cases()
    run(spark, docs, items)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    docs, items = cases()
    run(spark, docs, items)


def test_a_small_bitmap_lets_more_through_but_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLOT_BITS", 15)
    monkeypatch.setattr(decontaminate, "BITMAP_BITS", 1 << 15)
    docs, items = cases()
    run(spark, docs[:12] + docs[-11:], items)


def test_empty_tables(spark):
    docs, items = cases()
    run(spark, [], items)
    run(spark, docs[:4], [])
    run(spark, [], [])


def test_contaminated_rows_go_and_columns_stay(spark):
    docs, items = cases()
    table = spark.createDataFrame(items, "item_id long, text string")
    frame = plain.small(spark, docs)
    left = decontaminate.without_contaminated(frame, table)
    found = plain.contamination([t for _, t in docs], items)
    want = [(i, t) for (i, t), (n, hit, _) in zip(docs, found) if not (hit and 20 * hit >= n)]
    assert left.columns == frame.columns
    assert sorted([(r.doc_id, r.text) for r in left.collect()], key=str) == sorted(want, key=str)


def test_digest_of_no_items_is_that_of_the_empty_text(spark):
    got = decontaminate.op5_decontamination(spark, SF).where("n_items = 0").first()
    assert got.items_sha256 == hashlib.sha256(b"").hexdigest()

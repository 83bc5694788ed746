import gzip
from collections import Counter

import plain
import pyarrow.fs as pafs

from fleetlens.llm import warc
from fleetlens.session import shared_dir

PAGES = [
    (1, "http://a.org/", "<p>one</p>"), (2, "http://b.org/x", "<p>one</p>"), (3, None, "<p>one</p>"), (4, "http://c.org/", None), (5, "", ""),
    (6, "http://d.org/\r\nX: y", "line\r\n\r\nbreaks\n"), (None, "http://e.org/", "<p>one</p>"), (None, "http://f.org/", "alone"),
    (7, "http://ü.org/é", "größe 漢字 " * 3), (8, "http://g.org/", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc"), (9, "http://h.org/", "z" * 3_000_000),
    (9, "http://h.org/2", "z" * 3_000_000), (10, "http://i.org", "a" * 50_000),
]


def table(spark, rows=PAGES):
    return spark.createDataFrame([(*r, None, None) for r in rows], "page_id long, url string, html string, refers_to string, _keep long")


def expected(rows, least=0):
    largest = {}
    for i, _, html in rows:
        html = html or ""
        if i is not None and len(html.encode()) >= least:
            largest[html] = max(largest.get(html, i), i)
    out = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        keep = largest.get(html or "")
        revisit = keep is not None and keep != i
        out[i, len(data), plain.base32_sha1(data), "revisit" if revisit else "response", keep if revisit else None] += 1
    return out


def test_round_trip_like_brute_force(spark):
    for least in (0, 20):
        path = shared_dir(spark, "test-warc")
        warc.archive_pages(table(spark), path, least)
        assert Counter(tuple(r) for r in warc.read_pages(spark, path).collect()) == expected(PAGES, least)


def test_payloads_and_pushed_predicates(spark):
    path = shared_dir(spark, "test-warc")
    warc.archive_pages(table(spark).coalesce(1), path)
    full = spark.read.format("warc").load(path)
    texts = {r.record_id: r.payload for r in full.collect()}
    assert texts["urn:page:7"].decode() == PAGES[8][2] and texts["urn:page:1"] is None
    some = full.where("record_type = 'revisit'").select("record_id")
    assert {r.record_id for r in some.collect()} == {"urn:page:1", "urn:page:2", "urn:page:4", "urn:page:"}
    assert full.where("target_uri LIKE 'http://h%' AND payload_bytes > 5").count() == 2
    assert full.where("target_uri IS NULL").count() == 1


class Counting:
    """A file that counts the bytes read."""

    def __init__(self, data):
        self.data, self.at, self.read_bytes = data, 0, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        self.read_bytes += len(out)
        return out


def archive(gzipped):
    import random

    rng = random.Random(1)
    rows = [
        {"record_id": f"r{i}", "target_uri": "http://x/", "payload": bytes(rng.randbytes(2_000_000)), "refers_to": None, "payload_sha1": None, "payload_bytes": None}
        for i in range(4)
    ]
    data = [warc.record(r, "2024-01-01T00:00:00Z") for r in rows]
    return rows, data, b"".join(map(warc.gzip_member, data)) if gzipped else b"".join(data)


def test_unwanted_payloads_are_jumped_over():
    for gzipped in (True, False):
        rows, _, data = archive(gzipped)
        file = Counting(data)
        got = list(warc.records(file, 0, len(data), gzipped, lambda h: h[b"warc-record-id"] == b"<r2>"))
        assert [b is not None for _, b in got] == [False, False, True, False]
        assert got[2][1].partition(b"\r\n\r\n")[2] == rows[2]["payload"]
        assert file.read_bytes < len(data) / 2


def test_foreign_gzip_members_and_splits():
    rows, plain_records, _ = archive(True)
    members = [gzip.compress(r, 1) for r in plain_records]
    data = b"".join(members)
    for wanted in (lambda h: True, lambda h: False):
        got = list(warc.records(Counting(data), 0, len(data), True, wanted))
        assert [h[b"warc-record-id"] for h, _ in got] == [b"<r%d>" % i for i in range(4)]
    middle = len(members[0]) + len(members[1])
    assert len(list(warc.records(Counting(data), 0, middle, True, lambda h: True))) == 2
    assert len(list(warc.records(Counting(data), middle, len(data), True, lambda h: True))) == 2


def test_a_broken_payload_is_noticed(spark):
    path = shared_dir(spark, "test-warc")
    warc.register(spark)
    rows = [("r", "http://x/", "payload", None, None, None)]
    kinds = "record_id string, target_uri string, payload string, refers_to string, payload_sha1 string, payload_bytes long"
    spark.createDataFrame(rows, kinds).write.format("warc").mode("append").option("path", path).option("compression", "none").save()
    store, folder = pafs.FileSystem.from_uri(path)
    name = next(f.path for f in store.get_file_info(pafs.FileSelector(folder)) if f.path.endswith(".warc"))
    with store.open_input_stream(name) as f:
        data = f.read()
    with store.open_output_stream(name) as f:
        f.write(data.replace(b"payload\r\n", b"PAYLOAD\r\n"))
    read = spark.read.format("warc").option("verify", "true").load(path)
    try:
        read.collect()
    except Exception as e:
        assert "digest" in str(e)
    else:
        raise AssertionError("not noticed")


def test_files_outside_the_manifest_are_ignored_and_empty_tables_work(spark):
    path = shared_dir(spark, "test-warc")
    warc.archive_pages(table(spark, []), path)
    assert warc.read_pages(spark, path).count() == 0
    store, folder = pafs.FileSystem.from_uri(path)
    with store.open_output_stream(f"{folder}/part-lost.warc") as f:
        f.write(b"WARC/1.1\r\nhalf a rec")
    assert warc.read_pages(spark, path).count() == 0


def test_ids_that_are_texts_come_back(spark):
    path = shared_dir(spark, "test-warc")
    ids = ["a1", "a2", "x:y z", "é\nnext", "10%", "", None]
    rows = [(i, f"http://x/{n}", "same" if n < 3 else f"page {n}") for n, i in enumerate(ids)]
    warc.archive_pages(spark.createDataFrame(rows, "page_id string, url string, html string"), path)
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_pages(spark, path, "string").collect()}
    assert got == {("a1", "revisit", "x:y z"), ("a2", "revisit", "x:y z"), ("x:y z", "response", None),
                   ("é\nnext", "response", None), ("10%", "response", None), (None, "response", None)}
    try:
        warc.read_pages(spark, path).collect()
    except Exception as e:
        assert "CAST_INVALID_INPUT" in str(e)
    else:
        raise AssertionError("ids lost")

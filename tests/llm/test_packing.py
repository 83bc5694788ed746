import random
import zlib

import plain
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from fleetlens.llm import packing
from fleetlens.llm.tokens import public_path, word_ids

SF = "/root/testdata/sf0.001"


LOADED = Tokenizer.from_file(public_path(packing.TOKENIZER))


def whole_ids(text):
    return [*LOADED.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def check(rows, packed, size):
    """Every id of every row lies in exactly one piece; sequences have no gap."""
    pieces, sequences = {}, {}
    for r in packed:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    want = {}
    for i, text in rows:
        ids = whole_ids(text)
        data = b"".join(x.to_bytes(4, "little") for x in ids)
        cuts = [(s, min(size, len(ids) - s), zlib.crc32(data[4 * s : 4 * (s + size)])) for s in range(0, len(ids), size)]
        want.setdefault((i, len(ids)), []).extend(cuts)
    assert {k: sorted(v) for k, v in want.items()} == {k: sorted((r.start, r.length, r.ids_crc32) for r in v) for k, v in pieces.items()}
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size


@pytest.mark.parametrize("size", [16, 2048])
def test_awkward_documents(spark, size):
    docs = plain.frame(spark)
    check([(r[0], r[1]) for r in plain.awkward()], packing.pack(docs, size=size).collect(), size)


def test_registered_query_packs_tightly(spark):
    got = packing.op6_packing(spark, SF).collect()
    table = pq.read_table(f"{SF}/documents.parquet")
    check(list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist())), got, packing.SIZE)
    room = len({r.sequence_id for r in got}) * packing.SIZE
    assert sum(r.length for r in got) > 0.97 * room


def test_groups_are_independent_and_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack(docs, group_rows=7).collect()
    assert len({r.sequence_id >> 32 for r in got}) > 10
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)


def test_tournament_is_first_fit():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 100, 500):
        lengths = sorted((rng.randint(1, 50) for _ in range(n)), reverse=True)
        assert packing.first_fit(lengths, 50) == plain.first_fit(lengths, 50)


def test_ids_of_parts_are_the_ids_of_the_whole():
    rng = random.Random(4)
    ids = word_ids(public_path(packing.TOKENIZER))
    marks = ["a", "B", " ", "\n", "é", "É", "!", "'", "'s", "3", "…", "´", "漢", "\u0301", "=", "\u00a0", "<|endoftext|>", "<|", "ß", "×", "--", "\x1c"]
    for _ in range(500):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(0, 40)))
        assert ids(text) + b"\x01\0\0\0" == b"".join(x.to_bytes(4, "little") for x in whole_ids(text)), text


def test_empty_table(spark):
    assert packing.pack(plain.frame(spark, [])).count() == 0

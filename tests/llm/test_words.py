import random

import numpy as np
import plain
import pyarrow as pa
import pytest

from fleetlens.llm.words import SPACE_BYTES, WORD_BYTES, find_words, pieces, shingles, text_bytes


def texts():
    rng = random.Random(8)
    marks = ["a", "B", "z", "9", " ", "\n", "\t", "\r", "\x0b", "\x0c", "\x00", "\x01", "\x1c", "é", "漢", "!", " ", "{", "`", "@", "[", "/", ":"]
    return ["", None, "x" * 10_000 + " a b", "a b", *("".join(rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(300))]


@pytest.mark.parametrize("table, rule", [(WORD_BYTES, plain.WORD), (SPACE_BYTES, plain.TOKEN)])
def test_words_of_bytes_are_the_words_of_the_pattern(table, rule):
    every = texts()
    words = find_words(pa.array(every), table)
    raw, at = text_bytes(pa.array(every))
    got = [[words.string(i) for i in range(words.first[t], words.first[t + 1])] for t in range(len(every))]
    assert got == [rule.findall(plain.lower(t)) for t in every]
    # The same word has the same hash wherever it stands, other words another.
    flat = [w for t in got for w in t]
    assert len(set(zip(flat, words.hash.tolist()))) == len(set(flat)) == len(set(words.hash.tolist()))


@pytest.mark.parametrize("table", [WORD_BYTES, SPACE_BYTES])
def test_hashes_do_not_depend_on_the_texts_beside(table):
    every = texts()
    together = find_words(pa.array(every), table)
    alone = [find_words(pa.array([t], pa.string()), table).hash for t in every]
    assert (np.concatenate(alone) == together.hash).all()
    sliced = find_words(pa.array(every)[7:40], table)
    assert (sliced.hash == together.hash[together.first[7] : together.first[40]]).all()


def test_pieces_are_all_rows_in_order():
    batch = pa.record_batch({"t": pa.array(["a" * n for n in (5, 50, 500, 0, 1, 2)] + [None])})
    for most in (1, 10, 100, 1000):
        parts = list(pieces(batch, "t", most))
        assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()


def test_shingles():
    every = ["a b c d e f", "a b", "", "x a b c d e"]
    hashes, text, start = shingles(find_words(pa.array(every)), 5)
    assert text.tolist() == [0, 0, 1, 3, 3] and start.tolist() == [0, 1, 6, 8, 9]
    assert hashes[0] == hashes[4] and len(set(hashes.tolist())) == 4

import random

import numpy as np
import plain
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fleetlens.llm import alignment
from fleetlens.llm.session import stored
from fleetlens.llm.tokens import public_path

SF = "/root/testdata/sf0.001"
NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(public_path(alignment.A_FILE))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_path(alignment.B_FILE))
    letters = alignment._letters()

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    return (
        lambda t: a.encode(t, add_special_tokens=False).ids, lambda t: b.encode(t),
        lambda i: bytes(letters[c] for c in a.id_to_token(i)), b_bytes,
    )


def results(docs, **more):
    aligned = stored(alignment.align(docs), "test-aligned")
    return alignment.with_corpus_counts(aligned, alignment.pair_counts(aligned), **more).collect()


@pytest.mark.parametrize("frequent", [1, 40, alignment.FREQUENT])
def test_awkward_documents(spark, encoders, frequent):
    """Also where almost no pair, some, or all are looked up in the tasks."""
    rows = [(r[0], r[1]) for r in plain.awkward()] + [(30, "a ▁ b"), (31, " a  b "), (32, "<0x0A> <s>"), (33, " "), (34, "\n"), (35, "👩‍👩‍👧 🏳️‍🌈")]
    want = plain.alignment_rows([t for _, t in rows], *encoders)
    got = results(plain.small(spark, rows), frequent=frequent)
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(((i, *w) for (i, _), w in zip(rows, want)), key=key) == sorted(((r.doc_id, *(r[c] for c in NUMBERS)) for r in got), key=key)
    zeros = {r.doc_id for r in got if r.groups_sha256 == ""}
    assert {4, 5, 30} <= zeros and all(r.n_a == r.n_links == r.count_sum == 0 for r in got if r.groups_sha256 == "")


def test_registered_query_like_brute_force(spark, encoders):
    table = pq.read_table(f"{SF}/documents.parquet")
    want = plain.alignment_rows(table["text"].to_pylist(), *encoders)
    got = alignment.op13_tokenizer_alignment(spark, SF).collect()
    assert {r.doc_id: tuple(r[c] for c in NUMBERS) for r in got} == dict(zip(table["doc_id"].to_pylist(), want))
    assert len(got) == len(want)


def said(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


@pytest.fixture()
def known():
    found = alignment.aligner(public_path(alignment.A_FILE), public_path(alignment.B_FILE))
    assert found.parts and found.quick
    return found


@pytest.mark.parametrize("long", [3, 10, alignment.LONG])
def test_parts_have_the_tokens_of_the_whole(encoders, known, monkeypatch, long):
    monkeypatch.setattr(alignment, "LONG", long)
    rng = random.Random(9)
    marks = ["a", "the", "B", " ", " ", "  ", "\n", "\t", "é", "É", "!", "'s", "3", "…", "漢", "\u0301", "\u00a0", "\u3000", "<|endoftext|>", "<s>", "ß", "×", "▁",
             "\x00", "👍", "\u200d", "\x1c", "\x85", "\r\n", "ǆ", "½", "²", "ª"]
    words = ["the", "Été", "don't", "end.", "(a", "b)", "x,y;z", "3rd", "漢", "naïve", "***", "a'.'s", "\x1c", "👍", "..", "é!1", "1½"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(1, 30))) for _ in range(1_500)]
    texts += ["".join(rng.choice(marks[:13] + marks[-4:]) for _ in range(rng.randint(1, 30))) for _ in range(1_500)]
    texts += ["".join(rng.choice(words) + rng.choice("   \n") for _ in range(rng.randint(1, 20)))[:-1] for _ in range(1_500)]
    for text in texts:
        want = plain.alignment(text, *encoders)
        found = list(map(known.align, known.cut(text)))
        if want is None:
            assert None in found, repr(text)
        else:
            assert ";".join(f[4] for f in found) == said(want[2]), repr(text)


def test_a_long_text_is_cut(encoders, known):
    text = plain.sentence(random.Random(3), 60_000)
    found = list(map(known.align, known.cut(text)))
    assert len(found) > 1 and ";".join(f[4] for f in found) == said(plain.alignment(text, *encoders)[2])


def test_many_links_in_a_group_are_added_up(encoders, known):
    """Few common ends: the letters stand in long pieces on one side and alone on the other."""
    for text in ("x" * 5_000, "=" * 3_001 + " end", "ÿ" * 800, "ab" * 2_000 + "\n" + "𓀀" * 900):
        want = plain.alignment(text, *encoders)
        (_, _, _, n_links, groups, pairs, times), = map(known.align, known.cut(text))
        held = plain.collections.Counter(x << 32 | y for left, right in want[2] for x in left for y in right)
        assert dict(zip(pairs.tolist(), times.tolist())) == held and groups == said(want[2]) and n_links == sum(held.values())


def test_long_groups_go_by_distinct_ids(monkeypatch):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 5, 60), rng.integers(0, 4, 50)
    cuts = np.array([3, 20, 21, 60]), np.array([1, 30, 40, 50])
    want = alignment.links_of(a, b, *cuts)
    monkeypatch.setattr(alignment, "LISTED", 20)
    assert all(np.array_equal(x, y) for x, y in zip(want, alignment.links_of(a, b, *cuts)))
    held = plain.collections.Counter(
        int(x) << 32 | int(y) for i in range(4) for x in a[(0, *cuts[0])[i] : cuts[0][i]] for y in b[(0, *cuts[1])[i] : cuts[1][i]])
    assert dict(zip(want[0].tolist(), want[1].tolist())) == held


def test_groups_lie_between_common_ends():
    assert alignment.cuts_of(np.array([2, 1, 3]), np.array([1, 2, 3])) == ([2, 3], [2, 3])
    assert alignment.cuts_of(np.zeros(0, int), np.zeros(0, int)) == ([], [])
    assert alignment.cuts_of(np.array([4]), np.ones(4, int)) == ([1], [4])


def test_the_alignment_itself(spark):
    row = alignment.align(plain.small(spark, [(1, "unbelievable things")]), groups=True).first()
    assert len(row.groups.split(";")) == row.n_groups and len(row.pairs) == len(row.times) and sum(row.times) == row.n_links


def test_ids_of_any_type(spark):
    docs = plain.small(spark, [(1, "one word"), (2, None)]).withColumn("doc_id", plain_id())
    assert sorted(r.doc_id for r in results(docs)) == ["d1", "d2"]


def plain_id():
    from pyspark.sql import functions as F

    return F.concat(F.lit("d"), F.col("doc_id").cast("string"))


def test_empty_table(spark):
    assert results(plain.frame(spark, [])) == []


def agrees(found, text, encoders):
    want = plain.alignment(text, *encoders)
    if want is None:
        return found is None
    held = plain.collections.Counter(x << 32 | y for left, right in want[2] for x in left for y in right)
    return found and (*found[:3], found[4], dict(zip(found[5].tolist(), found[6].tolist()))) == (len(want[0]), len(want[1]), len(want[2]), said(want[2]), held)


@pytest.mark.parametrize("word, long", [(4, 30), (alignment.WORD, 200), (alignment.WORD, alignment.LONG)])
def test_parts_of_a_batch_from_its_distinct_stretches(encoders, known, monkeypatch, word, long):
    """Also where few stretches stand together, and where some of them, at any place, have other bytes."""
    monkeypatch.setattr(alignment, "WORD", word)
    monkeypatch.setattr(alignment, "LONG", long)
    rng = random.Random(4)
    words = [*plain.VOCABULARY, "don't", "end.\n", "\n", "", "(a", "x;y", "漢字", "naïve", "a▁b", "▁", "b\u00a0c", "…x", "é…é", "<s>", "=" * 90, "ﬁx", "½", "x\x1cy", "\t", "👍a", "a👍b",
             "Ünï", "x" * 40]
    texts = ["".join(rng.choice(words) + rng.choice("    \n") for _ in range(rng.randint(1, 12))) for _ in range(800)]
    texts += [t for _, t, *_ in plain.awkward() if t] + [" ", "a", "é", " a ", "\n", "a ▁ b", "a b", "b a"]
    found = known.align_all([" " + t for t in texts])
    assert [t for t, f in zip(texts, found) if not agrees(f, t, encoders)] == []
    assert any(f is None for f in found)


def test_a_piece_across_blanks_keeps_texts_whole(encoders, known, monkeypatch):
    monkeypatch.setattr(known, "parts", False)
    texts = ["the stone walks", "the stone walks slowly", "the  stone\n"]
    _, stretches, _ = known.stretches("".join(" " + t for t in texts).encode(), np.cumsum([0, *(len(t) + 1 for t in texts)]))
    assert [s.decode() for s in stretches.to_pylist()] == [" " + t for t in texts]
    assert all(agrees(f, t, encoders) for f, t in zip(known.align_all([" " + t for t in texts]), texts))


def test_repeated_words_of_a_batch_are_encoded_once(known, monkeypatch):
    rng = random.Random(6)
    texts = [" " + plain.sentence(rng, 300) for _ in range(100)]
    encoded = []
    monkeypatch.setattr(known, "quick", lambda text, ids=known.quick: encoded.append(text) or ids(text))
    known.align_all(texts)
    assert sum(map(len, encoded)) < len(texts[0])


def test_lots_do_not_change_results(spark, encoders):
    """A long text lies in several lots, and its repeated pairs are added up over them."""
    rng = random.Random(8)
    rows = [(r[0], r[1]) for r in plain.awkward()] + [(40, plain.sentence(rng, 60_000)), (41, plain.sentence(rng, 60_000) + " ▁ " + plain.sentence(rng, 60_000)), (42, "a ▁ b")]
    docs = plain.small(spark, rows)
    few, many = (sorted(map(str, alignment.align(docs, together=n, groups=True).collect())) for n in (50, alignment.TOGETHER))
    assert few == many
    (row,) = alignment.align(docs.where("doc_id = 40"), together=50).collect()
    want = plain.alignment(rows[-3][1], *encoders)[2]
    assert row.groups_sha256 == plain.hashlib.sha256(said(want).encode()).hexdigest() and sum(row.times) == row.n_links
    assert [r.n_a for r in alignment.align(docs.where("doc_id in (41, 42)"), together=50).collect()] == [0, 0]
    assert [len(lot) for lot in alignment.lots(((i, "abc") for i in range(5)), 6)] == [2, 2, 1]

import random

import numpy as np
import plain
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetlens.llm import token_counts
from fleetlens.llm.session import stored
from fleetlens.llm.tokens import public_path, stretch_counts

SF = "/root/testdata/sf0.001"
PATH = public_path(token_counts.TOKENIZER)
LOADED = Tokenizer.from_file(PATH)
LOADED.encode_special_tokens = True


def whole(text):
    return len(LOADED.encode(text, add_special_tokens=False).ids)


def applied(text, edits):
    for start, deleted, inserted in edits:
        start = max(0, min(start or 0, len(text)))
        text = text[:start] + (inserted or "") + text[start + max(0, deleted or 0) :]
    return text


def test_random_edits_count_like_the_whole_text():
    rng = random.Random(1)
    marks = ["a", " ", "\n", "é", "!", "'s", "\x1c", "  ", "the", " of", "漢", "\u00a0", "\t", "3", "<|endoftext|>"]
    count = stretch_counts(PATH)
    for n in [0, 1, 5, 50, 500, 3000] * 12:
        text = "".join(rng.choice(marks) for _ in range(n))
        tree = token_counts.CountTree(text, count)
        assert tree.total == whole(text)
        for _ in range(8):
            edit = (rng.randint(0, len(text) + 2), rng.choice([0, 1, 3, 50, 5000]), "".join(rng.choice(marks) for _ in range(rng.choice([0, 1, 4, 900]))))
            tree.edit(*edit)
            text = applied(text, [edit])
            assert (tree.text(), tree.length, tree.total) == (text, len(text), whole(text))
            assert tree.tokens[1] == tree.tokens[tree.width :].sum()


def test_a_small_edit_touches_a_small_region():
    text = plain.sentence(random.Random(1), 20_000)
    tree = token_counts.CountTree(text, stretch_counts(PATH))
    tree.edit(len(text) // 2, 3, "new")
    assert tree.encoded < 100


def test_awkward_documents(spark):
    edits = [(0, 0, "new "), (5, 3, None), (-4, None, "x"), (10**6, 10, " end"), None, (2, -1, "\n")]
    kind = token_counts.EDITS
    rows = [(*r, edits if k % 3 else None) for k, r in enumerate(plain.awkward())]
    docs = spark.createDataFrame(rows, f"{plain.SCHEMA}, edits {kind}")
    trees = stored(token_counts.build_trees(docs, keep=["edits"]), "trees")
    got = token_counts.counted(token_counts.apply_edits(trees, F.col("edits"))).collect()
    made = [[e for e in r[-1] or [] if e is not None] for r in rows]
    want = [(r[0], whole(r[1] or ""), len(e), whole(applied(r[1] or "", e))) for r, e in zip(rows, made)]
    assert sorted([(g.doc_id, g.n_tokens, g.n_edits, g.n_tokens_edited) for g in got], key=str) == sorted(want, key=str)
    assert all(sum(g.leaf_tokens) == g.n_tokens_edited for g in got)


def test_registered_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = token_counts.op7_token_counts(spark, SF).collect()
    assert len(got) == len(docs)
    for g in got:
        r = docs[g.doc_id]
        n = len(r.text)
        edits = [(0, 0, f"{r.lang}: "), (n // 3, 20, ""), (n // 2, 3, f" {r.source}")]
        assert (g.n_tokens, g.n_tokens_edited) == (whole(r.text), whole(applied(r.text, edits)))


def test_stored_trees_are_edited_again_and_again(spark):
    """Three tables, each from the one before; of the later two only touched regions are encoded."""
    rng = random.Random(5)
    text = {i: plain.sentence(rng, n) for i, n in enumerate([0, 1, 40, 400, 4000, 4000])}
    trees = token_counts.build_trees(spark.createDataFrame(list(text.items()), "doc_id long, text string"))
    for turn in range(3):
        trees = stored(trees, "trees")
        edits = {i: (rng.randint(0, len(t)), rng.choice([0, 7]), rng.choice(["", " new words", "\n"])) for i, t in text.items()}
        made = spark.createDataFrame([(i, [e]) for i, e in edits.items()], f"doc_id long, edits {token_counts.EDITS}")
        trees = token_counts.apply_edits(trees.join(made, "doc_id"), F.col("edits"))
        for i, e in edits.items():
            text[i] = applied(text[i], [e])
        for r in trees.collect():
            assert (r.text, r.n_tokens, r.n_chars) == (text[r.doc_id], whole(text[r.doc_id]), len(text[r.doc_id]))
            assert (sum(r.part_tokens), sum(r.part_chars)) == (sum(r.leaf_tokens), r.n_chars) == (r.n_tokens, r.n_chars)
            assert len(r.leaf_parts) == len(r.leaf_tokens) and sum(r.leaf_parts) == len(r.part_chars) == len(r.part_tokens)
            assert r.n_chars_encoded_again < 100
        trees = trees.drop("n_tokens_before", "n_edits", "n_chars_encoded_again")


def test_a_stored_tree_is_not_encoded():
    """Only the region around an edit meets the tokenizer."""
    text = plain.sentence(random.Random(2), 5_000)
    count, asked = stretch_counts(PATH), []

    class Watched:
        def __getitem__(self, part):
            asked.append(part)
            return count[part]

    row = token_counts.CountTree(text, count).row()
    again = token_counts.CountTree.stored(*row[:5], Watched())
    again.edit(len(text) // 2, 5, "other words")
    assert again.row()[0] == applied(text, [(len(text) // 2, 5, "other words")]) and len(asked) < 12
    assert sum(parts is not None for parts in again.leaves.made) <= 2


def test_random_edits_of_stored_trees():
    rng = random.Random(4)
    marks = ["a", " ", "\n", "é", "!", "'s", "the", " of", "漢", "3", "<|endoftext|>", " word"]
    count = stretch_counts(PATH)
    for n in [0, 1, 40, 600, 3000] * 8:
        text = "".join(rng.choice(marks) for _ in range(n))
        tree = token_counts.CountTree(text, count)
        assert [np.array(a).tolist() for a in tree.row()] == [np.array(a).tolist() for a in token_counts._laid_out(text, count)]
        for _ in range(6):
            tree = token_counts.CountTree.stored(*tree.row()[:5], count)
            for _ in range(rng.choice([1, 2, 4])):
                edit = (rng.randint(0, len(text) + 2), rng.choice([0, 1, 30, 4000]), "".join(rng.choice(marks) for _ in range(rng.choice([0, 2, 900]))))
                tree.edit(*edit)
                text = applied(text, [edit])
            assert (tree.row()[0], tree.length, tree.total) == (text, len(text), whole(text))


def test_extra_columns_and_text_ids(spark):
    rows = [("a", "one two", "x", 1, 2, 3), ("a", "one two", "x", 1, 2, 3), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "id string, body string, text string, n_tokens int, part_chars int, _edits int")
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("deleted"), F.lit("so ").alias("inserted")))
    got = token_counts.apply_edits(stored(token_counts.build_trees(docs, "id", "body"), "trees"), edits).collect()
    assert sorted(((r.doc_id, r.text, r.n_tokens) for r in got), key=str) == sorted(
        [("a", "so one two", whole("so one two"))] * 2 + [(None, "so ", whole("so "))], key=str)


def test_empty_table(spark):
    trees = token_counts.build_trees(plain.frame(spark, []), keep=["lang", "source"])
    assert token_counts.apply_edits(trees, token_counts.revision_edits()).count() == 0

"""Token counts that follow edits: a segment tree per document, and only the touched region encoded again.

The leaves of a tree are runs of pre-token stretches (parts of the text between safe cuts, see ``tokens``); each inner node
holds the characters and tokens below it. An edit goes down the tree to the stretches it touches, takes one more stretch on
either side as context, encodes that region again, and updates the sums on the way up. The cuts around the region lie
between unchanged characters, so they stay safe and the count is that of the whole edited text.

Trees are rows of a table that can be stored and edited later: ``build_trees`` encodes whole texts, once; ``apply_edits`` takes
such a table and edits, and returns the table after them, with what was encoded for it. Of a stored tree only the sums
of its leaves are added up again; the stretches of a leaf are cut out of the text when an edit comes to it.

An edit is (start, deleted, inserted): characters, in the text as the earlier edits left it; ends beyond the text
are moved to its end, negative numbers count as 0. Null edits, and null insertions, change nothing or insert nothing. Null text
counts as empty. Repeated rows are counted each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.session import documents, stored
from fleetlens.llm.tokens import public_path, stretch_counts, stretches

TOKENIZER = "byte_bpe_50k.json"
LEAF = 32  # stretches in a leaf when a tree is built
EDITS = "array<struct<start:long,deleted:long,inserted:string>>"
TREE = "text string, part_chars array<int>, part_tokens array<int>, leaf_parts array<int>, leaf_tokens array<long>, n_tokens long, n_chars long"


class Leaves:
    """The stretches of each leaf and their tokens; those of a stored tree are cut out of its text when they are first read."""

    def __init__(self, made: list[list[str]], counts: list[list[int]], cut=None):
        self.made, self.counts, self.cut = made, counts, cut

    def __len__(self) -> int:
        return len(self.made)

    def __getitem__(self, i: int) -> list[str]:
        if self.made[i] is None:
            self.made[i], self.counts[i] = self.cut(i)
        return self.made[i]

    def tokens(self, i: int) -> list[int]:
        self[i]
        return self.counts[i]

    def put(self, i: int, parts: list[str], tokens: list[int]) -> None:
        self.made[i], self.counts[i] = parts, tokens


class CountTree:
    """Characters and tokens of one text, by runs of stretches."""

    def __init__(self, text: str, count):
        self.count = count
        self.encoded = 0
        parts = stretches(text)
        self._build(parts, list(map(count.__getitem__, parts)))

    @classmethod
    def stored(cls, text: str, part_chars: np.ndarray, part_tokens: np.ndarray, leaf_parts: np.ndarray, leaf_tokens: np.ndarray, count) -> CountTree:
        """The tree of a stored row; nothing is encoded, and no stretch is cut out yet."""
        tree = cls.__new__(cls)
        tree.count, tree.encoded = count, 0
        ends, first = np.r_[0, np.cumsum(part_chars, dtype=np.int64)], np.r_[0, np.cumsum(leaf_parts, dtype=np.int64)]

        def cut(i: int) -> tuple[list[str], list[int]]:
            at = ends[first[i] : first[i + 1] + 1].tolist()
            return [text[a:b] for a, b in zip(at, at[1:])], part_tokens[first[i] : first[i + 1]].tolist()

        n = len(leaf_parts)
        tree.leaves = Leaves([None] * n, [None] * n, cut)
        tree._add_up(leaf_tokens, np.diff(ends[first]))
        tree.kept = (text, part_chars, part_tokens, ends, first)
        return tree

    def _build(self, parts: list[str], tokens: list[int]) -> None:
        cuts = range(0, len(parts), LEAF)
        self.leaves = Leaves([parts[i : i + LEAF] for i in cuts] or [[]], [tokens[i : i + LEAF] for i in cuts] or [[]])
        self.kept = None
        self._add_up([sum(leaf) for leaf in self.leaves.counts], [sum(map(len, leaf)) for leaf in self.leaves.made])

    def _add_up(self, leaf_tokens, leaf_chars) -> None:
        n = len(self.leaves)
        self.width = 1 << (n - 1).bit_length()
        self.tokens = np.zeros(2 * self.width, np.int64)
        self.chars = np.zeros(2 * self.width, np.int64)
        self.tokens[self.width : self.width + n] = leaf_tokens
        self.chars[self.width : self.width + n] = leaf_chars
        for level in range(self.width.bit_length() - 2, -1, -1):
            lo, hi = 1 << level, 2 << level
            for sums in (self.tokens, self.chars):
                sums[lo:hi] = sums[2 * lo : 2 * hi : 2] + sums[2 * lo + 1 : 2 * hi : 2]

    def row(self) -> tuple:
        """What ``TREE`` lists. Leaves that no edit came to are passed on as they were stored."""
        text, chars, tokens, sizes = [], [], [], []
        untouched = -1  # the first of a run of leaves that are passed on

        def passed_on(to: int) -> None:
            whole, part_chars, part_tokens, ends, first = self.kept
            a, b = int(first[untouched]), int(first[to])
            text.append(whole[ends[a] : ends[b]])
            chars.append(part_chars[a:b])
            tokens.append(part_tokens[a:b])
            sizes.append(np.diff(first[untouched : to + 1]))

        for i, parts in enumerate(self.leaves.made):
            if parts is None:
                untouched = i if untouched < 0 else untouched
                continue
            if untouched >= 0:
                passed_on(i)
                untouched = -1
            text += parts
            chars.append(list(map(len, parts)))
            tokens.append(self.leaves.counts[i])
            sizes.append([len(parts)])
        if untouched >= 0:
            passed_on(len(self.leaves))
        joined = [np.concatenate([np.asarray(x, np.int32) for x in some]) for some in (chars, tokens, sizes)]
        return "".join(text), *joined, self.tokens[self.width : self.width + len(self.leaves)], self.total, self.length

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def length(self) -> int:
        return int(self.chars[1])

    def text(self) -> str:
        return "".join(part for i in range(len(self.leaves)) for part in self.leaves[i])

    def _find(self, at: int) -> tuple[int, int, int]:
        """Leaf, stretch in it, and the stretch's first character, of the character ``at`` (the last one if beyond)."""
        at = max(0, min(at, self.length - 1))
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if at - before >= self.chars[node]:
                before += int(self.chars[node])
                node += 1
        leaf = min(node - self.width, len(self.leaves) - 1)
        for i, part in enumerate(self.leaves[leaf]):
            if at - before < len(part):
                return leaf, i, before
            before += len(part)
        return leaf, max(0, len(self.leaves[leaf]) - 1), before

    def _step(self, leaf: int, i: int, by: int) -> tuple[int, int]:
        """The stretch before (-1) or after (+1), or the same at the end of the text."""
        at, j = leaf, i + by
        while not 0 <= j < len(self.leaves[at]):
            at += by
            if not 0 <= at < len(self.leaves):
                return leaf, i
            j = 0 if by > 0 else len(self.leaves[at]) - 1
        return at, j

    def _update(self, leaf: int, tokens: int) -> None:
        node = self.width + leaf
        change = tokens - int(self.tokens[node]), sum(map(len, self.leaves[leaf])) - int(self.chars[node])
        while node:
            self.tokens[node] += change[0]
            self.chars[node] += change[1]
            node //= 2

    def edit(self, start: int, deleted: int, inserted: str) -> None:
        start = max(0, min(start, self.length))
        deleted = max(0, min(deleted, self.length - start))
        if not deleted and not inserted:
            return
        if not self.length:
            self.encoded += len(inserted)
            parts = stretches(inserted)
            return self._build(parts, list(map(self.count.__getitem__, parts)))
        leaves = self.leaves
        a, i, first = self._find(start)
        b, j, _ = self._find(start + max(0, deleted - 1))
        before, after = (a, i), (b, j)
        a, i = self._step(*before, -1)
        if (a, i) != before:
            first -= len(leaves[a][i])
        b, j = self._step(*after, 1)
        if a == b:
            region = leaves[a][i : j + 1]
        else:
            region = [*leaves[a][i:], *(p for leaf in range(a + 1, b) for p in leaves[leaf]), *leaves[b][: j + 1]]
        text = "".join(region)
        cut = start - first
        text = text[:cut] + inserted + text[cut + deleted :]
        fresh = stretches(text)
        counts = list(map(self.count.__getitem__, fresh))
        self.encoded += len(text)
        left, right = (leaves[a][:i], leaves.tokens(a)[:i]), (leaves[b][j + 1 :], leaves.tokens(b)[j + 1 :])
        if len(fresh) > 8 * LEAF + len(region):  # the leaf would grow too long: cut into new leaves, nothing else encoded
            ahead, behind = range(a), range(b + 1, len(leaves))
            return self._build(
                [*(p for k in ahead for p in leaves[k]), *left[0], *fresh, *right[0], *(p for k in behind for p in leaves[k])],
                [*(n for k in ahead for n in leaves.tokens(k)), *left[1], *counts, *right[1], *(n for k in behind for n in leaves.tokens(k))],
            )
        if a == b:
            leaves.put(a, left[0] + fresh + right[0], left[1] + counts + right[1])
        else:
            leaves.put(a, left[0] + fresh, left[1] + counts)
            for leaf in range(a + 1, b):
                leaves.put(leaf, [], [])
            leaves.put(b, *right)
        for leaf in range(a, b + 1):
            self._update(leaf, sum(leaves.tokens(leaf)))


def _laid_out(text: str, count) -> tuple:
    """The row of a text's tree, without the tree."""
    parts = stretches(text)
    n = len(parts)
    tokens = np.fromiter(map(count.__getitem__, parts), np.int32, n)
    if not n:
        return text, tokens, tokens, np.zeros(1, np.int32), np.zeros(1, np.int64), 0, 0
    first = np.arange(0, n, LEAF)
    leaf_tokens = np.add.reduceat(tokens, first, dtype=np.int64)
    return text, np.fromiter(map(len, parts), np.int32, n), tokens, np.diff(np.r_[first, n]), leaf_tokens, int(leaf_tokens.sum()), len(text)


_TREE_KINDS = [pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.int64()), pa.int64(), pa.int64()]
_TREE_NAMES = [field.split()[0] for field in TREE.split(", ")]


def build_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """A row per row of ``docs``: doc_id, the columns ``keep``, and the tree of its text (``TREE``), as a table to store. Encodes whole texts."""
    path = tokenizer_path or public_path(TOKENIZER)
    keep = keep or []
    read = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("_text"))
    others = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = stretch_counts(path)
        for batch in batches:
            rows = [_laid_out(text or "", count) for text in batch.column("_text").to_pylist()]
            yield _rows_of(batch, others, rows, _TREE_KINDS, _TREE_NAMES)

    kinds = ", ".join(f"`{c}` {read.schema[c].dataType.simpleString()}" for c in others)
    return read.mapInArrow(run, f"{kinds}, {TREE}")


def apply_edits(trees: DataFrame, edits: Column, tokenizer_path: str | None = None) -> DataFrame:
    """The table of trees after each row's edits, with n_tokens_before, n_edits and n_chars_encoded_again.

    ``edits`` is an array of (start, deleted, inserted) over the columns of ``trees``, in the order in which they were made.
    Only the touched stretches and their neighbours are encoded. The columns of ``TREE`` and doc_id come back, so that
    the result can be stored and edited again.
    """
    path = tokenizer_path or public_path(TOKENIZER)
    read = trees.select("doc_id", *_TREE_NAMES, edits.cast(EDITS).alias("_edits"))
    kind = read.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = stretch_counts(path)
        for batch in batches:
            parts = [_lists(batch.column(c)) for c in _TREE_NAMES[1:5]]
            rows = []
            for k, (text, changes) in enumerate(zip(batch.column("text").to_pylist(), batch.column("_edits").to_pylist())):
                tree = CountTree.stored(text, *(some[k] for some in parts), count)
                before, made = tree.total, [c for c in changes or [] if c is not None]
                for c in made:
                    tree.edit(c["start"] or 0, c["deleted"] or 0, c["inserted"] or "")
                rows.append((*tree.row(), before, len(made), tree.encoded))
            yield _rows_of(batch, ["doc_id"], rows, [*_TREE_KINDS, *[pa.int64()] * 3], [*_TREE_NAMES, *_EDITED])

    return read.mapInArrow(run, f"doc_id {kind}, {TREE}, " + ", ".join(f"{c} long" for c in _EDITED))


_EDITED = ["n_tokens_before", "n_edits", "n_chars_encoded_again"]


def _lists(column: pa.Array) -> list[np.ndarray]:
    ends = column.offsets.to_numpy()
    return np.split(column.values.to_numpy(), ends)[1:-1]


def _list_array(lists: tuple[np.ndarray, ...], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    values = np.concatenate(lists) if len(lists) else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(kind.value_type.to_pandas_dtype(), copy=False)), type=kind)


def _rows_of(batch: pa.RecordBatch, others: list[str], rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    arrays = [_list_array(c, kind) if pa.types.is_list(kind) else pa.array(c, kind) for c, kind in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *arrays], [*others, *names])


def counted(edited: DataFrame) -> DataFrame:
    """The counts of ``apply_edits``: doc_id, n_tokens (before), n_edits, n_tokens_edited, n_chars_edited, n_chars_encoded_again, leaf_tokens."""
    return edited.select(
        "doc_id", F.col("n_tokens_before").alias("n_tokens"), "n_edits", F.col("n_tokens").alias("n_tokens_edited"),
        F.col("n_chars").alias("n_chars_edited"), "n_chars_encoded_again", "leaf_tokens",
    )


def revision_edits() -> Column:
    """The edits of the registered query, from each row's own columns: language tag in front, a deletion, an insertion."""
    n = F.col("n_chars")
    zero = F.lit(0).cast("long")
    return F.array(
        F.struct(zero.alias("start"), zero.alias("deleted"), F.concat(F.col("lang"), F.lit(": ")).alias("inserted")),
        F.struct((n / 3).cast("long").alias("start"), F.lit(20).cast("long").alias("deleted"), F.lit("").alias("inserted")),
        F.struct((n / 2).cast("long").alias("start"), F.lit(3).cast("long").alias("deleted"), F.concat(F.lit(" "), F.col("source")).alias("inserted")),
    )


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    trees = stored(build_trees(documents(spark, sf_dir), keep=["lang", "source"]), "count-trees", compression="zstd")
    return counted(apply_edits(trees, revision_edits())).drop("leaf_tokens")


QUERIES = {"op7_token_counts": (op7_token_counts, None)}

"""Alignment of two tokenizers over the same bytes, and how often their ids stand for each other in the corpus.

A is a byte-level BPE over blank + text; B a sentence-piece BPE over text, which puts that blank in front itself. The
cumulative byte ends of both token lists become dictionaries from end to index (arrays with a place for each byte); their common keys, in
order, cut both lists into groups; within a group every token of A is linked with every token of B.

Long texts are cut every ``LONG`` characters or later, at a blank between two visible characters. Both tokenizers always end a token there: a
pre-token of A ends, and B has no piece that goes on (checked when the vocabulary is read; if it has one, texts stay whole). So parts
are aligned alone, no list grows with a text, and groups never cross a cut.

Between all such blanks lie stretches, mostly a word each. The parts of a batch are taken apart into stretches, the distinct ones stand one after
the other in a text of their own, and that text is encoded and aligned; a part is put together from its stretches. A stretch that does not
start with a blank and a visible character and end with a visible one is encoded alone, and so is a long one. Where token bytes
differ, the text is halved until the stretches at fault are alone.

1. One pass writes per document its counts, the digest of its groups, and its distinct id pairs with the number of their links.
2. Pairs are counted over all documents (partial sums before the shuffle), and the highest count of each id of A is found.
3. Counts go back to the documents. Pairs that make up at least one in ``FREQUENT`` of all entries, so ``FREQUENT`` pairs at most,
   are looked up in every task; the rest is joined by pair, where no pair can be hot any more. Both ways add up to the same sums.

Null and empty texts have no tokens, nor has a text whose joined token bytes differ from blank + text (a B that changes its input, a
literal U+2581): all its numbers are 0 and its digest is empty. Special tokens written in a text are ordinary text. Repeated rows are
documents of their own. A null id stays null. An empty table gives an empty result. A group without common ends inside costs its
distinct ids of A times those of B, whatever its length.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.session import documents, stored
from fleetlens.llm.tokens import public_path, tokenizer
from fleetlens.llm.words import pieces

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
FREQUENT = 200_000
SPACE = "▁"  # how sentence pieces write a blank
LONG, LISTED = 200_000, 4_096
TOGETHER = 4_000_000  # bytes of parts taken apart at once
WORD = 1_000  # bytes of a stretch that is encoded with others, at most
_CUT = re.compile("(?<=[!-~À-ÿ])(?= [!-~À-ÿ])")
# Beyond these characters the two libraries for A may class letters and white space by other versions of Unicode.
_OTHER = re.compile("[^\\t\\n\\r -~\\xa1-\\u024f]")
_RUN = re.compile(r"\S{2000}")  # one piece for A, for which only one of the libraries is fast
_SEEN = np.array([0x21 <= i <= 0x7E for i in range(256)])
_ODD = np.array([i < 0x20 and i not in (9, 10, 13) or i in (0x7F, 0xC2) or i > 0xC8 for i in range(256)])  # bytes that ``_OTHER`` may be part of
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


def _letters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as its own Latin-1 letter if that is visible, the others as letters from U+0100 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _seen_last(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is visible."""
    return _SEEN[x[at - 1]] | (x[at - 1] >> 6 == 2) & (x[at - 2] == 0xC3)


def _seen_first(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character after the blank at each place is visible."""
    return _SEEN[x[at + 1]] | (x[at + 1] == 0xC3)


def _bytes_of(stretches: pa.Array) -> tuple[np.ndarray, bytes]:
    """Where each ends and the next starts in the bytes of all, and these."""
    _, places, data = stretches.buffers()
    ends = np.frombuffer(places, np.int64)[stretches.offset : stretches.offset + len(stretches) + 1]
    return ends - ends[0], data[ends[0] : ends[-1]].to_pybytes()


@dataclass
class Aligned:
    """Per stretch: n_a, n_b, n_groups and n_links, whether its bytes agree, how many pairs it has, these and their links, and its groups as text."""

    counts: np.ndarray
    good: np.ndarray
    n_pairs: np.ndarray
    pairs: np.ndarray
    times: np.ndarray
    texts: pa.Array

    @classmethod
    def joined(cls, found: list[Aligned]) -> Aligned:
        *arrays, texts = zip(*(vars(f).values() for f in found))
        return cls(*map(np.concatenate, arrays), pa.concat_arrays(texts))

    @classmethod
    def none(cls) -> Aligned:
        empty = np.zeros(0, np.int64)
        return cls(np.zeros((1, 4), np.int64), np.zeros(1, bool), np.zeros(1, np.int64), empty, empty, pa.array([b""], pa.large_binary()))


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = tokenizer(a_path, True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _letters()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for word, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters.get(c, 0) for c in word)
        every = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(_BYTE_PIECE.fullmatch(p)[1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(every)
        ]
        self.a_size, self.b_size = (np.array(list(map(len, ids))) for ids in (self.a_bytes, self.b_bytes))
        self.a_bits, self.b_bits = len(self.a_bytes).bit_length(), len(self.b_bytes).bit_length()
        self.marked = [b"%d%c" % (i, mark) for ids, marks in ((self.a_bytes, b",|"), (self.b_bytes, b",;")) for mark in marks for i in range(len(ids))]
        self.marked_size = np.array(list(map(len, self.marked)))
        self.parts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in every)
        self.quick = self._ranked(a_path, vocabulary)

    def _ranked(self, path: str, vocabulary: dict[str, int]):
        """The same tokenizer by ranks, if its merges come in the order of the ids that they make; else None."""
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        made = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in merges]
        ranks = {self.a_bytes[i]: i for i in vocabulary.values()}
        if sorted(made) != made or made[:1] == [-1] or len(set(made)) < len(made) or len(ranks) != len(made) + 256:
            return None
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def a_ids(self, text: str) -> list[int]:
        if self.quick and not (_OTHER.search(text) or _RUN.search(text)):
            return self.quick(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def align(self, part: str):
        """A part that starts with a blank: n_a, n_b, n_groups, n_links, its groups as text, its pairs and the links of each; None if its bytes differ."""
        return self.align_all([part])[0]

    def align_all(self, parts: list[str]) -> list:
        """``align`` of each part, with each distinct stretch encoded once."""
        data = [p.encode("utf-8", "replace") for p in parts]
        starts = np.cumsum([0, *map(len, data)])
        bounds, stretches, at = self.stretches(b"".join(data), starts)
        found, order = self.aligned(stretches)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = place[at]
        first = np.searchsorted(bounds, starts)
        counts = np.add.reduceat(found.counts[at], first[:-1])
        good = np.logical_and.reduceat(found.good[at], first[:-1])
        ends, said = _bytes_of(found.texts.take(pa.array(at)))
        ends = ends[first]

        held, often = np.unique(np.repeat(np.arange(len(parts)), np.diff(first)) << 32 | at, return_counts=True)
        part, at = held >> 32, held & 0xFFFFFFFF
        n = found.n_pairs[at]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - (np.cumsum(found.n_pairs) - found.n_pairs)[at], n)
        bits = self.a_bits + self.b_bits
        codes, times = added(np.repeat(part << bits, n) | found.pairs[at], found.times[at] * np.repeat(often, n))
        edges = np.searchsorted(codes >> bits, np.arange(len(parts) + 1))
        pairs = (codes >> self.b_bits & (1 << self.a_bits) - 1) << 32 | codes & (1 << self.b_bits) - 1
        return [
            (*counts[i].tolist(), said[ends[i] : ends[i + 1] - 1].decode(), pairs[edges[i] : edges[i + 1]], times[edges[i] : edges[i + 1]]) if good[i] else None
            for i in range(len(parts))
        ]

    def stretches(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Where stretches start in parts that lie in ``data`` one after the other, the distinct stretches, and which of them each is."""
        x = np.frombuffer(data, np.uint8)
        first = np.zeros(len(x) + 1, bool)
        first[starts] = True
        if self.parts:
            at = np.flatnonzero(x == 0x20)
            at = at[(at > 1) & (at < len(x) - 1)]
            first[at[_seen_last(x, at) & _seen_first(x, at)]] = True
        bounds = np.flatnonzero(first)
        coded = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        return bounds, coded.dictionary, coded.indices.to_numpy()

    def aligned(self, stretches: pa.Array) -> tuple[Aligned, np.ndarray]:
        """The stretches aligned, and in which order they come."""
        ends, data = _bytes_of(stretches)
        x = np.frombuffer(data, np.uint8)
        sizes = np.diff(ends)
        inner = _seen_last(x, ends[1:]) & _seen_first(x, np.minimum(ends[:-1], len(x) - 2)) & (sizes <= WORD) & self.parts
        odd = np.logical_or.reduceat(_ODD[x], ends[:-1])
        order = [np.flatnonzero(inner & ~odd), np.flatnonzero(inner & odd), np.flatnonzero(~inner)]
        out: list[Aligned] = []
        for which in order[:2]:
            taken = stretches.take(pa.array(which))
            edges = np.r_[np.flatnonzero(np.diff(np.cumsum(sizes[which]) // LONG, prepend=-1)), len(which)].tolist()
            for lo, hi in zip(edges, edges[1:]):
                self.together(taken.slice(lo, hi - lo), out)
        for i in order[2].tolist():
            self.together(stretches.slice(i, 1), out)
        return Aligned.joined(out), np.concatenate(order)

    def together(self, stretches: pa.Array, out: list[Aligned]) -> None:
        """Adds the stretches aligned as one text, or as halves of it if their bytes differ."""
        found = self.as_one(stretches)
        if found or len(stretches) == 1:
            out.append(found or Aligned.none())
            return
        half = len(stretches) // 2
        self.together(stretches[:half], out)
        self.together(stretches[half:], out)

    def as_one(self, stretches: pa.Array) -> Aligned | None:
        """Stretches encoded as one text; None if its bytes differ or a stretch does not end with a group."""
        ends, data = _bytes_of(stretches)
        text = data.decode()
        a, b = self.a_ids(text), self.b.encode(text[1:])
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        a, b = numbers(a), numbers(b)
        a_cuts, b_cuts = common_ends(self.a_size[a], self.b_size[b])
        cuts = np.cumsum(self.a_size[a])[a_cuts - 1]
        last = np.searchsorted(cuts, ends[1:])  # the group that a stretch ends with
        if not np.array_equal(cuts[last], ends[1:]):
            return None
        n_a, n_b = np.diff(a_cuts, prepend=0), np.diff(b_cuts, prepend=0)
        counts = np.diff(np.stack([a_cuts, b_cuts, np.arange(1, len(cuts) + 1), np.cumsum(n_a * n_b)], 1)[last], axis=0, prepend=0)
        n = len(stretches)
        codes, times = links_of(np.repeat(np.arange(n), counts[:, 0]) << self.a_bits | a, b, a_cuts, b_cuts, self.b_bits)
        bits = self.a_bits + self.b_bits
        marks = self.marks(a, b, a_cuts, b_cuts)
        places = np.r_[0, np.cumsum(self.marked_size[marks])[(a_cuts + b_cuts)[last] - 1]]
        texts = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(places), pa.py_buffer(b"".join(map(self.marked.__getitem__, marks.tolist())))])
        return Aligned(counts, np.ones(n, bool), np.bincount(codes >> bits, minlength=n), codes & (1 << bits) - 1, times, texts)

    def marks(self, a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> np.ndarray:
        """The groups as ``a1,a2|b1;a3|b2,b3;``: each id with the mark that follows it, those of A before those of B in each group."""
        n_a, n_b = np.diff(a_cuts, prepend=0), np.diff(b_cuts, prepend=0)
        a, b = a.copy(), b + 2 * len(self.a_bytes)
        a[a_cuts - 1] += len(self.a_bytes)
        b[b_cuts - 1] += len(self.b_bytes)
        every = np.empty(len(a) + len(b), np.int64)
        every[np.arange(len(a)) + np.repeat(b_cuts - n_b, n_a)] = a
        every[np.arange(len(b)) + np.repeat(a_cuts, n_b)] = b
        return every

    def cut(self, text: str) -> Iterator[str]:
        """Blank + ``text`` in parts that start with a blank."""
        text, lo = " " + text, 0
        while self.parts and len(text) - lo > LONG:
            found = _CUT.search(text, lo + LONG)
            if not found:
                break
            yield text[lo : found.start()]
            lo = found.start()
        yield text[lo:]


def numbers(ids: list[int]) -> np.ndarray:
    return np.frombuffer(array("q", ids), np.int64)


def common_ends(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and of B lie before each byte offset at which tokens of both end: for both, a table from end to index."""
    ends = [np.cumsum(sizes) for sizes in (a_sizes, b_sizes)]
    a_at, b_at = (np.zeros(max((int(e[-1]) for e in ends if len(e)), default=0) + 1, np.int32) for _ in ends)
    for at, e in zip((a_at, b_at), ends):
        at[e] = np.arange(1, len(e) + 1)
    common = np.flatnonzero((a_at > 0) & (b_at > 0))
    return a_at[common].astype(np.int64), b_at[common].astype(np.int64)


def cuts_of(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[list[int], list[int]]:
    a_cuts, b_cuts = common_ends(a_sizes, b_sizes)
    return a_cuts.tolist(), b_cuts.tolist()


def links_of(a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray, bits: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, ascending, and their links: every token of A in a group with every token of B in it, whose ids have ``bits`` bits."""
    n_a, n_b = np.diff(a_cuts, prepend=0), np.diff(b_cuts, prepend=0)
    listed = n_a * n_b <= LISTED
    n = np.repeat(np.where(listed, n_b, 0), n_a)  # links of each token of A
    first = np.repeat(b_cuts - n_b, n_a)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - first, n)
    codes, times = np.unique(np.repeat(a, n) << bits | b[at], return_counts=True)
    for g in np.flatnonzero(~listed):  # a long group: by its distinct ids
        x, m = np.unique(a[a_cuts[g] - n_a[g] : a_cuts[g]], return_counts=True)
        y, k = np.unique(b[b_cuts[g] - n_b[g] : b_cuts[g]], return_counts=True)
        codes, times = added(np.r_[codes, (x[:, None] << bits | y).ravel()], np.r_[times, (m[:, None] * k).ravel()])
    return codes, times


def added(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, inverse = np.unique(codes, return_inverse=True)
    total = np.zeros(len(code), np.int64)
    np.add.at(total, inverse, times)
    return code, total


def lots(parts: Iterator[tuple[int, str]], most: int) -> Iterator[list[tuple[int, str]]]:
    """Parts of texts in lots that end where they reach ``most`` characters."""
    lot, size = [], 0
    for part in parts:
        lot.append(part)
        size += len(part[1])
        if size >= most:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def align(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, groups: bool = False,
    together: int = TOGETHER,
) -> DataFrame:
    """One row per row of ``docs``: _row (its number), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (id of A times 2**32 plus id of B,
    ascending) and times (links of each pair); with ``groups``, the alignment itself as ``a1,a2|b1;a3|b2,b3``. About ``together`` bytes are taken apart at once."""
    a_path, b_path = a_path or public_path(A_FILE), b_path or public_path(B_FILE)
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    kind = read.schema["doc_id"].dataType.simpleString()
    counts = ["n_a", "n_b", "n_groups", "n_links"]

    def lists(parts: tuple[np.ndarray, ...]) -> pa.Array:
        places = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(a_path, b_path)
        none = np.zeros(0, np.int64)
        for batch in batches:
            for part in pieces(batch, "_text", together):
                texts = part.column("_text").to_pylist()
                numbers = np.zeros((part.num_rows, 4), np.int64)
                digests, said, held = [hashlib.sha256() for _ in texts], [[] for _ in texts], [[] for _ in texts]
                failed = {i for i, text in enumerate(texts) if not text}
                for lot in lots(((i, p) for i, text in enumerate(texts) if text for p in known.cut(text)), together):
                    for (i, _), found in zip(lot, known.align_all([p for _, p in lot])):
                        if found is None:
                            failed.add(i)
                        if i in failed:
                            continue
                        numbers[i] += found[:4]
                        digests[i].update((";" if held[i] else "").encode() + found[4].encode())
                        held[i].append(found[5:])
                        if groups:
                            said[i].append(found[4])
                for i in failed:
                    numbers[i], said[i], held[i] = 0, [], [(none, none)]
                digests = ["" if i in failed else d.hexdigest() for i, d in enumerate(digests)]
                texts = [";".join(s) for s in said]
                pairs, times = zip(*(h[0] if len(h) == 1 else added(*(np.concatenate(c) for c in zip(*h))) for h in held))
                columns = [part.column("_row"), part.column("doc_id"), *(pa.array(numbers[:, k]) for k in range(4)), pa.array(digests, pa.string())]
                names = ["_row", "doc_id", *counts, "groups_sha256"]
                if groups:
                    columns.append(pa.array(texts, pa.string()))
                    names.append("groups")
                yield pa.RecordBatch.from_arrays([*columns, lists(pairs), lists(times)], [*names, "pairs", "times"])

    more = "groups string, " if groups else ""
    return read.mapInArrow(
        run, f"_row long, doc_id {kind}, {', '.join(f'{c} long' for c in counts)}, groups_sha256 string, {more}pairs array<long>, times array<long>"
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n_docs (documents that hold it) and best (no pair of the same id of A is in more documents) of all pairs of the corpus."""
    counts = stored(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs")), "pair-counts")
    of_a = F.shiftright("pair", 32)
    highest = counts.groupBy(of_a.alias("_a")).agg(F.max("n_docs").alias("_most"))
    joined = counts.withColumn("_a", of_a).join(F.broadcast(highest), "_a")  # one row per id of A: its vocabulary at most
    return stored(joined.select("pair", "n_docs", (F.col("n_docs") == F.col("_most")).alias("best")), "pair-best")


def with_corpus_counts(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """The rows of ``aligned`` without their pairs, and n_best and count_sum over their links."""
    spark = aligned.sparkSession
    entries = counts.agg(F.sum("n_docs")).first()[0] or 0
    hot = F.col("n_docs") * frequent >= entries  # the counts add up to ``entries``, so these are ``frequent`` rows at most
    table = counts.where(hot).toArrow()
    order = np.argsort(table.column("pair").to_numpy(), kind="stable")
    shared = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy(zero_copy_only=False)[order] for c in ("pair", "n_docs", "best")))
    others = [c for c in aligned.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n_docs, best = shared.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            places = pairs.offsets.to_numpy()
            pair = pairs.values.to_numpy()[places[0] : places[-1]] if len(pairs) else np.zeros(0, np.int64)
            time = times.flatten().to_numpy() if len(pairs) else np.zeros(0, np.int64)
            places = places - places[0] if len(places) else np.zeros(1, np.int64)
            n = batch.num_rows
            row = np.repeat(np.arange(n), np.diff(places)) if n else np.zeros(0, np.int64)
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            sums = np.zeros((2, n), np.int64)
            np.add.at(sums[0], row[hit], time[hit] * best[at[hit]])
            np.add.at(sums[1], row[hit], time[hit] * n_docs[at[hit]])
            rest = np.r_[0, np.cumsum(np.bincount(row[~hit], minlength=n))].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in others), pa.array(sums[0]), pa.array(sums[1]),
                    pa.ListArray.from_arrays(pa.array(rest), pa.array(pair[~hit])), pa.ListArray.from_arrays(pa.array(rest), pa.array(time[~hit])),
                ],
                [*others, "n_best", "count_sum", "rest", "rest_times"],
            )

    kinds = ", ".join(f"{c} {aligned.schema[c].dataType.simpleString()}" for c in others)
    looked = stored(
        aligned.mapInArrow(run, f"{kinds}, n_best long, count_sum long, rest array<long>, rest_times array<long>"), "aligned-frequent"
    )
    rest = looked.select("_row", F.explode(F.arrays_zip(F.col("rest").alias("pair"), F.col("rest_times").alias("times"))).alias("_e"))
    rest = rest.select("_row", "_e.pair", "_e.times").join(counts.where(~hot), "pair")
    rest = rest.groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n_docs")).alias("_sum")
    )
    out = looked.drop("rest", "rest_times").join(rest, "_row", "left")
    return out.select(
        *(c for c in others if c != "_row"),
        (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"),
    )


def op13_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    aligned = stored(align(documents(spark, sf_dir)), "aligned")
    return with_corpus_counts(aligned, pair_counts(aligned))


QUERIES = {"op13_tokenizer_alignment": (op13_tokenizer_alignment, None)}

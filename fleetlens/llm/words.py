"""Words of whole texts: SQL expressions, and the same words found with numpy over the bytes of an Arrow batch.

A word is a run of ASCII letters, digits and non-ASCII characters, after lower-casing A-Z only. In UTF-8 every byte
of a non-ASCII character is at least 0x80, so the rule holds for bytes as it does for characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CHUNK_BYTES = 500_000


def lower_az(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def sql_lower_az(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_map(word: bool) -> np.ndarray:
    """Each byte to its lower-cased form; all that separate to one and the same, that of the blank."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        if word:
            inside = b >= 0x80 or chr(b).isascii() and chr(b).isalnum()
        else:
            inside = b != 0x20 and not 0x09 <= b <= 0x0D
        out[b] = (b + 32 if 0x41 <= b <= 0x5A else b) if inside else (0 if word else 0x20)
    return out


WORD_BYTES, SPACE_BYTES = _byte_map(True), _byte_map(False)
_BYTE_RANDOM = splitmix(np.arange(256)) | np.uint64(1)
_PLACE_RANDOM = splitmix(np.arange(1 << 12) + 1_000_003) | np.uint64(1)


@dataclass
class Words:
    """Words of a few texts, in order: byte places in ``data``, text number, 64-bit hash; ``first[i]`` is the first of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def string(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")

    def strings(self, lo: int, hi: int) -> list[str]:
        return [self.string(i) for i in range(lo, hi)]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the n + 1 places where its texts start; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(places, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def find_words(column: pa.Array, table: np.ndarray = WORD_BYTES, collapse: bool = False) -> Words:
    """Runs of bytes that ``table`` does not map like the blank, hashed by their mapped bytes; with ``collapse``, equal neighbours count once."""
    raw, at = text_bytes(column)
    n = len(at) - 1
    low = table[raw]
    inside = low != table[0x20]
    before = np.empty(len(low), bool)
    if len(low):
        before[0] = False
        before[1:] = inside[:-1]
        cuts = at[1:-1]
        before[cuts[cuts < len(low)]] = False
    start = np.flatnonzero(inside & ~before)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(low, none, none, none, np.zeros(0, np.uint64), np.zeros(n + 1, np.int64))
    kept = low[inside]
    # A word ends where its run of inside bytes does, or where the next word starts.
    rank = np.cumsum(inside, dtype=np.int64)[start] - 1
    length = np.diff(rank, append=len(kept))
    ends = start + length
    if collapse:
        changed = np.ones(len(kept), bool)
        changed[1:] = kept[1:] != kept[:-1]
        changed[rank] = True
        rank = np.cumsum(changed)[rank] - 1
        kept = kept[changed]
        length = np.diff(rank, append=len(kept))
    place = np.arange(len(kept), dtype=np.int64) - np.repeat(rank, length)
    weight = _PLACE_RANDOM[place & (len(_PLACE_RANDOM) - 1)]
    if length.max() > len(_PLACE_RANDOM):  # only the far places of long words get another weight
        far = np.flatnonzero(place >= len(_PLACE_RANDOM))
        weight[far] *= splitmix(place[far] // len(_PLACE_RANDOM)) | np.uint64(1)
    hashed = splitmix(np.add.reduceat(_BYTE_RANDOM[kept] * weight, rank) + length.astype(np.uint64))
    text = np.searchsorted(at, start, "right") - 1
    return Words(low, start, ends, text, hashed, np.searchsorted(text, np.arange(n + 1)))


def pieces(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with few text bytes, so that the arrays over them stay small."""
    if not batch.num_rows:
        return
    _, at = text_bytes(batch.column(text))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def shingles(words: Words, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and first word of every run of k words; with ``short`` a text of fewer words, but not none, is one run."""
    n = np.diff(words.first)
    place = np.arange(len(words.hash))
    whole = place + k <= words.first[words.text + 1] if len(place) else np.zeros(0, bool)
    starts = place[whole]
    mixed = np.zeros(len(starts), np.uint64)
    for i in range(k):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + words.hash[starts + i]
    text = words.text[starts]
    few = np.flatnonzero((n > 0) & (n < k)) if short else np.zeros(0, np.int64)
    if len(few):
        extra = np.array([run_hash(words.hash[words.first[t] : words.first[t + 1]]) for t in few], np.uint64)
        mixed, text, starts = np.r_[mixed, extra], np.r_[text, few], np.r_[starts, words.first[few]]
        order = np.argsort(text, kind="stable")
        mixed, text, starts = mixed[order], text[order], starts[order]
    return splitmix(mixed), text, starts


def run_hash(hashes: np.ndarray) -> int:
    """The unfinished hash of one run of words, as ``shingles`` mixes it."""
    out = 0
    for h in hashes.tolist():
        out = (out * 0x9E3779B97F4A7C15 + h) & 0xFFFFFFFFFFFFFFFF
    return out

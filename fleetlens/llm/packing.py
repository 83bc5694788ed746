"""Packing of documents into sequences: first-fit decreasing in randomised groups, with a tournament tree of bin capacities.

A document is its token ids and an end id. It is cut every ``size`` ids; its pieces are packed. Rows are dealt at
random into groups of about ``GROUP_ROWS``; each group is packed alone, so no step sees all pieces. In a group, pieces go in
order of falling length into the leftmost sequence with room. The tournament tree holds in each node the largest room
below it; going down to the leftmost leaf with enough room takes log2(n) steps.

Null text counts as empty: a document of the end id alone. Repeated rows are packed each. A null id stays null. An empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.session import documents, stored
from fleetlens.llm.tokens import public_path, word_ids

SIZE, GROUP_ROWS, END_ID = 2048, 4096, 1
TOKENIZER = "word_bpe_49k.json"
_ITEMS = "_doc {}, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, id_col: str, text_col: str, size: int, path: str) -> DataFrame:
    """One row per document: id, doc_tokens, and its pieces as (start, length, crc32 of the ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = word_ids(path), END_ID.to_bytes(4, "little")
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
        for batch in batches:
            tokens, cuts = [], []
            for text in batch.column("_text").to_pylist():
                data = ids_of(text or "") + end
                n = len(data) // 4
                tokens.append(n)
                cuts.append([
                    {"start": i, "length": min(size, n - i), "ids_crc32": zlib.crc32(data[4 * i : 4 * (i + size)])}
                    for i in range(0, n, size)
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_doc"), pa.array(tokens, pa.int64()), pa.array(cuts, kind)], ["_doc", "doc_tokens", "cuts"]
            )

    read = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    id_kind = read.schema["_doc"].dataType.simpleString()
    return read.mapInArrow(run, f"_doc {id_kind}, doc_tokens long, cuts array<struct<start:long,length:long,ids_crc32:long>>")


def first_fit(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, given in falling order; each goes to the leftmost bin with room."""
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    room = [size] * (2 * leaves)
    placed = []
    for need in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        placed.append((node - leaves, size - room[node]))
        room[node] -= need
        node //= 2
        while node:
            left, right = room[2 * node], room[2 * node + 1]
            best = left if left > right else right
            if room[node] == best:
                break
            room[node] = best
            node //= 2
    return placed


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
    tokenizer_path: str | None = None, group_rows: int = GROUP_ROWS, seed: int = 7,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = stored(cut_documents(docs, id_col, text_col, size, tokenizer_path or public_path(TOKENIZER)), "packing-pieces")
    groups = max(1, -(-pieces.count() // group_rows))
    # The number of a row in the written table, not its id: repeated ids must not meet in one group.
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)))
    id_kind = pieces.schema["_doc"].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        flat = rows.explode("cuts", ignore_index=True)
        cut = pd.DataFrame(flat["cuts"].tolist())
        items = pd.concat([flat[["_doc", "doc_tokens"]], cut], axis=1)
        items = items.sort_values(["length", "_doc", "start"], ascending=[False, True, True], kind="stable", ignore_index=True)
        placed = first_fit(items["length"].tolist(), size)
        items["sequence_id"] = [(int(key[0]) << 32) + b for b, _ in placed]
        items["offset"] = [o for _, o in placed]
        return items[["_doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    schema = f"{_ITEMS.format(id_kind)}, sequence_id long, offset long"
    return dealt.groupBy("_group").applyInPandas(run, schema).withColumnRenamed("_doc", "doc_id")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


QUERIES = {"op6_packing": (op6_packing, None)}

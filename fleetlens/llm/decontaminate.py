"""Benchmark decontamination: a prefix-filtered set join between item windows and documents.

A window is ``WIDTH`` consecutive words of a benchmark item (an item of fewer words is one window). As a set it is its
shingles of ``SHINGLE`` words. A document that contains a window contains all its shingles, so containment of 1 needs only
a prefix of one: the shingle that is rarest in the corpus.

1. Items give windows and their shingles.
2. One pass over the documents counts those shingles, and only those; each window keeps its rarest one.
3. A second pass emits, for each place of a prefix shingle, the words around it. Joined on the shingle, the window's offset
   gives its place in the document; it must start and end inside (positional and length bound), and all its words must be equal.
4. Hit words are the union of the verified windows of a document.

Both passes select shingles by a bitmap of ``BITMAP_BITS`` bits, a fixed size however many items there are; what it lets
through by chance is dropped by the join. Windows are broadcast up to ``BROADCAST_WINDOWS`` of them, else joined by shuffle.

Null text has no words and hits nothing; so does an item without words. An item without id hits words but is not counted or
named. Rows that repeat a document or an item are judged each, items count once by id. Empty tables give no hits or no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.session import documents, stored
from fleetlens.llm.words import find_words, pieces, shingles, sql_lower_az

WIDTH, SHINGLE = 13, 3
SLOT_BITS = 26
BITMAP_BITS = 1 << SLOT_BITS
BROADCAST_WINDOWS = 100_000
_GAP = re.compile(rb"\x00+")


def item_windows(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """item_id, window (its words joined by a blank), m words, and ``keys``: the hash of each shingle, in order."""
    read = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("_text"))
    kind = read.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text", 200_000):
                words = find_words(part.column("_text"))
                ids, texts, sizes, keys = [], [], [], []
                by_size = {k: _by_start(*shingles(words, k, short=False)) for k in range(1, SHINGLE + 1)}
                for i, item in enumerate(part.column("item_id").to_pylist()):
                    lo, hi = int(words.first[i]), int(words.first[i + 1])
                    m = min(width, hi - lo)
                    k = min(SHINGLE, m)
                    every = words.strings(lo, hi)
                    for s in range(lo, hi - m + 1 if m else lo):
                        ids.append(item)
                        texts.append(" ".join(every[s - lo : s - lo + m]))
                        sizes.append(m)
                        keys.append([by_size[k][s + p] for p in range(m - k + 1)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, part.column("item_id").type), pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                    ["item_id", "window", "m", "keys"],
                )

    return read.mapInArrow(run, f"item_id {kind}, window string, m int, keys array<long>")


def _by_start(hashes: np.ndarray, _: np.ndarray, start: np.ndarray) -> dict[int, int]:
    return dict(zip(start.tolist(), hashes.view(np.int64).tolist()))


def bitmap(keys: DataFrame) -> bytes:
    """The slots of all ``key`` values as a bitmap of fixed size: at most ``BITMAP_BITS`` / 8 bytes reach the driver."""
    slot = F.shiftrightunsigned("key", 64 - SLOT_BITS)
    rows = (
        keys.select((slot / 32768).cast("long").alias("part"), (slot % 32768).alias("bit"))
        .groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    )
    out = bytearray(BITMAP_BITS // 8)
    for part, bits in rows:
        out[part * 4096 : (part + 1) * 4096] = bits
    return bytes(out)


def _passing(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - SLOT_BITS)
    return np.flatnonzero((bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)


def count_shingles(texts: DataFrame, keys: DataFrame, sizes: list[int]) -> DataFrame:
    """key, n: how often each shingle of ``keys`` occurs in ``_text`` of all documents."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for part in pieces(batch, "_text"):
                words = find_words(part.column("_text"))
                for k in sizes:
                    hashes = shingles(words, k, short=False)[0]
                    found, n = np.unique(hashes[_passing(hashes, bits)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    counted = texts.select("_text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return keys.join(counted, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))


def candidates(texts: DataFrame, keys: DataFrame, sizes: list[int], width: int) -> DataFrame:
    """One row per document: uid, doc_id, digest, n_words, and ``found``: place, key, and the words around each prefix shingle."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap(keys))
    kind = pa.list_(pa.struct([("place", pa.int64()), ("key", pa.int64()), ("lead", pa.int32()), ("around", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in pieces(batch, "_text"):
                words = find_words(part.column("_text"))
                found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for k in sizes:
                    hashes, text, start = shingles(words, k, short=False)
                    hit = _passing(hashes, bits)
                    for key, t, s in zip(hashes[hit].view(np.int64).tolist(), text[hit].tolist(), start[hit].tolist()):
                        first, last = int(words.first[t]), int(words.first[t + 1])
                        lo, hi = max(first, s - (width - k)), min(last, s + width)
                        around = _GAP.sub(b" ", words.data[words.start[lo] : words.end[hi - 1]].tobytes())
                        found[t].append({"place": s - first, "key": key, "lead": s - lo, "around": around.decode("utf-8", "replace")})
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(uid, uid + part.num_rows)), part.column("doc_id"), part.column("_digest"),
                        pa.array(np.diff(words.first).astype(np.int64)), pa.array(found, kind),
                    ],
                    ["uid", "doc_id", "digest", "n_words", "found"],
                )
                uid += part.num_rows

    id_kind = texts.schema["doc_id"].dataType.simpleString()
    shape = "array<struct<place:long,key:long,lead:int,around:string>>"
    return texts.mapInArrow(run, f"uid long, doc_id {id_kind}, digest string, n_words long, found {shape}")


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (ids as sorted strings), and digest (MD5 of the text)."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).withColumn(
        "_digest", F.md5(F.coalesce(F.col("_text"), F.lit("")))
    )
    every = stored(item_windows(items, item_id_col, item_text_col, width), "windows")
    sizes = sorted({min(SHINGLE, r.m) for r in every.select("m").distinct().collect()})  # at most ``width`` rows
    windows = every.dropDuplicates(["window"]).select("window", "m", F.posexplode("keys").alias("p", "key"))
    counts = count_shingles(texts, windows.select("key").distinct(), sizes)
    rarest = F.min(F.struct("n", "p", "key")).alias("r")
    prefix = stored(
        windows.join(counts, "key").groupBy("window", "m").agg(rarest).select("window", "m", F.col("r.p").alias("p"), F.col("r.key").alias("key")),
        "prefixes",
    )
    base = stored(candidates(texts, prefix.select("key").distinct(), sizes, width), "candidates")
    small = prefix.count() <= BROADCAST_WINDOWS
    places = base.select("uid", F.explode("found").alias("f")).select("uid", "f.*")
    near = places.join(F.broadcast(prefix) if small else prefix, "key").where("lead >= p")
    found = F.slice(F.split("around", " "), F.col("lead") - F.col("p") + 1, F.col("m"))
    hits = near.where(F.array_join(found, " ") == F.col("window")).select(
        "uid", "window", F.struct((F.col("place") - F.col("p")).alias("s"), (F.col("place") - F.col("p") + F.col("m")).alias("e")).alias("span")
    )
    named = every.select("window", "item_id").distinct()
    hits = hits.join(F.broadcast(named) if small and named.count() <= BROADCAST_WINDOWS else named, "window")
    by_doc = hits.groupBy("uid").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"),
            F.greatest(a["to"], x["e"]).alias("to"),
        ),
        lambda a: a["n"],
    )
    by_doc = by_doc.select("uid", covered.alias("n_hit"), F.array_sort("items").alias("items"))
    return base.select("uid", "doc_id", "digest", "n_words").join(by_doc, "uid", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "digest",
    )


def contaminated(share: int = 20):
    """Hit at all, and at least one word in ``share``."""
    return (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows, all columns kept. A text's verdict is found again by its digest."""
    judged = contamination(docs, items).where(contaminated()).select(F.col("digest").alias("_digest")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    rows = rows.withColumn("_key", F.md5(F.coalesce(F.col("_row.text"), F.lit(""))))
    return rows.join(judged.hint("shuffle_hash"), rows["_key"] == judged["_digest"], "left_anti").select("_row.*")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


_WORDS = "regexp_extract_all({}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(sql_lower_az("text"))} AS w FROM documents),
     i AS (SELECT item_id, {_WORDS.format(sql_lower_az("text"))} AS w FROM benchmark),
     iw AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS win
            FROM (SELECT item_id, w, least(len(w), 13) AS m, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
     dw AS (SELECT doc_id, s, m, array_to_string(w[s:s + m - 1], ' ') AS win
            FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
     h AS (SELECT doc_id, s, dw.m, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.m = iw.m),
     hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM h) GROUP BY doc_id),
     hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

QUERIES = {"op5_decontamination": (op5_decontamination, SQL)}

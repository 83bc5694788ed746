"""WARC archives as a PySpark data source, and an archive of web pages with revisit records for equal payloads.

Reading: the driver plans one partition per stretch of a file; a task reads each record's headers first and decides from them, with
the predicates pushed down, whether the record is wanted. Payloads of unwanted records, and all payloads if neither the
schema nor ``verify`` asks for them, are neither inflated nor copied. Files may be plain (``.warc``) or gzip by record
(``.warc.gz``); where a gzip member tells its length in the "sl" extra field, as those written here do, it is jumped over.

Writing: each task writes one file; the commit stores a manifest of the files and the places where they may be split. Only
files of a manifest are read, so the files of lost or repeated tasks do no harm. A folder without a manifest is read whole.
All access goes through pyarrow file systems, so the folder may be local, HDFS or an object store.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull,
    StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from fleetlens.llm.session import documents
from fleetlens.session import shared_dir

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
HEADER_COLUMNS = {
    "record_id": b"warc-record-id", "record_type": b"warc-type", "target_uri": b"warc-target-uri",
    "refers_to": b"warc-refers-to", "payload_digest": b"warc-payload-digest",
}
SPLIT_BYTES, BATCH_BYTES, HEAD = 32 * 1024 * 1024, 4 * 1024 * 1024, 4096
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def header_value(text: str) -> bytes:
    """A header is one line; line breaks in a value are percent-encoded."""
    return text.replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "replace")


# ---------------------------------------------------------------- writing


def record(row: dict, date: str) -> bytes:
    """The bytes of one record. A row without payload but with ``refers_to`` is a revisit."""
    revisit = row["refers_to"] is not None
    payload = b"" if revisit else (row["payload"] or b"")
    block = HTTP_HEAD + payload
    if revisit:
        mark, size = base64.b32encode(bytes.fromhex(row["payload_sha1"])).decode(), row["payload_bytes"]
    else:
        mark, size = digest(payload), len(payload)
    lines = [
        b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <" + header_value(row["record_id"]) + b">", b"WARC-Date: " + date.encode(),
        b"WARC-Payload-Digest: sha1:" + mark.encode(), b"X-Payload-Bytes: %d" % size,
    ]
    if row["target_uri"] is not None:
        lines.append(b"WARC-Target-URI: " + header_value(row["target_uri"]))
    if revisit:
        lines += [
            b"WARC-Refers-To: <" + header_value(row["refers_to"]) + b">",
            b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member whose extra field "sl" holds its compressed and plain length."""
    squeeze = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    extra = b"sl" + struct.pack("<HII", 8, len(body) & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    records: int
    splits: list[int] = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    """Columns: record_id, target_uri, payload (string or binary), refers_to, payload_sha1 (hex), payload_bytes."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.date = options.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = pafs.FileSystem.from_uri(self.path)
        name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
        size, records, splits, out = 0, 0, [0], None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:  # a task without rows leaves no file
                store.create_dir(folder, recursive=True)
                out = store.open_output_stream(f"{folder}/{name}", compression=None)
            place = batch.schema.get_field_index("payload")
            batch = batch.set_column(place, "payload", batch.column(place).cast(pa.binary()))
            for row in batch.to_pylist():
                data = record(row, self.date)
                data = gzip_member(data) if self.gzip else data
                if size - splits[-1] >= SPLIT_BYTES:
                    splits.append(size)
                out.write(data)
                size += len(data)
                records += 1
        if out is not None:
            out.close()
        return Written(name, size, records, splits)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = pafs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        files = [{"name": m.name, "size": m.size, "splits": m.splits} for m in messages if m is not None and m.records]
        with store.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.records:
                store.delete_file(f"{folder}/{m.name}")


# ---------------------------------------------------------------- reading


class Input:
    """Bytes of a file from a place on, with a buffer; ``skip`` jumps without reading where it can."""

    def __init__(self, file, at: int):
        self.file, self.buffer, self.at = file, b"", at
        file.seek(at)

    def peek(self, n: int) -> bytes:
        while len(self.buffer) < n:
            more = self.file.read(max(n - len(self.buffer), 1 << 18))
            if not more:
                break
            self.buffer += more
        return self.buffer[:n]

    def skip(self, n: int) -> None:
        self.at += n
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
        else:
            self.buffer = b""
            self.file.seek(self.at)


def parse_headers(head: bytes) -> dict[bytes, bytes]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def member_length(source: Input) -> int | None:
    """Length of the gzip member ahead if its extra field tells it."""
    head = source.peek(24)
    if len(head) >= 24 and head[3] == 4 and head[12:14] == b"sl":
        return 24 + struct.unpack("<I", head[16:20])[0] + 8
    return None


def records(file, start: int, end: int, gzipped: bool, wanted) -> Iterator[tuple[dict, bytes | None]]:
    """Headers and block (None if not wanted) of the records that start between two places of a file."""
    source = Input(file, start)
    while source.at < end:
        if not gzipped:
            head = b""
            while b"\r\n\r\n" not in head:
                longer = source.peek(len(head) + HEAD)
                if longer == head:
                    break
                head = longer
            if not head.strip():
                return
            lead = len(head) - len(head.lstrip(b"\r\n"))
            text, _, _ = head[lead:].partition(b"\r\n\r\n")
            headers = parse_headers(text)
            source.skip(lead + len(text) + 4)
            length = int(headers.get(b"content-length", b"0"))
            block = source.peek(length)[:length] if wanted(headers) else None
            source.skip(length)
            yield headers, block
            continue
        if not source.peek(1):
            return
        known = member_length(source)
        inflate = zlib.decompressobj(31)
        data, used = b"", 0
        while b"\r\n\r\n" not in data and not inflate.eof:  # headers first
            piece = source.peek(used + HEAD)[used:]
            if not piece:
                raise ValueError("a record ends within its headers")
            used += len(piece)
            data += inflate.decompress(piece)
        text, _, body = data.partition(b"\r\n\r\n")
        headers = parse_headers(text)
        keep = wanted(headers)
        if known is not None and not keep:
            source.skip(known)
            yield headers, None
            continue
        parts = [body]
        if known is not None:
            rest = source.peek(known)[used:]
            parts.append(inflate.decompress(rest))
            source.skip(known)
        else:
            while not inflate.eof:  # a foreign member: its end is found by inflating; unwanted output is let go
                piece = source.peek(used + (1 << 16))[used:]
                if not piece:
                    raise ValueError("a record is cut off")
                used += len(piece)
                more = inflate.decompress(piece)
                if keep:
                    parts.append(more)
            source.skip(used - len(inflate.unused_data))
        block = b"".join(parts)[: int(headers.get(b"content-length", b"0"))] if keep else None
        yield headers, block


def plain(headers: dict, column: str) -> str | None:
    value = headers.get(HEADER_COLUMNS[column])
    if value is None:
        return None
    text = value.decode("utf-8", "replace")
    if column in ("record_id", "refers_to"):
        return text.removeprefix("<").removesuffix(">")
    return text.removeprefix("sha1:") if column == "payload_digest" else text


def holds(kind: str, value, found: str | None) -> bool:
    if found is None:
        return False
    test = {
        "EqualTo": lambda: found == value, "In": lambda: found in value, "IsNotNull": lambda: True,
        "StringStartsWith": lambda: found.startswith(value), "StringEndsWith": lambda: found.endswith(value),
        "StringContains": lambda: value in found,
    }
    return test[kind]()


class WarcReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.columns = [f.name for f in schema.fields]
        self.path = options["path"]
        self.verify = options.get("verify", "false").lower() == "true"
        self.predicates: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Predicates on header columns are decided before a payload is touched; all others stay with Spark."""
        for f in filters:
            column = getattr(f, "attribute", ("",))
            if len(column) == 1 and column[0] in HEADER_COLUMNS and isinstance(
                f, (EqualTo, In, IsNotNull, StringStartsWith, StringEndsWith, StringContains)
            ):
                self.predicates.append((type(f).__name__, column[0], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, folder = pafs.FileSystem.from_uri(self.path)
        found = store.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        plans = [f for f in found if f.base_name.startswith("_manifest-")]
        files = []
        for f in plans:
            with store.open_input_stream(f.path) as manifest:
                files += json.loads(manifest.read())
        if not plans:
            files = [
                {"name": f.base_name, "size": f.size, "splits": [0]}
                for f in found if f.base_name.endswith((".warc", ".warc.gz"))
            ]
        out = []
        for f in sorted(files, key=lambda f: f["name"]):
            ends = [*f["splits"][1:], f["size"]]
            out += [InputPartition((f["name"], a, b)) for a, b in zip(f["splits"], ends)]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        name, start, end = partition.value
        store, folder = pafs.FileSystem.from_uri(self.path)
        decode = self.verify or "payload" in self.columns
        rows: dict[str, list] = {c: [] for c in self.columns}
        held = 0

        def passes(headers: dict) -> bool:
            return all(holds(kind, value, plain(headers, c)) for kind, c, value in self.predicates)

        with store.open_input_file(f"{folder}/{name}") as file:
            stream = records(file, start, end, name.endswith(".gz"), lambda h: decode and passes(h))
            for headers, block in stream:
                if not passes(headers):
                    continue
                payload = None
                size = int(headers[b"x-payload-bytes"]) if b"x-payload-bytes" in headers else None
                if block is not None:
                    payload = block
                    if headers.get(b"content-type", b"").startswith(b"application/http"):
                        payload = block.partition(b"\r\n\r\n")[2]
                    if headers.get(b"warc-type") == b"revisit":
                        payload = None
                    else:
                        size = len(payload)
                        if self.verify and plain(headers, "payload_digest") not in (None, digest(payload)):
                            raise ValueError(f"{plain(headers, 'record_id')}: the payload does not have its digest")
                for c in self.columns:
                    rows[c].append(payload if c == "payload" else size if c == "payload_bytes" else plain(headers, c))
                held += 400 + len(payload or b"") * ("payload" in self.columns)
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = {c: [] for c in self.columns}, 0
        if held:
            yield self._batch(rows)

    def _batch(self, rows: dict[str, list]) -> pa.RecordBatch:
        kinds = {"payload": pa.binary(), "payload_bytes": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.string())) for c, v in rows.items()], list(rows))


class WarcDataSource(DataSource):
    """Options: path; verify (compare payloads with their digests when read); compression (gzip or none), date (written)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        unknown = {f.name for f in schema.fields} - {*HEADER_COLUMNS, "payload", "payload_bytes"}
        if unknown:
            raise ValueError(f"no such columns in a WARC archive: {sorted(unknown)}")
        return WarcReader(schema, dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# ---------------------------------------------------------------- pages


def archive_pages(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id") -> None:
    """Write a record per page. Of equal payloads of ``least_bytes`` or more, the largest id is the response; others revisit it.

    Null html counts as empty. Ids may be of any type that has a text; they are written percent-encoded. A null id never is the
    response of others, and its record's id is empty, as is that of an empty text. Rows that repeat the largest id are all
    responses. A null URL gives a record without target.
    """
    spark = pages.sparkSession
    register(spark)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("_page"), F.col("url").alias("_url"), html.alias("_html"))
    marks = rows.select("_page", F.sha1("_html").alias("_sha"), F.octet_length("_html").cast("long").alias("_bytes"))
    largest = marks.where(F.col("_bytes") >= least_bytes).groupBy("_sha").agg(F.max("_page").alias("_keep"), F.count("*").alias("_n"))
    revisits = (
        marks.join(largest.where("_n > 1"), "_sha").where("NOT (_page <=> _keep) AND _keep IS NOT NULL")
        .select(F.col("_page").alias("_id"), F.col("_sha").alias("payload_sha1"), F.col("_bytes").alias("payload_bytes"), "_keep").distinct()
    )
    keyed = rows.withColumn("_sha", F.sha1("_html"))
    out = keyed.join(revisits, keyed["_page"].eqNullSafe(revisits["_id"]) & (keyed["_sha"] == revisits["payload_sha1"]), "left")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.url_encode(F.col(c).cast("string")), F.lit("")))
    out.select(
        name("_page").alias("record_id"), F.col("_url").alias("target_uri"),
        F.when(F.col("_keep").isNull(), F.col("_html")).alias("payload"),
        F.when(F.col("_keep").isNotNull(), name("_keep")).alias("refers_to"), "payload_sha1", "payload_bytes",
    ).write.format("warc").mode("append").option("path", path).save()


def read_pages(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The records of ``archive_pages``, each payload inflated and held against its digest.

    Ids come back as ``id_type``; one that cannot be read as such is an error. An empty id is null.
    """
    register(spark)
    columns = "record_id string, record_type string, refers_to string, payload_digest string, payload_bytes long"
    found = spark.read.format("warc").schema(columns).option("verify", "true").load(path)
    ident = lambda c: F.url_decode(F.nullif(F.substring(c, len("urn:page:") + 1, 1 << 30), F.lit(""))).cast(id_type)
    return found.select(
        ident("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        ident("refers_to").alias("refers_to"),
    )


def op9_warc(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc-pages")
    pages = documents(spark, sf_dir, "pages")
    archive_pages(pages, path)
    return read_pages(spark, path, pages.schema["page_id"].dataType.simpleString())


_BITS = "list_aggregate(list_transform(range(40), lambda i: bin4[CAST(strpos('0123456789abcdef', substr(h, CAST(i AS BIGINT) + 1, 1)) AS BIGINT)]), 'string_agg', '')"
SQL = f"""
WITH t AS (SELECT page_id, sha1(coalesce(html, '')) AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
      ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'] AS bin4
    FROM pages),
 b AS (SELECT page_id, h, payload_bytes, {_BITS} AS bits FROM t),
 d AS (SELECT page_id, h, payload_bytes, list_aggregate(list_transform(range(32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda j:
        CAST(substr(bits, CAST(5 * i + j + 1 AS BIGINT), 1) AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER))) AS BIGINT), 1)), 'string_agg', '')
      AS payload_digest FROM b),
 g AS (SELECT h, max(page_id) AS keep FROM d GROUP BY h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM d JOIN g USING (h)
"""

QUERIES = {"op9_warc": (op9_warc, SQL)}

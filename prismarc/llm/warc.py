"""WARC archives as a chunked record table.

An archive is a table of chunks: a row holds at most ``CHUNK`` payload bytes of
one record, with the record's identifier, the chunk's number and the SHA-1 of
the payload up to and including this chunk.  The bytes of the rows, in order,
are WARC/1.1 records.  Payloads are cut into chunks by Spark expressions before
they reach a worker, so writing and reading hold no more than a batch of chunks
there (the JVM has the row's payload and its parts, as the input has it in one
value), and reading checks every digest.

Of records with equal payloads of at least ``least`` bytes the one with the
smallest id is a response, the others are revisits of it; smaller ones are all
responses.  A row without an id is always a response.  Repeated rows with the
smallest id are all responses.  Null payloads are empty ones.  Null addresses
are written as ``about:blank``.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, fresh_path, table

CHUNK, BATCH = 1 << 18, 8 << 20
TABLE = "archive_no int, record_no long, record_id string, chunk_no int, data binary, payload_sha1 string"
HTTP_START = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
#: The tables have no dates, so all records have one.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = 0) -> DataFrame:
    """__id, __url, __kind, __refers, __refers_url, __bytes, __sha1 (hex), __payload (null for revisits).

    Payloads move by their id; a payload that a third of all rows share moves once.
    """
    raw = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    every = pages.select(F.col(id_col).alias("__id"), F.coalesce(F.col(url_col), F.lit("about:blank")).alias("__url"), raw.alias("__payload"))
    every = every.withColumns({"__bytes": F.octet_length("__payload").cast("long"), "__sha1": F.sha1("__payload")})
    slim = every.drop("__payload")
    first = slim.filter("__id IS NOT NULL").groupBy("__sha1", "__bytes").agg(F.min(F.struct("__id", "__url")).alias("__first"))
    told = slim.join(first, ["__sha1", "__bytes"])
    again = (F.col("__id") != F.col("__first.__id")) & (F.col("__bytes") >= least)
    revisits = told.filter(again).select(
        "__id", "__url", F.lit("revisit").alias("__kind"), F.col("__first.__id").alias("__refers"), F.col("__first.__url").alias("__refers_url"), "__bytes", "__sha1", F.lit(None).cast("binary").alias("__payload")
    )
    gone = told.filter(again).select("__id", "__sha1", "__bytes").distinct()
    kinds = dict(every.dtypes)
    responses = every.join(gone, ["__id", "__sha1", "__bytes"], "left_anti").select(
        "__id", "__url", F.lit("response").alias("__kind"), F.lit(None).cast(kinds["__id"]).alias("__refers"), F.lit(None).cast("string").alias("__refers_url"), "__bytes", "__sha1", "__payload"
    )
    return responses.unionByName(revisits)


def in_chunks(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Planned records with their payloads cut: a row for each chunk, those of a record one after another.

    Length, digests and parts are Spark expressions, so a worker sees chunks only; a record without payload has one empty chunk.
    """
    payload = F.coalesce(F.col("__payload"), F.lit(b""))
    http = F.concat(F.encode(F.lit(HTTP_START), "UTF-8"), F.encode(F.concat(F.col("__bytes").cast("string"), F.lit("\r\n\r\n")), "UTF-8"))
    many = F.greatest(F.lit(1), F.ceil(F.octet_length(payload) / F.lit(chunk)).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), many - 1), lambda k: F.substring(payload, k * chunk + 1, F.lit(chunk)))
    head = ["__id", "__url", "__kind", "__refers", "__refers_url", "__bytes", "__sha1"]
    return records.select(*head, F.sha1(F.concat(http, payload)).alias("__block"), many.alias("__many"), F.posexplode(parts).alias("__chunk", "__part"))


def record_head(name: str, kind: str, page: object, url: str, refers: object, refers_url: str | None, size: int, sha1: bytes, block: int, block_sha1: bytes) -> bytes:
    line = lambda text: "".join(c for c in text if c >= " ")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + line(url),
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32(sha1)}",
        f"WARC-Block-Digest: sha1:{base32(block_sha1)}",
        f"X-Page-ID: {'' if page is None else page}",
        f"X-Payload-Bytes: {size}",
        f"Content-Length: {block}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", "WARC-Refers-To-Target-URI: " + line(refers_url or ""), f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page: {refers}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def chunk_rows(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The record table of planned records.

    A record's identifier is made of its place (archive and number), so equal rows have identifiers of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive, record, held, size = TaskContext.get().partitionId(), -1, [], 0
        name, running = "", hashlib.sha1()
        fields = ("archive_no", "record_no", "record_id", "chunk_no", "data", "payload_sha1")
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.string())

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=fields)

        for batch in batches:
            column = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            parts = column.pop("__part")
            slim = {k: v.to_pylist() for k, v in column.items()}
            for i in range(batch.num_rows):
                row = {k: v[i] for k, v in slim.items()}
                part, head = memoryview(parts[i].as_buffer()), b""
                if row["__chunk"] == 0:
                    record, running = record + 1, hashlib.sha1()
                    name = f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{archive}|{record}|{row["__id"]}|{row["__url"]}'.encode()).hexdigest())}>"
                    http = (HTTP_START + f"{row['__bytes']}\r\n\r\n").encode()
                    block = len(http) + (row["__bytes"] if row["__kind"] == "response" else 0)
                    told = (row[k] for k in ("__kind", "__id", "__url", "__refers", "__refers_url", "__bytes"))
                    head = record_head(name, *told, bytes.fromhex(row["__sha1"]), block, bytes.fromhex(row["__block"])) + http
                running.update(part)
                data = b"".join((head, part, b"\r\n\r\n" if row["__chunk"] == row["__many"] - 1 else b""))
                held.append((archive, record, name, row["__chunk"], data, base32(running.digest())))
                size += len(data) + 100
                if size > BATCH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return in_chunks(records, chunk).mapInArrow(run, TABLE)


class Reading:
    """A record that is read chunk by chunk."""

    def __init__(self) -> None:
        self.head, self.fields, self.http, self.left = b"", None, False, 0
        self.sha1, self.size, self.next, self.sound = hashlib.sha1(), 0, 0, True

    def add(self, number: int, data: memoryview, so_far: str) -> None:
        self.sound &= number == self.next
        self.next += 1
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            lines = self.head[:end].decode("utf-8", "replace").split("\r\n")
            self.fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            self.left, data, self.head = int(self.fields["content-length"]), memoryview(self.head)[end + 4 :], b""
        if not self.http:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            self.http, data = True, memoryview(self.head)[end + 4 :]
            self.left -= end + 4
            self.head = b""
        body = data[: self.left]
        self.sha1.update(body)
        self.size += len(body)
        self.left -= len(body)
        self.sound &= base32(self.sha1.digest()) == so_far

    def row(self) -> tuple:
        f = self.fields or {}
        kind = f.get("warc-type", "")
        digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "response":
            digest, self.sound = base32(self.sha1.digest()), self.sound and digest == base32(self.sha1.digest())
        page, refers = f.get("x-page-id") or None, f.get("x-refers-to-page") or None
        size = self.size if kind == "response" else int(f.get("x-payload-bytes", 0))
        return page, size, digest, kind, refers, self.sound and self.left == 0


def read_records(chunks: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, sound (all digests and lengths fit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound")
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
        at, reading = None, Reading()
        for batch in batches:
            out = []
            archive, record, number, so_far = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("archive_no", "record_no", "chunk_no", "payload_sha1"))
            data = batch.column(batch.schema.get_field_index("data"))
            for i, key in enumerate(zip(archive, record, strict=True)):
                if key != at:
                    if at is not None:
                        out.append(reading.row())
                    at, reading = key, Reading()
                reading.add(number[i], memoryview(data[i].as_buffer()), so_far[i])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(reading.row(), kinds, strict=True)], names=names)

    sorted_chunks = chunks.repartition("archive_no", "record_no").sortWithinPartitions("archive_no", "record_no", "chunk_no")
    rows = sorted_chunks.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, sound boolean")
    return rows.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> None:
    records = chunk_rows(plan_records(pages, id_col, url_col, payload_col, least))
    records.write.option("compression", "zstd").parquet(path)


def archive_bytes(chunks: DataFrame) -> DataFrame:
    """The rows' bytes in file order: an archive's file is what its rows hold, one after another."""
    return chunks.select("archive_no", "record_no", "chunk_no", "data").orderBy("archive_no", "record_no", "chunk_no")


def warc_roundtrip(pages: DataFrame, least: int = 0) -> DataFrame:
    """The contract's columns, read back from archives written to the shared folder."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, least=least)
    back = read_records(spark.read.schema(TABLE).parquet(path), dict(pages.dtypes)["page_id"])
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound")


def query(spark, sf_dir: str) -> DataFrame:
    return warc_roundtrip(table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n, sha1(html) AS h FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first FROM d)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, true AS sound
FROM m
"""

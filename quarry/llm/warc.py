"""WARC archives as a chunked record table: written and read back without whole-record buffers.

A record is never handled whole outside its table: ``chunk_table`` cuts payloads, in the JVM, into
rows (record, chunk number, bytes) of at most ``chunk_bytes``. The writer takes these rows as they
come, carries each record's SHA-256 from chunk to chunk, appends them to gzipped archives (one gzip
member per record, as usual for .warc.gz) and starts a new archive once ``archive_bytes`` are
written. The reader inflates an archive block by block and gives the chunk table back, each row
with the digest so far, so the last chunk of a record carries the digest of its full payload. Both
ends compare it with the digest in the record's header.

Records with equal payloads of at least ``least_bytes`` are stored once: the one with the
smallest id as ``response``, the others as ``revisit`` records that name it and keep the digest
and the length of the full payload in their headers.

Tasks write under names of their own and report archives in a manifest; only what the committed
manifest names is read, so a task that ran twice or died midway leaves nothing that counts. All
files are in the shared folder and are opened through its own file system.

Defined results: a null payload is empty; rows that repeat the smallest id of a payload are all
responses; a null id is written as an empty one and never becomes a response of a group that
has other ids; equal ids with different payloads are different records; an empty table makes no
archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import join_spread, make_folder, map_batches, prepare, workspace, written

CHUNK_BYTES = 64 << 10
ARCHIVE_BYTES = 128 << 20
LEAST_BYTES = 100
DATE = "2000-01-01T00:00:00Z"

CHUNKS = "record_id string, uri string, record_type string, refers_to string, payload_bytes long, chunk_no long, data binary, digest string, is_last boolean"


def chunk_table(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of planned records, a record's together and in order; a revisit has one, without bytes."""
    stored = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes"))
    sized = records.withColumn("payload", F.coalesce("payload", F.lit("")).cast("binary")).withColumn("stored", stored)
    last = F.greatest(F.ceil(F.col("stored") / chunk_bytes), F.lit(1)).cast("int") - 1
    each = sized.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    at = F.col("chunk_no").cast("long") * chunk_bytes
    data = F.when(F.col("stored") > 0, F.substring("payload", (at + 1).cast("int"), F.lit(chunk_bytes))).otherwise(F.lit(b""))
    return each.select(
        "record_id", "uri", "record_type", "refers_to", "payload_bytes", F.col("chunk_no").cast("long").alias("chunk_no"),
        data.alias("data"), "digest", (at + chunk_bytes >= F.col("stored")).alias("is_last"),
    )


_SCHEMA = pa.schema(
    [("record_id", pa.string()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()),
     ("chunk_no", pa.int64()), ("data", pa.binary()), ("digest", pa.string()), ("is_last", pa.bool_())]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _urn(value: str | None) -> str:
    """Ids may hold any character: they travel as base64url in a urn."""
    return "<urn:record:" + base64.urlsafe_b64encode((value or "").encode()).decode() + ">"


def _from_urn(value: str) -> str:
    return base64.urlsafe_b64decode(value.removeprefix("<urn:record:").removesuffix(">")).decode()


def _safe(uri: str | None) -> str:
    return " ".join((uri or "").split())


class ArchiveWriter:
    """Appends chunk rows to gzipped WARC archives; a record's header goes out with its first chunk."""

    def __init__(self, folder: str, archive_bytes: int):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.limit, self.out, self.manifest = archive_bytes, None, []

    def _open(self) -> None:
        self.path = f"{self.folder}/{uuid.uuid4().hex}.warc.gz"
        self.out, self.written, self.records = self.files.open_output_stream(self.path), 0, 0
        self._member(["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {_urn('warcinfo')}", f"WARC-Date: {DATE}", "Content-Type: application/warc-fields", "Content-Length: 0"], done=True)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _member(self, head: list[str], done: bool = False) -> None:
        self.zip = zlib.compressobj(1, zlib.DEFLATED, 31)
        self._put(self.zip.compress(("\r\n".join(head) + "\r\n\r\n").encode()))
        if done:
            self._end()

    def _end(self) -> None:
        self._put(self.zip.compress(b"\r\n\r\n") + self.zip.flush())

    def add(self, record_id, uri, record_type, refers_to, total, number, data, digest, is_last) -> None:
        revisit = record_type == "revisit"
        if number == 0:
            more = [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Payload-Length: {total}"]
            self._begin(record_id, uri, record_type, 0 if revisit else total, digest, more if revisit else [])
            self.digest = hashlib.sha256()
        if not revisit:
            self.digest.update(data)
            self._put(self.zip.compress(data))
        if is_last:
            if not revisit and self.digest.hexdigest() != digest:
                raise ValueError(f"the chunks of {record_id} are not its payload")
            self._end()
            self.records += 1
            if self.written >= self.limit:
                self.close()

    def _begin(self, record_id, uri, record_type, length, digest, more=()) -> None:
        if self.out is None:
            self._open()
        null = ["X-Null-Record-ID: 1"] if record_id is None else []
        self._member(["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {_urn(record_id)}", *null, f"WARC-Date: {DATE}", f"WARC-Target-URI: {_safe(uri)}", f"WARC-Payload-Digest: sha256:{digest}", *more, "Content-Type: text/html; charset=utf-8", f"Content-Length: {length}"])

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.manifest.append((self.path, self.records, self.written))
            self.out = None


def _write(batches: Iterator[pa.RecordBatch], folder: str, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    writer = ArchiveWriter(folder, archive_bytes)
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            writer.add(*row)
    writer.close()
    path, records, size = zip(*writer.manifest, strict=True) if writer.manifest else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(records, pa.int64()), pa.array(size, pa.int64())], names=["path", "records", "bytes"])


class _Inflated:
    """The inflated bytes of a gzipped file of many members, block by block."""

    def __init__(self, stream, block: int):
        self.stream, self.block, self.zip, self.have, self.rest = stream, block, zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        while True:
            if self.zip.eof:
                self.rest, self.zip = self.zip.unused_data or self.rest, zlib.decompressobj(31)
            data = self.rest or self.stream.read(self.block)
            if not data:
                return False
            out = self.zip.decompress(data, self.block)
            self.rest = b"" if self.zip.eof else self.zip.unconsumed_tail
            if out:
                self.have += out
                return True

    def head(self) -> bytes | None:
        """Up to the empty line, line ends before it skipped; None at the end."""
        while (at := self.have.find(b"\r\n\r\n", 4 if self.have.startswith(b"\r\n\r\n") else 0)) < 0:
            if not self._more():
                return None
        out, self.have = self.have[:at], self.have[at + 4 :]
        return out.lstrip(b"\r\n")

    def take(self, most: int) -> bytes:
        while not self.have and self._more():
            pass
        out, self.have = self.have[:most], self.have[most:]
        return out


def read_archive(path: str, folder: str, chunk_bytes: int, with_data: bool = True) -> Iterator[tuple]:
    """Chunk rows of an archive; memory holds a chunk, however long the record."""
    files, _ = fs.FileSystem.from_uri(folder)
    with files.open_input_stream(path) as stream:
        source = _Inflated(stream, chunk_bytes)
        while (head := source.head()) is not None:
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            kind, left = fields["WARC-Type"], int(fields["Content-Length"])
            if kind == "warcinfo":
                continue
            name = None if "X-Null-Record-ID" in fields else _from_urn(fields["WARC-Record-ID"])
            refers = _from_urn(fields["WARC-Refers-To"]) if kind == "revisit" else None
            known = fields.get("WARC-Payload-Digest", "").removeprefix("sha256:")
            base = (name, fields.get("WARC-Target-URI", ""), kind, refers)
            if kind == "revisit":
                yield (*base, int(fields["X-Payload-Length"]), 0, b"", known, True)
                continue
            total, number, digest = left, 0, hashlib.sha256()
            while True:
                part = source.take(min(left, chunk_bytes)) if left else b""
                if left and not part:
                    raise ValueError(f"{path} ends within a record")
                left -= len(part)
                digest.update(part)
                yield (*base, total, number, part if with_data else b"", digest.hexdigest(), not left)
                number += 1
                if not left:
                    break
            if known and known != digest.hexdigest():
                raise ValueError(f"{path}: the payload digest of {name} differs")


def _read(batches: Iterator[pa.RecordBatch], folder: str, chunk_bytes: int, with_data: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch["path"].to_pylist():
            rows, held = [], 0
            for row in read_archive(path, folder, chunk_bytes, with_data):
                if not with_data and not row[-1]:
                    continue
                rows.append(row)
                held += len(row[6]) + 200
                if held >= 4 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def plan_records(records: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """record_type, refers_to, payload_bytes and digest for (id, uri, payload) rows; the payload moves once, by id."""
    text = F.coalesce("payload", F.lit(""))
    keyed = records.select("id", "uri", "payload", F.sha2(text, 256).alias("sha"), F.octet_length(text).alias("n"))
    long_ = keyed.where(F.col("n") >= least_bytes).select("id", "sha")
    first = long_.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND first IS NOT NULL").drop("copies")
    revisits = join_spread(long_, first, ["sha"], "id").where("NOT id <=> first").distinct()
    revisits = revisits.select(F.col("id").alias("r_id"), F.col("sha").alias("r_sha"), "first")
    joined = keyed.join(revisits, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("sha") == F.col("r_sha")), "left")
    return joined.select(
        F.col("id").cast("string").alias("record_id"), "uri", F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("first").cast("string").alias("refers_to"), "payload", F.col("n").cast("long").alias("payload_bytes"), F.col("sha").alias("digest"),
    )


def write_warc(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write planned records; the manifest (path, records, bytes) of the archives that count."""
    spark: SparkSession = records.sparkSession
    prepare(spark)
    make_folder(spark, f"{folder}/archives")
    made = map_batches(chunk_table(records, chunk_bytes), lambda b: _write(b, f"{folder}/archives", archive_bytes), "path string, records long, bytes long")
    return written(made, f"{folder}/manifest")


def read_warc(manifest: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """Chunk rows of the manifest's archives; without data only each record's last chunk, digest included."""
    # One archive a task where there are that many: archives are the unit of reading.
    tasks = max(1, min(manifest.count(), 100_000))
    return map_batches(manifest.repartition(tasks, "path"), lambda b: _read(b, f"{folder}/archives", chunk_bytes, with_data), CHUNKS)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = workspace(spark, "warc")
    records = plan_records(pages.select(F.col("page_id").alias("id"), F.col("url").alias("uri"), F.col("html").alias("payload")))
    manifest = write_warc(records, folder)
    return read_warc(manifest, folder).where("is_last").select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, d AS payload_digest, min(page_id) OVER (PARTITION BY d) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> f THEN f END AS refers_to
FROM q
"""

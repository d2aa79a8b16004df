"""WARC archives: writing one gzip member per record and reading them back sequentially.

Writing: every task writes one archive into the shared folder and returns a manifest row; only
archives of tasks that succeeded are in the manifest, so a repeated task leaves at most an unlisted
file. Payloads that repeat are written once as `response`; the others are `revisit` records that hold
only the HTTP header.

Reading: an archive is a stream of gzip members. Chunks of bytes go through one zlib object for each
member, the header gives the block's length, and the digests of block and payload are verified. A task
holds one record at a time.

Defined cases: a null payload is empty; a null id is written without an id and read back as null, and
such a row revisits the row with the smallest id of its payload (where none has an id all are
responses); rows with the same id and payload as the response are responses too; an empty table gives
no archives and an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, materialise, shared_dir, with_salts

CHUNK = 1 << 18
MANIFEST = "path string, n_records long, n_bytes long"


class BadRecord(ValueError):
    """A record whose framing or digest is wrong."""


def mark_revisits(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """Adds `digest` (SHA-256 of the payload, hex) and `refers_to`: of rows with equal payloads of at
    least ``least_bytes`` the smallest id, for the others null.

    Only digests that repeat are joined back, and large groups over salts: a payload may be that of a
    third of all rows.
    """
    rows = pages.withColumn("digest", F.sha2(F.col(payload_col), 256))
    again = rows.filter(F.octet_length(payload_col) >= least_bytes).groupBy("digest").agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = materialise(again)
    rows, again = with_salts(rows, again, ["digest"], "n", pages.count())
    # A row without an id isn't the one with the smallest.
    refers = F.when(~F.col("first_id").eqNullSafe(F.col(id_col)), F.col("first_id"))
    return rows.join(again, ["digest", "__salt"], "left").withColumn("refers_to", refers).drop("first_id", "n", "__salt")


def record(page_id, uri: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if uri is not None:
        head.insert(3, "WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, out_dir: str, id_col: str = "page_id", payload_col: str = "html", uri_col: str | None = "url", least_bytes: int = 100, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write one record for each row of ``pages`` below ``out_dir``; returns the manifest of archives."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(out_dir)
        task = TaskContext.get()
        path = f"{top}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        out, n, size = None, 0, 0
        for batch in by_bytes(batches, "payload"):
            if out is None and batch.num_rows:
                store.create_dir(top, recursive=True)
                out = store.open_output_stream(path, compression=None)
            for row in batch.to_pylist():
                member = record(row["id"], row["uri"], row["payload"], row["digest"], row["refers_to"], date)
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "n_records", "n_bytes"])

    uri = F.col(uri_col).cast("string") if uri_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), uri.alias("uri"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    return materialise(mark_revisits(rows, "id", "payload", least_bytes).select("id", "uri", "payload", "digest", "refers_to").mapInArrow(write, MANIFEST))


def members(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """The content of each gzip member of a stream of bytes, by incremental decompression."""
    data = stream.read(chunk)
    while data:
        unpacker, parts = zlib.decompressobj(31), []
        while True:
            parts.append(unpacker.decompress(data))
            if unpacker.eof:
                data = unpacker.unused_data or stream.read(chunk)
                break
            data = stream.read(chunk)
            if not data:
                raise BadRecord("the archive ends within a record")
        yield b"".join(parts)


def fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode().split("\r\n")
    found = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise BadRecord(f"a header line without a colon: {line[:80]!r}")
        found[name.strip().lower()] = value.strip()
    return first, found


def parse(content: bytes) -> dict:
    """One record: framing by Content-Length, then the digests."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    version, warc = fields(head)
    if not gap or not version.startswith("WARC/"):
        raise BadRecord("a record doesn't begin with a WARC header")
    length = int(warc["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise BadRecord(f"{warc['warc-record-id']}: the block isn't {length} bytes and two line ends")
    block = rest[:length]
    block_digest = "sha256:" + hashlib.sha256(block).hexdigest()
    if block_digest != warc["warc-block-digest"]:
        raise BadRecord(f"{warc['warc-record-id']}: the block's digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    _, answer = fields(http)
    n = int(answer["content-length"])
    if warc["warc-type"] == "response" and (len(payload) != n or "sha256:" + hashlib.sha256(payload).hexdigest() != warc["warc-payload-digest"]):
        raise BadRecord(f"{warc['warc-record-id']}: the payload's length or digest differs")
    name = lambda urn: urn[len("<urn:page:") : -1] or None
    return {"id": name(warc["warc-record-id"]), "payload_bytes": n, "payload_digest": warc["warc-payload-digest"].removeprefix("sha256:"), "record_type": warc["warc-type"], "refers_to": name(warc["warc-refers-to"]) if "warc-refers-to" in warc else None, "uri": warc.get("warc-target-uri"), "block_digest": block_digest.removeprefix("sha256:")}


def read_archives(manifest: DataFrame, base_uri: str, id_type: str = "bigint", id_name: str = "page_id", rows: int = 2048) -> DataFrame:
    """One row for each record of the archives in ``manifest`` (their number is verified too)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(base_uri)
        names = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "block_digest"]
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 5]
        for batch in batches:
            for archive in batch.to_pylist():
                n, held = 0, []
                with store.open_input_stream(archive["path"], compression=None) as stream:
                    for content in members(stream):
                        held.append(parse(content))
                        n += 1
                        if len(held) >= rows:
                            yield pa.record_batch([pa.array([x[k] for x in held], t) for k, t in zip(names, kinds, strict=True)], names)
                            held = []
                if n != archive["n_records"]:
                    raise BadRecord(f"{archive['path']} holds {n} records, not {archive['n_records']}")
                if held:
                    yield pa.record_batch([pa.array([x[k] for x in held], t) for k, t in zip(names, kinds, strict=True)], names)

    # About one archive a task, dealt in turn, so that a lost executor costs one archive.
    spread = manifest.repartition(max(1, min(manifest.count(), 1 << 16)))
    found = spread.mapInArrow(read, "id string, payload_bytes long, payload_digest string, record_type string, refers_to string, uri string, block_digest string")
    return found.select(F.col("id").cast(id_type).alias(id_name), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"), "uri", "block_digest")


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", uri_col: str | None = "url", least_bytes: int = 100) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    out = shared_dir(pages.sparkSession)
    manifest = write_archives(pages, out, id_col, payload_col, uri_col, least_bytes)
    return read_archives(manifest, out, pages.schema[id_col].dataType.simpleString(), id_col)

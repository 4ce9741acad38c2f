"""WARC archives: a writer, a normaliser of monolithic gzip archives, and a reader by offset.

An archive is a row (archive, data): its name and its bytes. Archives live in Parquet tables in shared storage,
so executors need no common file system beyond what Spark itself reads and writes. The writer compresses all
records of an archive as one gzip stream, as many tools do; such a file can only be read from its start. The
normaliser inflates each stream once, cuts it at record ends (header, Content-Length), writes every record as a
gzip member of its own and notes offset and length of each in a sidecar index. The reader takes single records
by offset.

Defined cases: a null payload is empty; payloads below the revisit size are always responses; equal payloads at
or above it have one response, that with the largest id (null ids rank lowest), and the others are revisits of
it; repeated rows with the same id each have a record, the copies being revisits; empty tables give no archive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm import common

REVISIT_BYTES = 1000
ARCHIVES = "archive string, data binary"
NORMALISED = "archive string, data binary, sidecar string"
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, archive string, offset bigint, length bigint, payload binary"


def plan_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to for each page.

    Digests of large payloads are counted with a map-side combine; only those that occur twice or more go into
    the join, which leaves payloads of all other pages alone."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    df = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    large = F.col("payload_bytes") >= least
    rows = df.where(large).groupBy("payload_digest", "page_id", "url").agg(F.count("*").alias("copies"))
    twice = rows.groupBy("payload_digest").agg(F.max(F.struct("page_id", "url", "copies")).alias("kept"), F.sum("copies").alias("times")).where("times > 1")
    df = df.join(twice.withColumnRenamed("payload_digest", "their"), (F.col("payload_digest") == F.col("their")) & large, "left")
    chosen = F.col("page_id").eqNullSafe(F.col("kept.page_id")) & F.col("url").eqNullSafe(F.col("kept.url"))
    repeated = F.coalesce(F.col("kept").isNotNull() & chosen & (F.col("kept.copies") > 1), F.lit(False))
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest"]
    kept_id = F.col("kept.page_id").alias("kept_id")
    single = df.where(~repeated).select(*columns, (F.col("kept").isNotNull() & ~chosen).alias("revisit"), kept_id)
    # Equal rows that hold the response are counted and told apart by number: the first is it.
    equal = df.where(repeated).groupBy(*columns, kept_id).agg(F.count("*").alias("copies")).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    both = single.union(equal.select(*columns, F.col("i") > 1, "kept_id"))
    return both.select(*columns, F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"), F.when(F.col("revisit"), F.col("kept_id")).alias("refers_to"))


def _record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    target = re.sub(r"[\r\n]", "%0A", url or "urn:page")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
        payload = b""
    return "\r\n".join([*head, f"Content-Length: {len(payload)}", "", ""]).encode() + payload + b"\r\n\r\n"


def write_archives(records: DataFrame, archive_bytes: int = 8_000_000) -> DataFrame:
    """plan_records() -> archives of about archive_bytes before compression, each one single gzip stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, size, out, gz = TaskContext.get().partitionId(), 0, 0, [], None

        def close():
            nonlocal number, size, out, gz
            row = pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{number:05d}.warc.gz"]), pa.array([b"".join([*out, gz.flush()])], pa.binary())], names=["archive", "data"])
            number, size, out, gz = number + 1, 0, [], None
            return row

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")]
            for row in zip(*columns, strict=True):
                gz = gz or zlib.compressobj(1, zlib.DEFLATED, 31)
                record = _record(*row)
                out.append(gz.compress(record))
                size += len(record)
                if size >= archive_bytes:
                    yield close()
        if gz:
            yield close()

    return common.map_batches(records, run, ARCHIVES)


_HEAD_END = b"\r\n\r\n"


def cut_stream(data: bytes) -> Iterator[bytes]:
    """The records of one gzip file, inflated once from start to end; several members are one stream."""
    buffer, inflate = bytearray(), zlib.decompressobj(31)
    position = 0
    for at in range(0, len(data), 1 << 20):
        piece = data[at : at + (1 << 20)]
        while piece:
            buffer += inflate.decompress(piece)
            piece = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
                piece = piece.lstrip(b"\0")
        while True:
            end = buffer.find(_HEAD_END, position)
            length = re.search(rb"(?im)^Content-Length:\s*(\d+)\s*$", buffer[position:end]) if end >= 0 else None
            if end >= 0 and not length:
                raise ValueError("a record without Content-Length")
            if end < 0 or len(buffer) < (stop := end + 4 + int(length[1]) + 4):
                break
            yield bytes(buffer[position:stop])
            position = stop
        del buffer[:position]
        position = 0
    if buffer.strip(b"\r\n"):
        raise ValueError("the archive ends within a record")


def normalise(archives: DataFrame) -> DataFrame:
    """archive, data -> archive, data with a member for each record, and the sidecar: lines "number offset length"."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("archive").to_pylist(), batch.column("data").to_pylist(), strict=True):
                members, lines, offset = [], [], 0
                for number, record in enumerate(cut_stream(data or b"")):
                    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                    members.append(gz.compress(record) + gz.flush())
                    lines.append(f"{number} {offset} {len(members[-1])}")
                    offset += len(members[-1])
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([b"".join(members)], pa.binary()), pa.array(["\n".join(lines)])], names=["archive", "data", "sidecar"])

    return archives.select("archive", "data").mapInArrow(run, NORMALISED)


def read_records(archives: DataFrame, payload: bool = True) -> DataFrame:
    """normalise() -> a row for each record, fetched by its offset in the sidecar. A response's bytes and digest
    are those of the payload read back; a revisit, which has none, states those of the payload it refers to."""

    def number(text: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
        return int(m[1]) if m else None

    names = [x.split()[0] for x in RECORDS.split(", ")]
    kept = [n for n in names if payload or n != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "offset": pa.int64(), "length": pa.int64(), "payload": pa.binary()}
        for batch in batches:
            for name, data, sidecar in zip(*(batch.column(c).to_pylist() for c in ("archive", "data", "sidecar")), strict=True):
                rows = []
                for line in filter(None, sidecar.split("\n")):
                    _, offset, length = map(int, line.split())
                    record = zlib.decompress(data[offset : offset + length], 31)
                    end = record.index(_HEAD_END)
                    head = dict(x.split(": ", 1) for x in record[:end].decode().split("\r\n")[1:])
                    body = record[end + 4 : end + 4 + int(head["Content-Length"])]
                    kind = head["WARC-Type"]
                    digest, size = (hashlib.sha1(body).hexdigest(), len(body)) if kind == "response" else (head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"]))
                    rows.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"], kind, number(head.get("WARC-Refers-To")), size, digest, name, offset, length, body))
                if rows:
                    columns = dict(zip(names, zip(*rows, strict=True), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[n], types.get(n, pa.string())) for n in kept], names=kept)

    return archives.mapInArrow(run, ", ".join(x for x in RECORDS.split(", ") if x.split()[0] in kept))


def export_local(archives: DataFrame, folder: str) -> list[str]:
    """Write normalised archives as files (name, name.idx) into a folder of the driver, one archive at a time."""
    import os

    os.makedirs(folder, exist_ok=True)
    written = []
    for row in archives.toLocalIterator():
        path = os.path.join(folder, row["archive"])
        with open(path, "wb") as f:
            f.write(row["data"])
        with open(f"{path}.idx", "w") as f:
            f.write(row["sidecar"])
        written.append(path)
    return written

"""WARC archives, compressed record by record with a Zstandard dictionary of their own.

Each archive starts with a skippable frame that holds a dictionary built from its records; every record follows as a frame of its
own, so any record can be read alone. Tasks write archives of bounded size into a shared folder and report them as rows; the
manifest of these rows names only archives of tasks that succeeded, so archives of lost attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hookflow.llm.common import utf8, written
from hookflow.session import scratch_path

DATE = "2024-01-01T00:00:00Z"
ARCHIVE_BYTES = 32 << 20  # of records, before compression
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 4 << 20  # of an archive's records, evenly spaced, that its dictionary is built from
LEVEL = 6
MAGIC = 0x184D2A5D  # of a skippable frame that holds a dictionary, in .warc.zst files
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: a response, or a revisit without the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = _HTTP % len(payload) + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_UNSAFE.sub(lambda m: f'%{ord(m[0]):02X}', url or '') or 'urn:none'}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Built from evenly spaced records; where there are too few to train on, the end of the first ones as they are."""
    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    sample = [r[: SAMPLE_BYTES // 16] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=512, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    """A .warc.zst file: dictionary frame, then a frame for each record."""
    first = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n" % (
        str(uuid.uuid5(uuid.NAMESPACE_OID, hashlib.sha1(b"".join(records[:1])).hexdigest())).encode(),
        DATE.encode(),
    )
    learned = dictionary(records)
    data = learned.as_bytes()
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=learned, write_checksum=True)
    return b"".join([struct.pack("<II", MAGIC, len(data)), data, *map(compressor.compress, [first, *records])])


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of a .warc.zst file."""
    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    learned = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    decompressor = zstandard.ZstdDecompressor(dict_data=learned)
    view, at, step = memoryview(data), 8 + size, 1 << 14
    while at < len(view):
        frame, out = decompressor.decompressobj(), []
        while not frame.eof:
            if at >= len(view):
                raise ValueError("archive ends inside a record")
            piece = view[at : at + step]
            out.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _page(record_id: str) -> int | None:
    number = record_id.split(":")[2]
    return int(number) if number else None


def described(data: bytes) -> tuple | None:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record; None for those that are no pages."""
    fields, block = parse(data)
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return _page(fields["WARC-Record-ID"]), size, digest, kind, _page(fields["WARC-Refers-To"]) if kind == "revisit" else None


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        task, count = TaskContext.get(), 0
        records: list[bytes] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{count}.warc.zst"
            data = archive(records)
            with system.open_output_stream(f"{base}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(records)], pa.int64()), pa.array([len(data)], pa.int64())], ["path", "records", "bytes"])

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), *(batch.column(i).to_pylist() for i in (3, 4)), strict=True):
                records.append(record(*row))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield flushed()
                    records, size, count = [], 0, count + 1
        if records:
            yield flushed()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, name = fs.FileSystem.from_uri(path)
            with system.open_input_stream(name) as source:
                data = source.read()
            rows = [d for r in read_archive(data) if (d := described(r))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            )


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) and returns the manifest (path, records, bytes).

    ``folder`` is a URI or path that all workers reach. Of pages with equal html of at least ``least_bytes`` bytes, that with the largest page_id is a response and
    the others revisit it. A null html is empty, a null url is written as ``urn:none``; a null page_id is below all others. Where the largest page_id comes
    in several rows each is a response. An empty table writes no archive.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html")))
    equal = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisit = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    typed = rows.join(equal, "digest", "left").select("page_id", "url", "html", F.when(revisit, F.col("best")).alias("refers_to"), revisit.alias("revisit"))
    return written(typed.mapInArrow(_write(folder), "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page record in the archives of a manifest.

    Payloads of responses are checked against their digests; damage is an error.
    """
    spark = manifest.sparkSession
    # Few rows, much work each: dealt out one by one.
    dealt = manifest.select("path").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages to a new folder beside the checkpoints and reads the archives back."""
    return read_archives(write_archives(pages, scratch_path(pages.sparkSession, "warc")))

"""WARC archives with per-record Zstandard frames and a dictionary of their own.

Each task writes one archive. It trains a dictionary on the first records it holds (a few megabytes at most
are kept for that), puts it into a leading skippable frame and compresses every record as a frame by
itself, so that a record can be read knowing the dictionary and its offset. Pages with equal payloads of
``LEAST_REVISIT`` bytes or more are stored once, by the smallest page id; the others are revisit records
with the HTTP header only. Only digests and ids are grouped to find what repeats; the join with that, by digest,
shuffles each payload once. Payloads that are too short to be found again, and digests that more than a
thousandth of the repeated pages have, are dealt over many tasks.

Tasks write under a name of their own attempt and report the archive in a manifest; archives that no
reported attempt wrote are never read. Readers open the manifest's archives only.

Edge cases: null html is an empty payload; payloads under ``LEAST_REVISIT`` bytes are always responses; rows
that repeat a page id with equal payloads keep one record each: the responses' id for all of them; null ids
are written as an empty id and never referred to unless all of a payload's ids are null; an empty table
gives no archive. Very long payloads are compressed one at a time.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink.llm.common import file_system, run_folder, stored
from caselink.operators.skew import heavy_keys, spread_join

LEAST_REVISIT = 100
DICTIONARY_BYTES = 32_768
TRAIN_BYTES = 1_500_000
LEVEL = 3
# Fixed values of the archive format.
_DICTIONARY_FRAME = 0x184D2A5D
_RESPONSE, _REVISIT = "response", "revisit"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
_PAGE_URI = "urn:page:"


def classified(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for a response)."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    long_enough = F.length("payload") >= LEAST_REVISIT
    repeated = (
        rows.filter(long_enough)
        .groupBy(F.col("digest").alias("_key"))
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1")
    )
    first = stored(repeated, run_folder(pages.sparkSession, "warc_digests"), "repeated")
    # Short payloads find nothing and are dealt over lanes; so are those of a digest that many pages have.
    keyed = rows.withColumns({"_key": F.when(long_enough, F.col("digest")), "_spread": F.xxhash64("page_id", "url", "digest")})
    joined = spread_join(keyed, first.drop("_n"), "_key", heavy_keys(first, "_key", "_n"), "_spread", "left")
    refers = F.when(F.col("_first") != F.coalesce(F.col("page_id"), F.col("_first") - 1), F.col("_first"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def _record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = "" if page_id is None else str(page_id)
    address = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url) or f"{_PAGE_URI}{name}"
    fields = [
        "WARC/1.1",
        f"WARC-Type: {_RESPONSE if refers_to is None else _REVISIT}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {url}')}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {address}",
        f"WARC-Page-ID: {name}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        fields += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head = "\r\n".join([*fields, f"Content-Length: {len(block)}", "", ""]).encode()
    return head + block + b"\r\n\r\n"


class ArchiveWriter:
    """Writes records to a stream: dictionary frame first, then one frame a record."""

    def __init__(self, stream):
        self._stream, self._waiting, self._held, self._compressor = stream, [], 0, None
        self.records = 0

    def add(self, record: bytes) -> None:
        self.records += 1
        if self._compressor is not None:
            self._stream.write(self._compressor.compress(record))
            return
        self._waiting.append(record)
        self._held += len(record)
        if self._held >= TRAIN_BYTES:
            self._begin()

    def _begin(self) -> None:
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, self._waiting, k=256, d=8).as_bytes()
        except zstandard.ZstdError:  # too few or too small records to train on: their own bytes are the dictionary
            trained = b"".join(self._waiting)[:DICTIONARY_BYTES]
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(trained)
        self._stream.write(struct.pack("<II", _DICTIONARY_FRAME, len(packed)) + packed)
        self._compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True)
        for record in self._waiting:
            self._stream.write(self._compressor.compress(record))
        self._waiting = []

    def close(self) -> None:
        if self._compressor is None:
            self._begin()
        self._stream.close()


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write the records of ``classified`` rows below ``folder``; returns the manifest: file, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, writer, path = TaskContext.get(), None, ""
        for batch in batches:
            for i in range(batch.num_rows):
                if writer is None:
                    system, root = file_system(f"{folder}/archives")
                    system.create_dir(root, recursive=True)
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
                    path, writer = f"{folder}/archives/{name}", ArchiveWriter(system.open_output_stream(f"{root}/{name}"))
                writer.add(_record(*(column[i].as_py() for column in batch.columns)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([writer.records], pa.int64())], ["file", "records"])

    return stored(rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "file string, records long"), folder, "manifest")


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an archive, holding one record at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != _DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary")
    dictionary = zstandard.ZstdDecompressor().decompress(stream.read(size))
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    left = b""
    while True:
        frame, parts = opener.decompressobj(), []
        while not frame.eof:
            chunk = left or stream.read(1 << 16)
            left = b""
            if not chunk:
                if parts:
                    raise ValueError("the archive ends within a record")
                return
            parts.append(frame.decompress(chunk))
            left = frame.unused_data
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; responses' digests are recomputed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                system, path = file_system(file)
                rows: list[tuple] = []
                with system.open_input_stream(path) as stream:
                    for fields, block in read_records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        said = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
                        digest, refers = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields.get("WARC-Refers-To-Page-ID")
                        if refers is None and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"a payload of {file} does not match its digest")
                        page = fields["WARC-Page-ID"]
                        rows.append((int(page) if page else None, int(said["Content-Length"]), digest, fields["WARC-Type"], int(refers) if refers else None))
                        if len(rows) >= 5000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2)
    return manifest.select("file").repartition(n, "file").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def archive_digests(pages: DataFrame) -> DataFrame:
    """Write an archive record for every page into a new shared folder and read the archives back."""
    return read_archives(write_archives(classified(pages), run_folder(pages.sparkSession, "warc")))


SQL = f"""
WITH rows AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM rows)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> first THEN first END AS refers_to
FROM firsts
"""

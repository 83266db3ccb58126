"""Operator 6, a WARC writer with dictionary compression, and its reader.

Each Spark partition writes its records as .warc.zst archives into the shared folder, a new one at ARCHIVE_BYTES of records. An
archive begins with a skippable frame that embeds a Zstandard dictionary; then every record is a frame of its own,
compressed with that dictionary. A task holds the records of one archive until it is full, so the dictionary is built
from records all over the archive (every k-th, about SAMPLE_BYTES). Where there are too few records to build one, the
archive has no leading frame and its records stand alone.

Archives get their name from the task attempt, and only those of successful tasks are in the list that is read
afterwards, so a lost executor costs no more than its tasks. Payloads that equal another of at least LEAST_BYTES
become revisits of the one with the largest id; equality is by SHA-256 and the maximum is combined before the
shuffle, so a payload with very many copies is no hot group. The narrow result is a table of its own, so that Spark
knows its size: it is broadcast below spark.sql.autoBroadcastJoinThreshold, and no page is shuffled; beyond it the
pages are joined by a shuffle (a skewed key is split by adaptive execution).

Defined cases: a null html is an empty payload. Null urls leave out the target. Rows that repeat the largest id of a
payload are all responses; a null id is a response unless a copy has an id. An empty table gives an empty result.
Columns other than id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shared_folder, written

LEAST_BYTES, ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 1000, 64 << 20, 1 << 20, 64 << 10, 3
#: Magic number of the skippable frame that holds a dictionary, and the date of the records (a parameter, for equal runs).
SKIPPABLE, DATE = b"\x5d\x2a\x4d\x18", "2024-01-01T00:00:00Z"
RESULT = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit with the HTTP head alone."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_record_id(refers_to)}", f"Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        block += payload
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """Fields of a record; the payload's size and digest come from the payload where it is there, and are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if first != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != said or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("Page-ID"), "payload_bytes": said, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("Refers-To-Page-ID"), "payload": payload if response else None, "url": fields.get("WARC-Target-URI")}


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A trained dictionary; None where there is too little to train on."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, records)) // 8)), records, k=512, d=8) if len(records) >= 8 else None
    except zstandard.ZstdError:
        return None


class Archive:
    """One .warc.zst file, written when all its records are there."""

    def __init__(self, path: str, sample_bytes: int = SAMPLE_BYTES) -> None:
        self.path, self.sample_bytes, self.records, self.held = path, sample_bytes, [], 0

    def add(self, raw: bytes) -> None:
        self.records.append(raw)
        self.held += len(raw)

    def close(self) -> tuple[str, int, int]:
        """(path, records, bytes) of the file."""
        step = max(1, min(self.held // self.sample_bytes, len(self.records) // 8))
        d = dictionary(self.records[::step])
        frames = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True, write_checksum=True)
        system, path = fs.FileSystem.from_uri(self.path)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(path) as file:
            size = 0
            if d is not None:
                raw = d.as_bytes()
                size += file.write(SKIPPABLE + len(raw).to_bytes(4, "little") + raw)
            for x in self.records:
                size += file.write(frames.compress(x))
        return self.path, len(self.records), size


def records_of(path: str, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The records of an archive, streamed: a frame at a time."""
    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_stream(at) as file:
        left, d = file.read(8), None
        if left[:4] == SKIPPABLE:
            d, left = zstandard.ZstdCompressionDict(file.read(int.from_bytes(left[4:], "little"))), b""
        context = zstandard.ZstdDecompressor(dict_data=d)
        while left := left or file.read(chunk):
            one, parts = context.decompressobj(), []
            while not one.eof:
                # small pieces, as what lies beyond the frame's end is handed back as a copy
                piece, left = left[:8192], left[8192:]
                if not piece and not (piece := file.read(chunk)):
                    raise ValueError(f"{path} ends inside a record")
                if len(piece) > 8192:
                    piece, left = piece[:8192], piece[8192:]
                parts.append(one.decompress(piece))
            left = one.unused_data + left
            yield b"".join(parts)


def revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the id of the equal payload with the largest id, null for responses."""
    sized = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("_same", F.when(F.octet_length("html") >= least_bytes, F.sha2("html", 256)))
    last = sized.filter("_same is not null").groupBy("_same").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    last = written(last, "repeated-payloads")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("_last")), F.col("_last"))
    # small payloads meet nothing; a key of their own deals them out evenly
    sized = sized.withColumn("_same", F.coalesce("_same", F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    return sized.join(last, "_same", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each page; the list of archives (path, records, bytes), itself a table."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/rankloom/warc-{uuid.uuid4().hex}"
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, archive, done = TaskContext.get(), 0, None, []
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if archive is None:
                    archive, n = Archive(f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{n:03d}.warc.zst", min(SAMPLE_BYTES, archive_bytes)), n + 1
                archive.add(record(page_id, url, html.encode(), refers_to))
                if archive.held >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path", "records", "bytes"])

    return written(revisits(pages, least_bytes).mapInArrow(run, "path string, records bigint, bytes bigint"), "archives")


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """RESULT for every record of the archives listed (and url and payload, if asked for), one archive at a time in a task."""
    columns = [x.split()[0] for x in RESULT.split(", ")] + ["url", "payload"] * payloads
    types = {"payload_digest": pa.string(), "record_type": pa.string(), "url": pa.string(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.int64())) for c in columns], names=columns)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for raw in records_of(path):
                    rows.append({k: v for k, v in parsed(raw).items() if k in columns})
                    size += len(raw)
                    if len(rows) >= 1000 or payloads and size > 8 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    schema = RESULT + ", url string, payload binary" * payloads
    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(run, schema)


def archived(pages: DataFrame) -> DataFrame:
    """RESULT of every page, from archives written and read back."""
    return read(write(pages))

"""Operator 7: WARC archives in Zstandard, one frame a record, with a dictionary in the leading skippable frame.

Layout of an archive (the public .warc.zst convention): a skippable frame (magic 0x184D2A5D) that holds the
compression dictionary, then one Zstandard frame for each record. The writer deals pages to archives inside the
task that reads them; the reader takes whole files through Spark's ``binaryFile`` source, so any store Spark reads
will do, decodes frame by frame, and checks versions, headers, lengths and digests.

Equal payloads of at least ``REVISIT_BYTES`` bytes are written once: the record with the largest page_id is the
response, the others are revisit records that refer to it. Which record that is comes from one aggregation by
digest of ids alone, joined back by digest and a salt, so that the payloads of one page's copies do not meet in one task.

Defined results. Null html: an empty payload. Null page_id: smaller than any other. Rows that share both the largest
page_id and the payload are all responses. Empty table: no archive, no rows. Extra columns are ignored. A broken
frame, header, length or digest raises ``WarcError`` and fails the job; nothing is skipped silently.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.runtime import scratch_path, ship_package

DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
REVISIT_BYTES = 1000
#: Tasks that the copies of one payload are spread over.
SALTS = 16
#: An archive is closed when its records exceed this many bytes before compression.
ARCHIVE_BYTES = 16 << 20
DICT_BYTES = 16 << 10
#: Records whose text trains an archive's dictionary, and the bytes taken of each.
DICT_RECORDS, DICT_SAMPLE = 128, 4096
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


class WarcError(ValueError):
    """An archive that breaks the format."""


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def _int(b: memoryview | bytes, at: int, n: int) -> int:
    if at + n > len(b):
        raise WarcError("archive ends inside a frame")
    return int.from_bytes(b[at : at + n], "little")


def frame_end(b: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends, found by walking its block headers (RFC 8878)."""
    if _int(b, at, 4) != FRAME_MAGIC:
        raise WarcError(f"no Zstandard frame at byte {at}")
    flags = _int(b, at + 4, 1)
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    last = 0
    while not last:
        head = _int(b, at, 3)
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        if kind == 3:
            raise WarcError("reserved block type")
        at += 3 + (1 if kind == 1 else size)
    at += 4 * (flags >> 2 & 1)
    if at > len(b):
        raise WarcError("archive ends inside a frame")
    return at


def parse_record(raw: bytes) -> Record:
    """Headers and block of one record; version, Content-Length and the closing lines are checked."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"not a WARC record: {lines[0][:40]!r}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"not a header: {line[:40]!r}")
        headers[name.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys()
    if missing:
        raise WarcError(f"missing headers: {sorted(missing)}")
    size = headers["content-length"]
    if not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("Content-Length does not match the block")
    return Record(headers, rest[:-4])


def read_archive(data: bytes) -> Iterator[Record]:
    """Records of an archive: the dictionary of the leading skippable frame, then one frame a record."""
    b = memoryview(data)
    at, dictionary = 0, None
    if len(b) >= 8 and _int(b, 0, 4) == DICT_MAGIC:
        at = 8 + _int(b, 4, 4)
        if at > len(b):
            raise WarcError("archive ends inside its dictionary")
        raw = bytes(b[8:at])
        if raw[:4] == FRAME_MAGIC.to_bytes(4, "little"):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(b):
        end = frame_end(b, at)
        try:
            raw = reader.decompressobj().decompress(b[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"broken frame at byte {at}: {e}") from e
        yield parse_record(raw)
        at = end


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/1.1 "):
        raise WarcError("the block is no HTTP response")
    pairs = (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, body


def format_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record; a revisit keeps the HTTP headers, so the full payload's length stays known, and drops the body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def build_archive(records: list[bytes]) -> bytes:
    """An archive of the records; the dictionary is trained on a bounded sample of them."""
    samples = [r[:DICT_SAMPLE] for r in records[:: max(1, len(records) // DICT_RECORDS)][:DICT_RECORDS]]
    try:
        trained = zstandard.train_dictionary(DICT_BYTES, samples) if len(samples) > 7 else None
    except zstandard.ZstdError:  # too few or too short samples to train on
        trained = None
    if trained is None:
        trained = zstandard.ZstdCompressionDict(b"".join(samples)[:DICT_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = trained.as_bytes()
    packer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
    return b"".join([DICT_MAGIC.to_bytes(4, "little"), len(raw).to_bytes(4, "little"), raw, *map(packer.compress, records)])


def _id_of(urn: str) -> int | None:
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise WarcError(f"unknown record id {urn[:60]!r}")
    return None if urn == "<urn:page:null>" else int(urn[10:-1])


def row_of(record: Record) -> dict:
    """A table row of a record; the payload's length and digest are checked against the headers."""
    h = record.headers
    http, body = http_payload(record.block)
    name, _, value = h.get("warc-payload-digest", "").partition(":")
    if name != "sha1":
        raise WarcError("no SHA-1 payload digest")
    digest, size = base64.b32decode(value).hex(), http.get("content-length", "")
    if not size.isdigit():
        raise WarcError("no HTTP Content-Length")
    if h["warc-type"] == "response":
        if len(body) != int(size) or hashlib.sha1(body).hexdigest() != digest:
            raise WarcError(f"payload of {h['warc-record-id']} does not match its length or digest")
        refers = None
    elif h["warc-type"] == "revisit":
        if body or "warc-refers-to" not in h:
            raise WarcError("a revisit record has no payload and refers to a response")
        refers = _id_of(h["warc-refers-to"])
    else:
        raise WarcError(f"unexpected record type {h['warc-type']}")
    return {"page_id": _id_of(h["warc-record-id"]), "payload_bytes": int(size), "payload_digest": digest, "record_type": h["warc-type"], "refers_to": refers, "url": h.get("warc-target-uri"), "payload": body}


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives below ``folder``; returns (path, records) of each, lazily.

    Files are named by partition and written in order of page_id under a hidden name, then moved. A repeated attempt
    makes the same files again, so a lost executor leaves neither gaps nor doubles in the folder.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    again = p.where(F.length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    refers = F.when(F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    # copies of a hot page are spread over tasks: few digests repeat, so theirs are repeated for every salt
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    marked = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(again.withColumn("salt", salts), ["digest", "salt"], "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to")).sortWithinPartitions("page_id", "digest", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        n_files = 0

        def close(records: list[bytes]) -> pa.RecordBatch:
            nonlocal n_files
            name = f"part-{TaskContext.get().partitionId():06d}-{n_files:06d}.warc.zst"
            n_files += 1
            with store.open_output_stream(f"{base}/.{name}.part") as out:
                out.write(build_archive(records))
            store.move(f"{base}/.{name}.part", f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([len(records)], pa.int64())})

        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, body, digest, refers_to = (batch.column(c)[i].as_py() for c in range(5))
                held.append(format_record(page_id, url, body, digest, refers_to, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close(held)
                    held, size = [], 0
        if held:
            yield close(held)

    return marked.mapInArrow(write, "path string, records long")


def read_archives(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Rows of every record in the archives at ``paths`` (files, folders or globs)."""
    ship_package(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "payload": pa.binary()}
        schema = pa.schema(list(types.items()))
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for record in read_archive(content.as_py()):
                    rows.append(row_of(record))
                    size += len(rows[-1]["payload"])
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(read, ROWS)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    ship_package(spark)
    folder = scratch_path(spark, "warc")
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    write_archives(pages, folder).agg(F.sum("records")).collect()
    return read_archives(spark, folder)

"""WARC archives in Zstandard: a writer of one frame per record, and a reader that checks them.

An archive starts with a skippable frame that holds its dictionary; each record is a
frame of its own, compressed with the dictionary. The reader loads the dictionary from that
frame, decodes frame by frame, and validates headers, lengths and digests. Records whose
payload an earlier page has are revisits, which carry digest and length but no payload.

Scale: which page is the response of a payload is found by digest, summed before the
exchange; texts move once, by archive. An archive is written by one task under a name
that depends on its number only, to the shared folder, then renamed; a task that
runs again writes the same file. Archives are read by Spark's binary file source.
"""

from __future__ import annotations

import hashlib
import math
import os
import struct
import uuid
from base64 import b32encode
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import by_bucket, new_path, prepare, stored

#: First magic number of the frame with the dictionary, and of a record's frame (fixed values).
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Payload bytes and pages of one archive, about; payloads shorter than this are never revisited.
ARCHIVE_BYTES, ARCHIVE_PAGES, REVISIT_BYTES = 64 << 20, 2000, 100
#: Bounds of a dictionary and of what it is trained on, out of an archive's first records.
DICTIONARY_BYTES, SAMPLES, SAMPLE_BYTES, FIRST_RECORDS, FIRST_BYTES = 16 << 10, 100, 4 << 10, 1000, 8 << 20
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    block = b"" if kind == "revisit" else payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date), ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n"


def make_dictionary(records: list[bytes]) -> bytes:
    """A trained dictionary, or raw content where there is too little to train on."""
    samples = [r[:SAMPLE_BYTES] for r in records[:: max(1, len(records) // SAMPLES)][:SAMPLES]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL, k=256, d=8).as_bytes() if len(samples) >= 10 else b"".join(samples)[:DICTIONARY_BYTES]
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def archive_parts(records: Iterable[bytes]) -> Iterator[bytes]:
    """An archive's dictionary frame and then a frame for each record; only the first records, which the dictionary is trained on, are held."""
    rest = iter(records)
    first, held = [], 0
    for r in rest:
        first.append(r)
        held += len(r)
        if len(first) >= FIRST_RECORDS or held >= FIRST_BYTES:
            break
    dictionary = make_dictionary(first)
    yield struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True, write_content_size=True)
    yield from map(packer.compress, first)
    first.clear()
    yield from map(packer.compress, rest)


def write_archive(records: Iterable[bytes]) -> bytes:
    return b"".join(archive_parts(records))


def archive_records(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one per frame."""
    if not data:
        return
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        raise WarcError("no dictionary frame at the start")
    size = struct.unpack_from("<I", data, 4)[0]
    if 8 + size > len(data):
        raise WarcError("the dictionary frame is cut short")
    raw = data[8 : 8 + size]
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):
        raw = zstandard.ZstdDecompressor().decompress(raw)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    rest = memoryview(data)[8 + size :]
    while len(rest):
        if len(rest) < 4 or struct.unpack_from("<I", rest)[0] != FRAME_MAGIC:
            raise WarcError("no frame where a record should start")
        one = unpacker.decompressobj()
        try:
            parts, at = [], 0
            while not one.eof:  # a record is a frame: feed it bit by bit, so that what follows isn't copied
                if at >= len(rest):
                    raise WarcError("a record's frame is cut short")
                piece = rest[at : at + (64 << 10)]
                parts.append(one.decompress(piece))
                at += len(piece)
        except zstandard.ZstdError as e:
            raise WarcError(f"a record's frame is damaged: {e}") from e
        rest = rest[at - len(one.unused_data) :]
        yield b"".join(parts)


#: The usual spelling of the header names that are read; names count in any case (fixed values).
_NAMES = {n.lower(): n for n in (*_NEEDED, "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To", "WARC-Profile", "X-Payload-Length", "Content-Type")}


def _digest_holds(digest: str, block: bytes) -> bool:
    """Whether a digest, algorithm:value in hexadecimal or base32, is the block's; one of an unknown algorithm can't be checked and holds."""
    algorithm, _, value = digest.partition(":")
    name = algorithm.lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha512", "md5"):
        return True
    raw = hashlib.new(name, block).digest()
    return value.lower() == raw.hex() or value.upper().rstrip("=") == b32encode(raw).decode().rstrip("=")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record whose headers, length and digest are valid."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not mark or first not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("no WARC header")
    headers = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError("a header line without a name")
        headers[_NAMES.get(name.lower(), name)] = value.strip()
    if missing := [n for n in _NEEDED if n not in headers]:
        raise WarcError(f"no {', '.join(missing)}")
    if not headers["Content-Length"].isdigit() or rest[int(headers["Content-Length"]) :] != b"\r\n\r\n":
        raise WarcError("the block's length differs from Content-Length")
    block = rest[:-4]
    kind = headers["WARC-Type"]
    if kind not in ("response", "revisit", "resource", "metadata", "warcinfo", "request"):
        raise WarcError(f"unknown type {kind}")
    if kind == "response" and not _digest_holds(headers.get("WARC-Payload-Digest", ""), block):
        raise WarcError("the payload differs from its digest")
    if kind == "revisit" and (block or "WARC-Refers-To" not in headers or "WARC-Payload-Digest" not in headers):
        raise WarcError("a revisit with a payload, or without what it refers to")
    return headers, block


#: What Spark's names of file systems are in pyarrow (fixed values).
_SCHEMES = {"s3a": "s3", "gs": "gs", "hdfs": "hdfs", "abfs": "abfss", "abfss": "abfss"}


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The folder's file system and its path there: local, s3, gs, hdfs or abfss, whichever of them pyarrow has here."""
    at = urlsplit(folder)
    if at.scheme in ("", "file"):
        return fs.LocalFileSystem(), os.path.abspath(at.path)
    return fs.FileSystem.from_uri(folder.replace(at.scheme, _SCHEMES.get(at.scheme, at.scheme), 1))


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", per_archive: int = ARCHIVE_PAGES) -> tuple[str, int]:
    """Writes a record per row to .warc.zst files in folder; returns the folder and the number of records.

    The payload is the column in UTF-8, empty for null. Of rows with equal payloads
    of at least REVISIT_BYTES, that with the smallest id is the response and the
    others, repeated rows of that id excepted, revisit it. Null ids come last; an
    empty table writes no archive; other columns, whatever their names, are not read.
    An archive is streamed: its task holds no more than the dictionary's first
    records and one batch. The
    folder is on any file system that the workers' pyarrow reaches, with its own
    credentials there; by default it is new, in the checkpoint folder.
    """
    spark = pages.sparkSession
    prepare(spark)
    folder = folder or new_path(spark, "warc")
    _opened(folder)  # a file system that isn't there is an error now, not in the tasks
    payload = F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b""))
    keys = stored(pages.select(F.col(id_col).cast("long").alias("id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes")), "digests")
    first = stored(keys.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    again = stored(keys.join(first, "digest").where("id is null or id != first").select("id", "first", "digest").distinct(), "again")
    total = keys.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    n = max(1, math.ceil(total.n / per_archive), math.ceil((total.bytes or 0) / ARCHIVE_BYTES))
    archive = F.pmod(F.xxhash64("id", "digest"), F.lit(n)).cast("int")  # rows that share an id, or have none, are dealt by their payloads
    none = F.lit(None)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), none.cast("long").alias("first"), F.sha2(payload, 256).alias("digest"), F.lit(1).alias("kind")).unionByName(again.select("id", none.cast("string").alias("url"), none.cast("binary").alias("payload"), "first", "digest", F.lit(0).alias("kind")))
    dealt = by_bucket(rows.withColumn("archive", archive), n, "archive").sortWithinPartitions("kind", F.col("id").asc_nulls_last(), "digest", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refers: dict[tuple, int] = {}
        numbers: list[int] = []

        def records() -> Iterator[bytes]:
            for b in batches:
                for i, url, data, ref, digest, kind, number in zip(*(b[c].to_pylist() for c in ("id", "url", "payload", "first", "digest", "kind", "archive")), strict=True):
                    if kind == 0:
                        refers[i, digest] = ref
                    else:
                        numbers.append(number)
                        ref = refers.get((i, digest))
                        yield record_bytes(i, url, data, digest, "response" if ref is None else "revisit", ref)

        files, path = _opened(folder)
        files.create_dir(path, recursive=True)
        part = f"{path}/{uuid.uuid4().hex}.tmp"
        with files.open_output_stream(part) as f:
            for piece in archive_parts(records()):
                f.write(piece)
        if numbers:
            files.move(part, f"{path}/part-{numbers[0]:08d}.warc.zst")
            yield pa.record_batch([pa.array([len(numbers)], pa.int64())], names=["n"])
        else:
            files.delete_file(part)

    written = dealt.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
    return folder, int(written)


READ = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType())])


def _page(name: str) -> int | None:
    x = name.removeprefix("<urn:page:").removesuffix(">")
    return int(x) if x else None


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row per record: page_id, url, payload_bytes, payload_digest (bare), record_type, refers_to, payload.

    Both payload figures are of the full payload, which a revisit itself doesn't
    hold (its payload is null). A damaged archive is an error (WarcError). A folder
    without archives gives an empty table.
    """
    prepare(spark)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(READ)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], READ)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b["content"]:
                rows: list[tuple] = []
                for record in archive_records(data.as_py()):
                    h, block = parse_record(record)
                    digest = h.get("WARC-Payload-Digest", "").removeprefix("sha256:") or hashlib.sha256(block).hexdigest()
                    revisit = h["WARC-Type"] == "revisit"
                    size = int(h.get("X-Payload-Length", len(block))) if revisit else len(block)
                    rows.append((_page(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), size, digest, h["WARC-Type"], _page(h["WARC-Refers-To"]) if revisit else None, block if payloads and not revisit else None))
                    if len(rows) == 500:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content").mapInArrow(read, READ)

"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Layout of a ``.warc.zst`` file: a skippable frame (magic ``0x184D2A5D``) that holds the file's dictionary,
then one Zstandard frame per record, each with its content size and checksum.  Records with equal payloads
are written once: the record of the largest id is the ``response``, the others are ``revisit`` records
that name it.  The reader streams a file, loads the dictionary, decodes frame by frame and validates the
skippable frame, the version line, every header, ``Content-Length`` against the block, the closing blank
lines, the HTTP header of responses and the payload digest; any mismatch raises :class:`WarcError`.

Scale: payloads are digested in the JVM; the largest id per digest is a map-side combined aggregate, so a
payload shared by a third of the pages is one small row per task.  Pages meet that table by digest (AQE
splits a hot digest; nothing is broadcast unless Spark sees that it is small).  Writers and readers
stream: a task holds one record, plus the first ``sample_bytes`` of its input from which it trains the
file's dictionary.  Files roll over at ``file_bytes`` of payload.  Lost executors: see ``files.py``.

Defined cases: a null payload is empty; payloads shorter than ``min_bytes`` are never merged; a row with
a null id is never referred to if another row has the payload; rows that repeat the largest id of their
payload are all responses; a null or blank url writes no target header; control characters, spaces and
non-ASCII bytes of a url are percent-encoded in the header; files too small to train on have an empty
dictionary frame; an empty table writes no file.  Other columns are not read.
"""
from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storewatch.llm.files import one_task_each, open_input, open_output

# Fixed values of the format.
SKIPPABLE_MAGIC = 0x184D2A5D
DICTIONARY_MAGIC = 0xEC30A437
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 16 * 1024
MANIFEST = "path string, records long, payload_bytes long"
RECORDS = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
           "refers_to long, payload binary")


class WarcError(ValueError):
    """An archive that does not follow the format."""


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _header_url(url: str) -> str:
    return "".join(chr(b) if 0x21 <= b <= 0x7E else f"%{b:02X}" for b in url.encode())


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
                  revisit: bool, date: str) -> bytes:
    """One WARC record; a response's block is an HTTP message with the payload as its body."""
    http = b"" if revisit else f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = b"" if revisit else http + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id)),
               ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"),
               ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if url is not None and url.strip():
        headers.append(("WARC-Target-URI", _header_url(url)))
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(refers_to)),
                    ("X-Refers-To-Page-Id", str(refers_to))]
    headers.append(("Content-Length", str(len(block))))
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> dict:
    """Fields of one record, everything validated."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] != VERSION:
        raise WarcError(f"no {VERSION} record: {raw[:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(": ")
        if not colon or not name or name in fields:
            raise WarcError(f"bad header line {line!r}")
        fields[name] = value
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Payload-Digest", "X-Payload-Length", "Content-Length"):
        if name not in fields:
            raise WarcError(f"header {name} is missing")
    try:
        length, full = int(fields["Content-Length"]), int(fields["X-Payload-Length"])
        page_id = int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None
    except ValueError as e:
        raise WarcError(f"bad number in a header: {e}") from None
    if length < 0 or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {length} does not match a block of {len(rest) - 4} bytes")
    scheme, _, digest = fields["WARC-Payload-Digest"].partition(":")
    if scheme != "sha1" or len(digest) != 32 or fields["WARC-Record-ID"] != _record_id(page_id):
        raise WarcError("bad digest or record id")
    out = {"page_id": page_id, "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
           "payload_bytes": full, "payload_digest": digest, "refers_to": None, "payload": None}
    if fields["WARC-Type"] == "revisit":
        if length or fields.get("WARC-Profile") != REVISIT_PROFILE or "X-Refers-To-Page-Id" not in fields:
            raise WarcError("bad revisit record")
        out["refers_to"] = int(fields["X-Refers-To-Page-Id"])
        if fields.get("WARC-Refers-To") != _record_id(out["refers_to"]):
            raise WarcError("WARC-Refers-To does not name the response")
        return out
    if fields["WARC-Type"] != "response":
        raise WarcError(f"unknown record type {fields['WARC-Type']!r}")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/1.1 ") or f"Content-Length: {full}".encode() not in http.split(b"\r\n"):
        raise WarcError("bad HTTP header")
    if len(payload) != full or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise WarcError("the payload does not match its length or digest")
    return out | {"payload": payload}


def dictionary_frame(samples: list[bytes]) -> tuple[bytes, zstandard.ZstdCompressionDict | None]:
    """Skippable frame with a dictionary trained on ``samples`` (empty when they do not suffice)."""
    raw = b""
    if len(samples) >= 8 and sum(map(len, samples)) >= 16 * DICTIONARY_BYTES:
        try:
            raw = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:  # too uniform to train on
            raw = b""
    return struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw, zstandard.ZstdCompressionDict(raw) if raw else None


class ArchiveWriter:
    """One ``.warc.zst`` file."""

    def __init__(self, folder: str, samples: list[bytes], level: int):
        self.uri, self.out = open_output(folder, ".warc.zst")
        frame, dictionary = dictionary_frame(samples)
        self.out.write(frame)
        options = {"level": level, "write_checksum": True, "write_content_size": True, "write_dict_id": True}
        self.codec = zstandard.ZstdCompressor(dict_data=dictionary, **options) if dictionary else zstandard.ZstdCompressor(**options)
        self.records = self.payload_bytes = 0

    def add(self, record: bytes, payload_bytes: int) -> None:
        self.out.write(self.codec.compress(record))
        self.records, self.payload_bytes = self.records + 1, self.payload_bytes + payload_bytes

    def close(self) -> dict:
        self.out.close()
        return {"path": self.uri, "records": self.records, "payload_bytes": self.payload_bytes}


def read_archive(stream, chunk: int = 1 << 20) -> Iterator[dict]:
    """Records of one file, one frame at a time."""
    head = stream.read(8)
    if len(head) < 8:
        raise WarcError("the file has no dictionary frame")
    magic, size = struct.unpack("<II", head)
    raw = stream.read(size)
    if magic != SKIPPABLE_MAGIC or len(raw) != size:
        raise WarcError("the leading frame is not a whole skippable frame")
    if raw and struct.unpack("<I", raw[:4])[0] != DICTIONARY_MAGIC:
        raise WarcError("the skippable frame holds no dictionary")
    codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    rest = stream.read(chunk)
    while rest:
        frame, parts = codec.decompressobj(), []
        try:
            while not frame.eof:
                if not rest and not (rest := stream.read(chunk)):
                    raise WarcError("the last frame is cut short")
                parts.append(frame.decompress(rest))
                rest = frame.unused_data if frame.eof else b""
        except zstandard.ZstdError as e:
            raise WarcError(f"bad frame: {e}") from None
        yield decode_record(b"".join(parts))
        rest = rest or stream.read(chunk)


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (binary), digest (hex) and refers_to (the response's id; null for responses)."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"),
                        F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    first = (rows.filter(F.col("size") >= min_bytes).groupBy("digest", "size")
             .agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).filter("n > 1")
             .select("digest", "size", "holder"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder"))
    return rows.join(first, ["digest", "size"], "left").select("page_id", "url", "payload", "digest",
                                                               refers.alias("refers_to"))


def write_archives(marked: DataFrame, folder: str, level: int = 3, file_bytes: int = 256 << 20,
                   sample_bytes: int = 4 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the rows of :func:`mark_revisits` to files below ``folder``; returns the manifest (lazy)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_bytes, archive = [], 0, None

        def start() -> ArchiveWriter:
            new = ArchiveWriter(folder, [r[0] for r in held if len(r[0]) > 64], level)
            for r in held:
                new.add(*r)
            held.clear()
            return new

        def manifest(row: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([row], schema=pa.schema(
                [("path", pa.string()), ("records", pa.int64()), ("payload_bytes", pa.int64())]))

        for batch in batches:
            for row in batch.to_pylist():
                digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                record = encode_record(row["page_id"], row["url"], row["payload"], digest, row["refers_to"],
                                       row["refers_to"] is not None, date)
                if archive is None:
                    held.append((record, len(row["payload"])))
                    held_bytes += len(record)
                    if held_bytes >= sample_bytes:
                        archive, held_bytes = start(), 0
                else:
                    archive.add(record, len(row["payload"]))
                if archive is not None and archive.payload_bytes >= file_bytes:
                    yield manifest(archive.close())
                    archive = None
        if held:
            archive = start()
        if archive is not None:
            yield manifest(archive.close())

    return marked.mapInArrow(write, MANIFEST)


def read_archives(manifest: DataFrame, payloads: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """All records of the files listed in ``manifest``; ``payloads=False`` validates but leaves them out."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
                        ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                rows, size, n = [], 0, 0
                with open_input(file["path"]) as stream:
                    for row in read_archive(stream):
                        n += 1
                        size += 200 + (len(row["payload"] or b"") if payloads else 0)
                        rows.append(row if payloads else row | {"payload": None})
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if n != file["records"]:
                    raise WarcError(f"{file['path']} has {n} records, its manifest says {file['records']}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return one_task_each(manifest.select("path", "records", "payload_bytes")).mapInArrow(read, RECORDS)

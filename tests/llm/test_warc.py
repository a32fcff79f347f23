"""Archives: round trip, layout on disk, validation."""
import base64
import hashlib
import io
import struct

import pytest
import zstandard

from storewatch.llm import warc
from storewatch.llm.files import open_input
from storewatch.session import cut_lineage, new_folder


def test_round_trip(spark):
    hot = "<p>hot</p>" * 50
    rows = [(i, f"http://x.org/{i}?q=ä b\n", f"<html>{i}</html>" * (i % 40 + 1)) for i in range(200)]
    rows += [(1000 + i, "http://hot", hot) for i in range(120)]
    rows += [(2000, None, None), (2001, "", ""), (2002, "u", "é" * 100_000), (2003, "u", "\r\n\r\nWARC/1.1\r\n")]
    rows += [(5, rows[5][1], rows[5][2]), (None, "n", "only null"), (None, "n", hot), (1119, "http://hot", hot)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    folder = new_folder(spark, "warc")
    manifest = cut_lineage(warc.write_archives(warc.mark_revisits(df), folder, file_bytes=20_000, sample_bytes=4_000))
    got = warc.read_archives(manifest).collect()
    holder = {}
    for i, _, h in rows:
        holder[h or ""] = max(holder.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = holder[h or ""]
        revisit = to >= 0 and to != i
        want.append((i, "revisit" if revisit else "response", len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                     to if revisit else None, None if revisit else raw))
    assert sorted([(r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to,
                    None if r.payload is None else bytes(r.payload)) for r in got], key=str) == sorted(want, key=str)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows) and manifest.count() > 1
    light = warc.read_archives(manifest, payloads=False)
    assert light.filter("payload is not null").count() == 0 and light.count() == len(rows)
    big = manifest.orderBy("path").collect()
    for r in big:                                                   # one frame per record after the dictionary frame
        raw = open_input(r.path).read()
        magic, size = struct.unpack("<II", raw[:8])
        assert magic == 0x184D2A5D
        codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8:8 + size])) if size else zstandard.ZstdDecompressor()
        rest, n = raw[8 + size:], 0
        while rest:
            frame = codec.decompressobj()
            assert frame.decompress(rest).startswith(b"WARC/1.1\r\n")
            rest, n = frame.unused_data, n + 1
        assert n == r.records


def test_min_bytes_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    marked = {r.page_id: r.refers_to for r in warc.mark_revisits(df, min_bytes=3).collect()}
    assert marked == {1: None, 2: None, 3: 4, 4: None}
    manifest = cut_lineage(warc.write_archives(warc.mark_revisits(df.limit(0)), new_folder(spark, "warc")))
    assert warc.read_archives(manifest).count() == 0


def archive(record):
    frame, _ = warc.dictionary_frame([])
    return io.BytesIO(frame + zstandard.ZstdCompressor(write_checksum=True).compress(record))


def test_validation():
    digest = base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    good = warc.encode_record(7, "http://x", b"body", digest, None, False, "2024-01-01T00:00:00Z")
    assert next(warc.read_archive(archive(good)))["payload"] == b"body"
    for bad in (good.replace(b"body", b"bodx"), good.replace(b"WARC/1.1", b"WARC/0.1"), good[:-1], good + b"x",
                good.replace(b"WARC-Date: ", b"WARC-Date"), good.replace(b"X-Payload-Length: 4", b"X-Payload-Length: 5"),
                good.replace(b"X-Page-Id: 7", b"X-Page-Id: 8"), good.replace(b"response\r\nWARC-Record", b"resource\r\nWARC-Record")):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(archive(bad)))
    whole = archive(good).getvalue()
    for raw in (b"", whole[:6], b"\0" * 8 + whole[8:], whole[:-3], whole[:8] + b"junk" + whole[8:],
                struct.pack("<II", 0x184D2A5D, 4) + b"nope" + whole[8:]):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(io.BytesIO(raw)))


def test_dictionary_is_trained_and_needed():
    samples = [f"<html><head><title>{i}</title></head><body class='page'>{'text ' * (i % 90)}{i * 7919}</body></html>".encode() * 4
               for i in range(2000)]
    frame, dictionary = warc.dictionary_frame(samples)
    assert dictionary is not None and struct.unpack("<II", frame[:8]) == (0x184D2A5D, len(frame) - 8)

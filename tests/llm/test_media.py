import gzip
import hashlib
import io
import struct
import zipfile
import zlib

import pytest

from sillage.llm import media


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "text")
    return out.getvalue()


BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\x00" + b"\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02xyz\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\nstartxref\n0\n%%EOF"
FILES = {"image/png": png(), "image/bmp": BMP, "image/gif": GIF, "image/jpeg": JPEG, "application/pdf": PDF, "application/gzip": gzip.compress(b"x" * 99), "application/zip": zipped(), "audio/wav": media.store_wav(b"\x80" * 64)}


@pytest.mark.parametrize("kind", FILES)
def test_found_whole_and_inside(kind):
    data = FILES[kind]
    assert (0, len(data), kind) in media.sniff(data)
    assert (7, len(data), kind) in media.sniff(b"..junk." + data + b"tail")
    assert not [x for x in media.sniff(data[:-1]) if x[0] == 0 and x[2] == kind]


def test_columns(spark):
    rows = [(1, FILES["image/png"], "image/gif"), (2, b"text", "text/plain"), (3, None, None), (4, b"pre" + GIF, None), (5, b"", None)]
    df = spark.createDataFrame(rows, "id int, data binary, declared string")
    got = {r["id"]: r for r in media.sniff_media(df, "data", "declared").collect()}
    assert got[1]["media_type"] == "image/png" and got[1]["type_corrected"]
    assert got[2]["media_type"] == "text/plain" and not got[2]["type_corrected"]
    assert got[3]["media_type"] == got[5]["media_type"] == "application/octet-stream"
    assert [(c["offset"], bytes(c["bytes"])) for c in got[4]["carved"]] == [(3, GIF)]


def test_text_media(spark):
    rows = [(1, "é" * 40), (2, None), (3, ""), (4, "é" * 40), (None, "RIFF WAVE BM %PDF-"), (5, "x" * 1_000_000)]
    got = {r["doc_id"]: r for r in media.text_media(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    payload = ("é" * 40).encode() + bytes(48)
    one = got[1]
    assert (one["n_bytes"], one["payload_bytes"]) == (80, 128)
    assert one["payload_sha256"] == hashlib.sha256(payload).hexdigest() and one["tail_crc32"] == zlib.crc32(payload[-64:])
    assert one["media_sha256"] == hashlib.sha256(media.store_wav(payload)).hexdigest() and one["media_bytes"] == 172
    assert one[1:] == got[4][1:] and got[2][1:] == got[3][1:] and got[2]["payload_bytes"] == 64
    assert got[None]["n_carved"] == 0 and got[5]["payload_bytes"] == 1_000_000 // 64 * 64 + 64 * bool(1_000_000 % 64)
    assert media.text_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def wav(channels, bits, samples=b"\0" * 48, junk=True, kind=1):
    align = channels * bits // 8
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, kind, channels, 44100, 44100 * align, align, bits)
    body = (b"JUNK" + struct.pack("<I", 3) + b"abc\0" if junk else b"") + fmt + b"data" + struct.pack("<I", len(samples)) + samples + b"LIST" + struct.pack("<I", 2) + b"xy"
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


@pytest.mark.parametrize("channels, bits, kind", [(1, 8, 1), (2, 16, 1), (1, 24, 1), (2, 32, 3), (6, 16, 0xFFFE)])
def test_wav_layouts(channels, bits, kind):
    data = wav(channels, bits, kind=kind)
    assert media.sniff(b"x" + data + b"RIFF") == [(1, len(data), "audio/wav")]
    assert media.sniff(data[:-1]) == [] and media.sniff(wav(channels, bits, b"\0" * 49, kind=kind)[:20]) == []
    align = channels * bits // 8
    assert media.sniff(data.replace(struct.pack("<IHH", 44100 * align, align, bits), struct.pack("<IHH", 1, align, bits))) == []


def test_pdf_with_updates():
    one = PDF + b"\n2 0 obj\nstartxref\n40\n%%EOF"
    assert media.sniff(one + b" text " + PDF) == [(0, len(one), "application/pdf"), (len(one) + 6, len(PDF), "application/pdf")]
    assert media.sniff(b"%PDF-1.4 %%EOF") == [] == media.sniff(b"%PDF-x startxref %%EOF")


def test_zip_with_marks_inside():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"PK\x05\x06" + b"\0" * 40)
        z.writestr("b", b"PK\x03\x04")
    assert (3, len(out.getvalue()), "application/zip") in media.sniff(b"abc" + out.getvalue() + b"d")


HOSTILE = {
    "pdf": b"%PDF-1 ", "zip": b"PK\x03\x04", "riff": b"RIFF", "wave": b"RIFF\xff\xff\x1f\x00WAVEJUNK\0\0\0\0", "jpeg": b"\xff\xd8\xff\xe0\x00\x08abcd",
    "jpeg segments": b"\xff\xd8\xff\xd8\x00\x02", "gif": b"GIF89a\x01\0\x01\0\0\0\0!\xf9\x09GIF89a\x01\0\x01", "bmp": b"BM", "eof": b"%PDF-1%%EOF", "ends": b"PK\x05\x06",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_in_proportion_to_the_length(name):
    """Ten times the bytes take some ten times the time, not a hundred."""
    import time

    took = []
    for n in (200_000, 2_000_000):
        data = (HOSTILE[name] * (n // len(HOSTILE[name]))) + b" startxref %%EOF"
        best = 9.0
        for _ in range(2):
            began = time.perf_counter()
            media.sniff(data)
            best = min(best, time.perf_counter() - began)
        took.append(best)
    assert took[1] < 30 * max(took[0], 0.01)


def test_sniff_edges(spark):
    empty = spark.createDataFrame([], "id int, data binary, carved string")
    assert media.sniff_media(empty).count() == 0
    big = b"x" * 3_000_000 + GIF
    df = spark.createDataFrame([(1, big, "clash"), (1, big, "clash")], "id int, data binary, media_type string")
    got = media.sniff_media(df).collect()
    assert [[(c["offset"], c["length"]) for c in r["carved"]] for r in got] == [[(3_000_000, len(GIF))]] * 2
    assert [r["media_type"] for r in got] == ["application/octet-stream"] * 2

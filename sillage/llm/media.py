"""Media columns by signature sniffing.

An Aho-Corasick automaton finds every magic string of the known formats in one pass over a value; a validator per
format then walks the structure from there (chunk lengths, checksums, end markers) and either confirms an extent or
discards the hit. The confirmed format at offset 0 corrects the declared type; confirmed extents elsewhere are carved.
Map-only: no shuffle, and a task holds one batch of rows.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 8000
#: The magic strings of the formats and the type each announces.
MAGIC = {
    b"RIFF": "audio/wav",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"BM": "image/bmp",
    b"%PDF-": "application/pdf",
    b"\x1f\x8b\x08": "application/gzip",
    b"PK\x03\x04": "application/zip",
}


#: Strings that validators look for further on; one pass finds them with the magic strings.
MARKS = (b"startxref", b"%%EOF", b"PK\x05\x06", b"\xff\xd9")
#: Sample formats of WAVE: PCM, floating point, and the extensible form of both.
WAVE_FORMATS = (1, 3, 0xFFFE)


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (len(magic), kind, None))
    for mark in MARKS:
        a.add_word(mark.decode("latin-1"), (len(mark), None, mark))
    a.make_automaton()
    return a


class Value:
    """A value with its hits and marks, and what its structures lead to: walks over chunks, segments and blocks end where an
    earlier walk has been, so all hits of a value together walk over it once."""

    def __init__(self, data: bytes, automaton: ahocorasick.Automaton | None = None):
        self.data, self.hits = data, []
        self.marks: dict[bytes, list[int]] = {m: [] for m in MARKS}
        self.pdfs: list[int] = []
        self._known: dict[str, dict[int, int | None]] = {}
        for last, (n, kind, mark) in (automaton or _automaton()).iter(data.decode("latin-1")):
            at = last - n + 1
            if mark is not None:
                self.marks[mark].append(at)
            else:
                self.hits.append((at, kind))
                if kind == "application/pdf":
                    self.pdfs.append(at)
        self.archives: dict[int, int] = {}
        for end in self.marks[b"PK\x05\x06"]:
            if end + 22 <= len(data):
                size, start, note = struct.unpack_from("<IIH", data, end + 12)
                first = end - size - start
                if first >= 0 and data[first + start : first + start + 4] == b"PK\x01\x02" and end + 22 + note <= len(data):
                    self.archives.setdefault(first, end + 22 + note)

    def follow(self, walk: str, p: int, step) -> int | None:
        """Where a walk from p on ends: step(p) is the next place, or minus the end, or None if there is none."""
        known, path, end = self._known.setdefault(walk, {}), [], None
        while p not in known:
            path.append(p)
            known[p] = None  # a walk that comes back to itself ends nowhere
            q = step(p)
            if q is None or q <= 0:
                end = None if q is None else -q
                break
            p = q
        else:
            end = known[p]
        for x in path:
            known[x] = end
        return end

    def first(self, mark: bytes, at: int) -> int | None:
        """The first place of a mark from `at` on."""
        places = self.marks[mark]
        i = bisect.bisect_left(places, at)
        return places[i] if i < len(places) else None

    def last(self, mark: bytes, at: int, before: int) -> int | None:
        """The last place of a mark from `at` on that lies before another."""
        places = self.marks[mark]
        i = bisect.bisect_left(places, before) - 1
        return places[i] if i >= 0 and places[i] >= at else None


def wav_layout(v: Value, at: int = 0) -> tuple[int, int, int] | None:
    """(end, start of the samples, their length) of the WAVE file of any PCM layout whose RIFF header is at `at`; None if it
    is malformed or cut."""
    data = v.data
    if data[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]

    def to(name: bytes):
        def step(p: int) -> int | None:
            if p + 8 > len(data):
                return None
            n = struct.unpack_from("<I", data, p + 4)[0]
            return None if p + 8 + n > len(data) else -p if data[p : p + 4] == name else p + 8 + n + n % 2

        return v.follow(f"wav {name!r}", at + 12, step)

    if end > len(data) or (fmt := to(b"fmt ")) is None or (samples := to(b"data")) is None or samples < fmt:
        return None
    n = struct.unpack_from("<I", data, samples + 4)[0]
    if struct.unpack_from("<I", data, fmt + 4)[0] < 16 or samples + 8 + n > end:
        return None
    kind, channels, rate, speed, align, bits = struct.unpack_from("<HHIIHH", data, fmt + 8)
    fine = kind in WAVE_FORMATS and channels and rate and bits in (8, 16, 24, 32, 64) and align == channels * bits // 8 and speed == rate * align
    return (end, samples + 8, n) if fine and n % align == 0 else None


def _wav(v: Value, at: int) -> int | None:
    found = wav_layout(v, at)
    return found and found[0]


def _png(v: Value, at: int) -> int | None:
    """Chunks to IEND by their lengths, then the checksums of these."""
    data = v.data

    def size(p: int) -> int:
        return struct.unpack_from(">I", data, p)[0]

    def step(p: int) -> int | None:
        if p + 12 > len(data) or p + 12 + size(p) > len(data) or not data[p + 4 : p + 8].isalpha():
            return None
        return -(p + 12 + size(p)) if data[p + 4 : p + 8] == b"IEND" else p + 12 + size(p)

    p = at + 8
    if data[p + 4 : p + 8] != b"IHDR" or size(p) != 13 or (end := v.follow("png", p, step)) is None:
        return None

    def sound(p: int) -> int | None:
        body = data[p + 4 : p + 8 + size(p)]
        if zlib.crc32(body) != size(p + 8 + size(p)):
            return None
        return -(p + 12 + size(p)) if body[:4] == b"IEND" else p + 12 + size(p)

    return end if v.follow("png checksums", p, sound) == end else None


def _gif(v: Value, at: int) -> int | None:
    data, n = v.data, len(v.data)

    def table(p: int) -> int:
        return 3 << (data[p] & 7) + 1 if data[p] & 128 else 0

    def part(p: int) -> int | None:
        """From one data sub-block to the next; the empty one ends them."""
        return None if p >= n else p + 1 + data[p] if data[p] else -(p + 1)

    def step(p: int) -> int | None:
        if p >= n or data[p] not in (0x3B, 0x21, 0x2C) or data[p] == 0x2C and p + 9 >= n:
            return None
        if data[p] == 0x3B:
            return -(p + 1)
        return v.follow("gif blocks", p + 2 if data[p] == 0x21 else p + 11 + table(p + 9), part)

    return v.follow("gif", at + 13 + table(at + 10), step) if at + 13 < n else None


def _jpeg(v: Value, at: int) -> int | None:
    data = v.data

    def step(p: int) -> int | None:
        if p + 4 > len(data) or data[p] != 0xFF:
            return None
        n = struct.unpack_from(">H", data, p + 2)[0]
        if n < 2:
            return None
        if data[p + 1] == 0xDA:
            end = v.first(b"\xff\xd9", p + 2 + n)
            return None if end is None else -(end + 2)
        return p + 2 + n

    return v.follow("jpeg", at + 2, step)


def _bmp(v: Value, at: int) -> int | None:
    if at + 30 > len(v.data):
        return None
    total, zero, start, header = struct.unpack_from("<IIII", v.data, at + 2)
    planes, bits = struct.unpack_from("<HH", v.data, at + 26)
    fine = zero == 0 and header >= 40 and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 54 <= start <= total
    return at + total if fine and at + total <= len(v.data) else None


def _pdf(v: Value, at: int) -> int | None:
    """To the last end marker before the next file of the kind, so updates that were appended belong to it."""
    if not v.data[at + 5 : at + 6].isdigit():
        return None
    i = bisect.bisect_right(v.pdfs, at)
    end = v.last(b"%%EOF", at, v.pdfs[i] if i < len(v.pdfs) else len(v.data))
    return None if end is None or v.last(b"startxref", at, end) is None else end + 5


def _gzip(v: Value, at: int) -> int | None:
    """A hit is inflated for as long as it is sound, so hits within hits are read more than once."""
    data = v.data
    d, p = zlib.decompressobj(31), at
    try:
        while p < len(data) and not d.eof:  # by pieces: what is inflated is dropped at once
            d.decompress(data[p : p + 65536], 1 << 20)
            while d.unconsumed_tail:
                d.decompress(d.unconsumed_tail, 1 << 20)
            p += 65536
    except zlib.error:
        return None
    return min(p, len(data)) - len(d.unused_data) if d.eof else None


def _zip(v: Value, at: int) -> int | None:
    """To the end record whose directory says that the archive begins here."""
    return v.archives.get(at)


VALIDATORS = {
    "audio/wav": _wav, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp,
    "application/pdf": _pdf, "application/gzip": _gzip, "application/zip": _zip,
}


def sniff(data: bytes, automaton: ahocorasick.Automaton | None = None) -> list[tuple[int, int, str]]:
    """Confirmed (offset, length, type), by offset; media may lie inside other media. The time is in proportion to the
    length of the value, but for gzip streams that begin inside others."""
    return _confirmed(Value(data, automaton))


def _confirmed(v: Value) -> list[tuple[int, int, str]]:
    found = []
    for at, kind in v.hits:
        if (end := VALIDATORS[kind](v, at)) is not None:
            found.append((at, end - at, kind))
    return sorted(found)


def sniff_media(df: DataFrame, data: str = "data", declared: str | None = None) -> DataFrame:
    """df's rows with media_type (confirmed at offset 0, else the declared type, else application/octet-stream),
    type_corrected (a declared type was wrong) and carved: array of (offset, length, type, bytes) found further in.

    Null data: media_type is the declared one, carved is empty. Of types confirmed at offset 0 the first by length counts.
    Rows that repeat stay, further columns too; columns of these names are replaced; very long values are read in one pass,
    as one piece; an empty table gives no rows.
    """
    kept = df.select([c for c in df.columns if c not in ("media_type", "type_corrected", "carved")])
    schema = (
        ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
        + ", media_type string, type_corrected boolean,"
        " carved array<struct<offset: bigint, length: bigint, type: string, bytes: binary>>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for b in batches:
            kinds, fixed, carved = [], [], []
            said = b.column(declared).to_pylist() if declared else [None] * b.num_rows
            for x, was in zip(b.column(data), said, strict=True):
                value = x.as_py()
                hits = sniff(value, automaton) if value else []
                kind = next((k for at, _, k in hits if at == 0), was or "application/octet-stream")
                kinds.append(kind)
                fixed.append(was is not None and kind != was)
                carved.append(
                    [{"offset": at, "length": n, "type": k, "bytes": value[at : at + n]} for at, n, k in hits if at]
                )
            inner = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("bytes", pa.binary())])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(kinds, pa.string()), pa.array(fixed, pa.bool_()), pa.array(carved, pa.list_(inner))],
                names=[*b.schema.names, "media_type", "type_corrected", "carved"],
            )

    return kept.mapInArrow(run, schema)


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def store_wav(payload: bytes) -> bytes:
    """8-bit mono PCM holding the payload as its samples."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVE" + fmt + b"data" + struct.pack("<I", len(payload)) + payload


def features(samples: bytes) -> dict[str, float]:
    """Of 8-bit samples around 128: mean, root mean square, peak, share of sign changes. Exact integer sums."""
    x = np.frombuffer(samples, np.uint8).astype(np.int16) - 128
    n = len(x)
    return {
        "mean": int(x.sum(dtype=np.int64)) / n,
        "rms": (int(np.square(x, dtype=np.int32).sum(dtype=np.int64)) / n) ** 0.5,
        "peak": int(np.abs(x).max()),
        "zcr": int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))) / n,
    }


def text_media(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to the digests of its stored form: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, media_type, n_carved.

    The payload and every feature come from the bytes read back through the sniffer, not from the text. Null and
    empty texts give 64 zero bytes; rows that repeat give equal rows, there are no ties; texts are whole however long (a value
    in a row is less than 2 GB); further columns are ignored; an empty table gives no rows.
    """
    schema = (
        "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint,"
        " media_bytes bigint, media_sha256 string, feature string, media_type string, n_carved bigint"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = text.as_py()
                n = len((raw or "").encode())
                media = store_wav(payload_of(raw))
                value = Value(media, automaton)
                hits = _confirmed(value)
                kind = next(k for at, _, k in hits if at == 0)
                _, start, length = wav_layout(value)
                back = media[start : start + length]
                f = features(back)
                feature = f"{kind} n={length} mean={f['mean']:.6f} rms={f['rms']:.6f} peak={f['peak']} zcr={f['zcr']:.6f}"
                out.append((
                    doc_id, n, length, hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media),
                    hashlib.sha256(media).hexdigest(), feature, kind, len(hits) - 1,
                ))
            names = [x.split()[0] for x in schema.split(", ")]
            kinds = [pa.string() if x.endswith("string") else pa.int64() for x in schema.split(", ")]
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)

"""Media columns: signature sniffing with validation, type correction and carving.

An Aho-Corasick automaton over the magic byte strings of the known formats finds every place at
which one may begin, in one pass over a value's bytes. At each place the format's validator walks
the structure (chunk lengths, checksums, terminators) and either returns the true extent or
refuses, so that magic bytes which occur by chance in other data count for nothing. The extent at
offset 0 gives the value's type, whatever type was declared; valid extents further in are
embedded media, which are carved out unless they lie within an earlier extent of the same value.

``store_text`` writes a payload as an 8-bit mono WAVE file, one byte a sample, ``read_samples``
gets the samples back from any valid WAVE file. Null values count as empty: no type, nothing
embedded. Rows are mapped one to one, so repeated rows and null ids are harmless; only the named
columns are read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm.common import arrow_map, table, utf8_rows

UNIT = 192
RATE = 8_000
DECLARED = "application/octet-stream"


class Marks:
    """What validators share about one value, so that many false starts cost no scan or walk each.

    Closing marks are looked for once a kind. ``walk`` remembers where every step of a structure's
    chain ends up, so a later start inside a walked chain, valid or refused, takes that result.
    """

    def __init__(self, data: bytes):
        self.data = data
        self.found: dict[bytes, list[int]] = {}
        self.ends: dict[tuple, int | None] = {}
        self.archives: dict[int, int] | None = None
        self.steps: dict[str, Callable] = {}

    def walk(self, step: Callable[[bytes, int], tuple[int | None, bool]], place: int) -> int | None:
        """Follow ``step`` (next place or None, and whether it is the end) from ``place`` to the end of its chain."""
        path: list[tuple] = []
        end: int | None = None
        while True:
            if (key := (step, place)) in self.ends:
                end = self.ends[key]
                break
            path.append(key)
            after, last = step(self.data, place)
            if after is None or last:
                end = after
                break
            place = after
        for key in path:
            self.ends[key] = end
        return end

    def own(self, name: str, step: Callable) -> Callable:
        """The first step function given under this name: one that uses these marks is made anew at each start."""
        return self.steps.setdefault(name, step)

    def places(self, mark: bytes) -> list[int]:
        if mark not in self.found:
            self.found[mark] = [m.start() for m in re.finditer(re.escape(mark), self.data)]
        return self.found[mark]

    def next(self, mark: bytes, at: int) -> int:
        """The first place of ``mark`` from ``at`` on, or -1."""
        places = self.places(mark)
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1


Validator = Callable[[bytes, int, Marks], int | None]

# Validators: data and the offset of the magic bytes, to the end of the structure or None.


def png_end(data: bytes, at: int, marks: Marks) -> int | None:
    """Chunks with right checksums from IHDR to IEND."""
    place, first = at + 8, True
    while place + 12 <= len(data):
        length = int.from_bytes(data[place : place + 4], "big")
        kind, end = data[place + 4 : place + 8], place + 12 + length
        if end > len(data) or first and kind != b"IHDR" or zlib.crc32(data[place + 4 : end - 4]) != int.from_bytes(data[end - 4 : end], "big"):
            return None
        if kind == b"IEND":
            return end
        place, first = end, False
    return None


def riff_end(form: bytes, needed: tuple[bytes, ...]) -> Validator:
    """A RIFF file of the given form whose chunks fill its length and include one of those needed."""

    def validate(data: bytes, at: int, marks: Marks) -> int | None:
        if at + 12 > len(data) or data[at + 8 : at + 12] != form:
            return None
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        if end > len(data):
            return None
        place, found = at + 12, False
        while place + 8 <= end:
            found |= data[place : place + 4] in needed
            length = int.from_bytes(data[place + 4 : place + 8], "little")
            place += 8 + length + length % 2
        return end if found and place == end else None

    return validate


def _gif_data(data: bytes, place: int) -> tuple[int | None, bool]:
    """A data sub-block; the empty one ends the chain."""
    if place >= len(data):
        return None, True
    return place + 1 + data[place], not data[place]


def gif_end(data: bytes, at: int, marks: Marks) -> int | None:
    """Screen descriptor, blocks of known kinds, trailer."""

    def block(data: bytes, place: int) -> tuple[int | None, bool]:
        kind = data[place] if place < len(data) else None
        if kind == 0x3B:
            return place + 1, True
        if kind == 0x21:
            return marks.walk(_gif_data, place + 2), False
        if kind == 0x2C and place + 11 <= len(data):
            flags = data[place + 9]
            return marks.walk(_gif_data, place + 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)), False
        return None, True

    if at + 13 > len(data):
        return None
    packed = data[at + 10]
    return marks.walk(marks.own("gif", block), at + 13 + (3 << ((packed & 7) + 1) if packed & 0x80 else 0))


def _jpeg_segment(data: bytes, place: int) -> tuple[int | None, bool]:
    """A segment by its length, a scan with the entropy-coded data after it; the end marker ends the chain."""
    if place + 4 > len(data) or data[place] != 0xFF:
        return None, True
    marker = data[place + 1]
    if marker == 0x01 or 0xD0 <= marker < 0xD8:
        return place + 2, False
    length = int.from_bytes(data[place + 2 : place + 4], "big")
    if length < 2 or marker < 0xC0:
        return None, True
    place += 2 + length
    while marker == 0xDA:
        place = data.find(b"\xff", place)
        if place < 0 or place + 1 >= len(data):
            return None, True
        after = data[place + 1]
        if after == 0xD9:
            return place + 2, True
        if after and not 0xD0 <= after <= 0xD7:
            break
        place += 2
    return place, False


def _jpeg_before_scan(data: bytes, place: int) -> tuple[int | None, bool]:
    """The same up to a frame header, which must come before any scan; the chain ends at that header."""
    if place + 2 <= len(data) and data[place + 1] in (0xC0, 0xC1, 0xC2, 0xC3, 0xDA):
        return (place if data[place] == 0xFF and data[place + 1] != 0xDA else None), True
    return _jpeg_segment(data, place)


def jpeg_end(data: bytes, at: int, marks: Marks) -> int | None:
    """Segments by their lengths up to a frame header and scans, then entropy-coded data to the end marker."""
    frame = marks.walk(_jpeg_before_scan, at + 2)
    return marks.walk(_jpeg_segment, frame) if frame is not None else None


def bmp_end(data: bytes, at: int, marks: Marks) -> int | None:
    """Header sizes, pixel offset, dimensions and depth that agree with the file length."""
    if at + 54 > len(data):
        return None
    size, _, offset, header, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", data, at + 2)
    if header not in (40, 52, 56, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return None
    if not 14 + header <= offset <= size or at + size > len(data):
        return None
    raw = (width * depth + 31) // 32 * 4 * abs(height)
    compressed = struct.unpack_from("<I", data, at + 30)[0]
    return at + size if compressed or offset + raw <= size else None


def pdf_end(data: bytes, at: int, marks: Marks) -> int | None:
    """A version line, and the last end mark before the next file's header that has a cross-reference pointer into the file before it.

    The last, as linearized and updated files have several.
    """
    if not re.match(rb"%PDF-\d\.\d[\r\n]", data[at : at + 9]):
        return None
    ends, starts, after = marks.places(b"%%EOF"), marks.places(b"startxref"), marks.next(b"%PDF-", at + 1)
    for k in range(bisect_left(ends, after if after >= 0 else len(data)) - 1, -1, -1):
        end = ends[k]
        if end < at:
            break
        near = bisect_left(starts, end) - 1
        if near < 0 or starts[near] < at or end - starts[near] > 64:
            continue
        pointer = data[starts[near] + 9 : end].strip()
        if pointer.isdigit() and int(pointer) <= starts[near] - at:
            return end + 5
    return None


def zip_end(data: bytes, at: int, marks: Marks) -> int | None:
    """Local entries up to a central directory whose end record counts them and places it at this start."""
    if marks.archives is None:
        marks.archives = {}
        for end in marks.places(b"PK\x05\x06"):
            if end + 22 > len(data):
                continue
            entries, length, offset, comment = struct.unpack_from("<HIIH", data, end + 10)
            directory = end - length
            if directory >= offset and end + 22 + comment <= len(data) and (not entries or data[directory : directory + 4] == b"PK\x01\x02"):
                marks.archives.setdefault(directory - offset, end + 22 + comment)
    return marks.archives.get(at)


def gzip_end(data: bytes, at: int, marks: Marks) -> int | None:
    """A deflate stream that unpacks, with the right checksum and length after it."""
    if at + 18 > len(data) or data[at + 3] & 0xE0:
        return None
    stream = zlib.decompressobj(31)
    try:
        place = at
        while not stream.eof and place < len(data):
            stream.decompress(data[place : place + 65_536])
            place += 65_536
            while stream.unconsumed_tail:
                stream.decompress(stream.unconsumed_tail)
    except zlib.error:
        return None
    return min(place, len(data)) - len(stream.unused_data) if stream.eof else None


def crc_table(polynomial: int, width: int) -> list[int]:
    """Remainders of all bytes, highest bit first."""
    out, top, mask = [], 1 << (width - 1), (1 << width) - 1
    for byte in range(256):
        value = byte << (width - 8)
        for _ in range(8):
            value = (value << 1 ^ (polynomial if value & top else 0)) & mask
        out.append(value)
    return out


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)


def _flac_header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """Number of the frame (or of its first sample), number of the next, and length of a frame's header whose checksum is right."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8 or data[at + 3] & 1:
        return None
    size, rate, lead = data[at + 2] >> 4, data[at + 2] & 15, data[at + 4]
    if size == 0 or rate == 15 or data[at + 3] >> 4 > 10 or 0x80 <= lead < 0xC0 or lead == 0xFF:
        return None
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    number = lead if not more else lead & (0x3F >> more)
    for byte in data[at + 5 : at + 5 + more]:
        if byte & 0xC0 != 0x80:
            return None
        number = number << 6 | byte & 0x3F
    place = at + 5 + more
    wide = 1 if size == 6 else 2 if size == 7 else 0
    samples = int.from_bytes(data[place : place + wide], "big") + 1 if wide else 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    place += wide + (1 if rate == 12 else 2 if rate in (13, 14) else 0)
    check = 0
    for byte in data[at:place]:
        check = CRC8[check ^ byte]
    if place >= len(data) or data[place] != check:
        return None
    return number, number + (samples if data[at + 1] & 1 else 1), place + 1 - at


def _flac_frame(data: bytes, place: int, limit: int) -> tuple[int | None, bool]:
    """A frame up to the next one of its stream, by both headers and its own checksum; the last one up to ``limit`` or the first place at which its checksum is right."""
    head = _flac_header(data, place)
    if head is None:
        return None, True
    check, last = 0, None
    for k in range(place, limit):
        # A checksum of all bytes, the stored checksum among them, is 0 at a frame's end.
        if not check and k >= place + head[2] + 3:
            after = _flac_header(data, k)
            if after is not None and after[0] == head[1]:
                return k, False
            last = k if last is None else last
        check = (check << 8 & 0xFFFF) ^ CRC16[check >> 8 ^ data[k]]
    return (limit if not check else last), True


def flac_end(data: bytes, at: int, marks: Marks) -> int | None:
    """Metadata blocks by their lengths, a stream description first, then frames one after another, up to the next stream's magic bytes."""

    def frame(data: bytes, place: int) -> tuple[int | None, bool]:
        after = marks.next(b"fLaC", place)
        return _flac_frame(data, place, after if after >= 0 else len(data))

    place, first = at + 4, True
    while place + 4 <= len(data):
        kind, length = data[place] & 0x7F, int.from_bytes(data[place + 1 : place + 4], "big")
        if first and (kind, length) != (0, 34):
            return None
        done, place, first = data[place] & 0x80, place + 4 + length, False
        if done:
            return marks.walk(marks.own("flac", frame), place)
    return None


def _ogg_page(data: bytes, place: int) -> tuple[int | None, bool]:
    """A page by its segment table; one that is marked last ends the chain."""
    if data[place : place + 4] != b"OggS" or place + 27 > len(data) or data[place + 4]:
        return None, True
    table_end = place + 27 + data[place + 26]
    end = table_end + sum(data[place + 27 : table_end])
    return (end, bool(data[place + 5] & 4)) if end <= len(data) else (None, True)


def ogg_end(data: bytes, at: int, marks: Marks) -> int | None:
    """Pages one after another by their segment tables, from one that is marked first to one that is marked last."""
    return marks.walk(_ogg_page, at) if data[at + 5 : at + 6] in (b"\x02", b"\x06") else None


def isobmff_end(data: bytes, at: int, marks: Marks) -> int | None:
    """Boxes by their lengths from the file type on, of the kinds that stand at a file's top, with a movie or a picture's description among them.

    The extent ends before the first thing that is no such box.
    """
    place, found = at, False
    while place + 8 <= len(data):
        length, kind = int.from_bytes(data[place : place + 4], "big"), data[place + 4 : place + 8]
        if kind not in BOXES or (kind == b"ftyp") != (place == at):
            break
        if length == 1 and place + 16 <= len(data):
            length = int.from_bytes(data[place + 8 : place + 16], "big")
        if length < 8 or place + length > len(data):
            break
        found |= kind in (b"moov", b"meta")
        place += length
    return place if found else None


def _varint(data: bytes, place: int) -> tuple[int, int] | None:
    """Value and end of a length whose first byte tells how many bytes it has; None if it is cut or says "unknown"."""
    if place >= len(data) or not data[place]:
        return None
    size = 9 - data[place].bit_length()
    value = int.from_bytes(data[place : place + size], "big") & ((1 << 7 * size) - 1)
    return (value, place + size) if place + size <= len(data) and value != (1 << 7 * size) - 1 else None


def ebml_end(data: bytes, at: int, marks: Marks) -> int | None:
    """A header that names its document type, and the segment after it by its length."""
    head = _varint(data, at + 4)
    if head is None or head[0] > 4096 or b"\x42\x82" not in data[head[1] : head[1] + head[0]]:
        return None
    segment = head[1] + head[0]
    size = _varint(data, segment + 4) if data[segment : segment + 4] == b"\x18\x53\x80\x67" else None
    return size[1] + size[0] if size and size[1] + size[0] <= len(data) else None


#: The published magic bytes of each format, its type and its validator.
FORMATS: tuple[tuple[bytes, str, Validator], ...] = (
    (b"\x89PNG\r\n\x1a\n", "image/png", png_end),
    (b"\xff\xd8\xff", "image/jpeg", jpeg_end),
    (b"GIF87a", "image/gif", gif_end),
    (b"GIF89a", "image/gif", gif_end),
    (b"BM", "image/bmp", bmp_end),
    (b"RIFF", "image/webp", riff_end(b"WEBP", (b"VP8 ", b"VP8L", b"VP8X"))),
    (b"RIFF", "audio/wav", riff_end(b"WAVE", (b"data",))),
    (b"RIFF", "video/x-msvideo", riff_end(b"AVI ", (b"LIST",))),
    (b"fLaC", "audio/flac", flac_end),
    (b"OggS", "audio/ogg", ogg_end),
    (b"%PDF-", "application/pdf", pdf_end),
    (b"PK\x03\x04", "application/zip", zip_end),
    (b"\x1f\x8b\x08", "application/gzip", gzip_end),
    (b"\x1a\x45\xdf\xa3", "video/x-matroska", ebml_end),
    (b"ftyp", "video/mp4", isobmff_end),
)
#: Bytes of a structure before its magic bytes, and the boxes at the top of an ISO media file.
BEFORE = {b"ftyp": 4}
BOXES = frozenset((b"ftyp", b"moov", b"mdat", b"free", b"skip", b"meta", b"moof", b"mfra", b"sidx", b"styp", b"uuid", b"wide", b"pdin", b"prft", b"emsg"))


def automaton() -> ahocorasick.Automaton:
    """Magic bytes, as the text of the same code points, to their place in ``FORMATS``."""
    found = ahocorasick.Automaton()
    for magic in {f[0] for f in FORMATS}:
        found.add_word(magic.decode("latin-1"), (len(magic) + BEFORE.get(magic, 0), [k for k, f in enumerate(FORMATS) if f[0] == magic]))
    found.make_automaton()
    return found


MAGIC = automaton()


def extents(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, type) of the valid medium at offset 0, if there is one, and of those further in that lie in no other of these."""
    found, end, marks = [], 0, Marks(data)
    for last, (length, formats) in MAGIC.iter(data.decode("latin-1")):
        start = last - length + 1
        if start < 0 or 0 < start < end:
            continue
        for k in formats:
            stop = FORMATS[k][2](data, start, marks)
            if stop is not None:
                found.append((start, stop, FORMATS[k][1]))
                end = stop if start else 0
                break
    return found


def sniff(data: bytes, declared: str | None = None) -> dict:
    """True type, whether the declared one was wrong, and the media embedded in the value.

    Bytes after a valid structure do not change the type. A value that begins with none has the
    type it was declared as, if that is no type that ``FORMATS`` could have confirmed.
    """
    found = extents(data)
    known = {f[1] for f in FORMATS}
    whole = next((x for x in found if x[0] == 0), None)
    true = whole[2] if whole else (declared if declared and declared not in known else DECLARED)
    carved = [(start, stop - start, kind) for start, stop, kind in found if start]
    return {"type": true, "corrected": declared is not None and true != declared, "length": whole[1] if whole else len(data), "embedded": carved}


def store_text(payload: bytes) -> bytes:
    """The payload as an 8-bit mono WAVE file, one byte a sample; an odd one gets the pad byte that the format asks for."""
    size = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size + size % 2, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", size)
    return head + payload + b"\0" * (size % 2)


def read_samples(data: bytes) -> bytes:
    """The samples of a valid WAVE file at offset 0: the content of its data chunk."""
    end = riff_end(b"WAVE", (b"data",))(data, 0, Marks(data))
    if end is None:
        raise ValueError("no valid WAVE file")
    place = 12
    while data[place : place + 4] != b"data":
        length = int.from_bytes(data[place + 4 : place + 8], "little")
        place += 8 + length + length % 2
    return data[place + 8 : place + 8 + int.from_bytes(data[place + 4 : place + 8], "little")]


def padded(raw: bytes, unit: int = UNIT) -> bytes:
    """Spaces appended up to a positive multiple of ``unit``."""
    return raw + b" " * ((-len(raw)) % unit if raw else unit)


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, declared and media: each text as a medium whose declared type says nothing."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, media = [], []
        for raw in utf8_rows(batch.column(1)):
            sizes.append(len(raw))
            media.append(store_text(padded(raw)))
        return pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array([DECLARED] * len(media)), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "declared", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(id_col, F.col(text_col).alias("text")), kernel, f"{id_col} {kind}, n_bytes long, declared string, media binary")


EMBEDDED = "array<struct<offset:bigint,length:bigint,type:string>>"


def sniff_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """``id_col``, type, corrected, length and embedded of each value of ``media_col``."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sniff(m.as_py() or b"", d.as_py()) for m, d in zip(batch.column(1), batch.column(2), strict=True)]
        embedded = [[dict(zip(("offset", "length", "type"), x, strict=True)) for x in f["embedded"]] for f in found]
        kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))
        return pa.record_batch(
            [batch.column(0), *[pa.array([f[k] for f in found], t) for k, t in (("type", pa.string()), ("corrected", pa.bool_()), ("length", pa.int64()))], pa.array(embedded, kind)],
            names=[id_col, "type", "corrected", "length", "embedded"],
        )

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(id_col, media_col, declared_col), kernel, f"{id_col} {kind}, type string, corrected boolean, length long, embedded {EMBEDDED}")


def carve(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """One row for each embedded medium: ``id_col``, offset, type and its bytes."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for k, (m, d) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
            data = m.as_py() or b""
            rows += [(k, offset, kind, data[offset : offset + length]) for offset, length, kind in sniff(data, d.as_py())["embedded"]]
        return pa.record_batch(
            [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *[pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.string()), (3, pa.binary()))]],
            names=[id_col, "offset", "type", "carved"],
        )

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(id_col, media_col, declared_col), kernel, f"{id_col} {kind}, offset long, type string, carved binary")


def media_digests(stored: DataFrame) -> DataFrame:
    """Digests of each stored medium and of the payload read back from it, and what sniffing found."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {n: [] for n in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for media, declared in zip(batch.column(2), batch.column(3), strict=True):
            data = media.as_py()
            found = sniff(data, declared.as_py())
            payload = read_samples(data)
            feature = f"{found['type']};corrected={int(found['corrected'])};length={found['length']};embedded=" + ",".join(f"{k}@{o}+{n}" for o, n, k in found["embedded"])
            row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature)
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.record_batch([batch.column(0), batch.column(1), *[pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]], names=["doc_id", "n_bytes", *out])

    kind = stored.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return arrow_map(stored.select("doc_id", "n_bytes", "media", "declared"), kernel, schema)


def op2_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(store_texts(table(spark, sf_dir, "documents")))

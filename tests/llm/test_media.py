import gzip
import io
import struct
import time
import zipfile
import zlib

from cellgrid.llm import media


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "b" * 50)
    return out.getvalue()


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00;"
PDF = b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF"


def test_carving_finds_only_valid_structures():
    parts = [png(), archive(), gzip.compress(b"hello" * 1000), media.store_text(b"abc" * 64), GIF, PDF]
    data = b"junk BM GIF89a RIFF %PDF-1 "
    wanted = []
    for part in parts:
        wanted.append((len(data), len(part)))
        data += part + b"--"
    found = media.sniff(data)["embedded"]
    assert [(o, n) for o, n, _ in found] == wanted
    assert [k for *_, k in found] == ["image/png", "application/zip", "application/gzip", "audio/wav", "image/gif", "application/pdf"]


def test_damage_is_refused_and_types_are_corrected():
    assert media.sniff(png(), "image/jpeg") == {"type": "image/png", "corrected": True, "length": 67, "embedded": []}
    broken = png().replace(b"IDAT", b"IDAX")
    assert media.sniff(broken, "image/png")["type"] == media.DECLARED
    assert media.sniff(b"plain", "text/plain")["type"] == "text/plain"
    assert media.sniff(b"", None) == {"type": media.DECLARED, "corrected": False, "length": 0, "embedded": []}
    assert media.sniff(png()[:-1])["type"] == media.DECLARED


def test_media_inside_a_medium_are_carved():
    outer = media.store_text(media.padded(b"x" * 10 + GIF))
    assert media.sniff(outer, "audio/wav")["embedded"] == [(54, len(GIF), "image/gif")]


def test_samples_round_trip():
    for raw in (b"", b"a", b" " * 192, b"b" * 193, bytes(range(256))):
        payload = media.padded(raw)
        assert len(payload) % 192 == 0 and payload and payload.rstrip(b" ") == raw.rstrip(b" ")
        assert media.read_samples(media.store_text(payload)) == payload
    assert media.read_samples(media.store_text(b"odd")) == b"odd"


def test_query_on_edge_rows(spark):
    text = "BM GIF89a " * 30_000
    rows = [(1, "x"), (1, "x"), (None, "é"), (3, None), (4, ""), (5, text)]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, media string")
    got = {(r.doc_id, r.n_bytes): r for r in media.media_digests(media.store_texts(frame)).collect()}
    assert set(got) == {(1, 1), (None, 2), (3, 0), (4, 0), (5, len(text))}
    assert got[3, 0].payload_sha256 == got[4, 0].payload_sha256 and got[3, 0].payload_bytes == 192
    assert got[1, 1].tail_crc32 == zlib.crc32(b" " * 16)
    assert media.media_digests(media.store_texts(frame.limit(0))).count() == 0
    stored = media.store_texts(frame)
    assert {r.type for r in media.sniff_media(stored).collect()} == {"audio/wav"}
    assert media.carve(stored).count() == 0


def timed(work):
    began = time.time()
    work()
    return time.time() - began


def test_many_false_starts_take_linear_time():
    page = b"OggS\0\x02" + b"\0" * 20 + b"\1\1x"
    chain = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x21\xfe\x02ab\0"
    for piece in (page, chain, b"\xff\xd8\xff\xe0\0\x02", b"\xff\xd8\xff\xc0\0\x02\xff\xda\0\x02", b"%PDF-1.4\nstartxref\n9\n", b"PK\x03\x04PK\x05\x06" + b"\0" * 18, b"RIFF\x04\0\0\0WAVE", b"\0\0\0\x08ftyp"):
        data = piece * (1_000_000 // len(piece))
        assert timed(lambda: media.extents(data)) < 5, piece  # noqa: B023


def test_updated_documents_and_stored_archives_are_whole():
    updated = PDF + b"\n2 0 obj\nstartxref\n40\n%%EOF"
    inner, out = archive(), io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("inner.zip", inner)
    data = b"--" + updated + b"--" + out.getvalue() + b"--" + PDF
    assert [(o, n) for o, n, _ in media.sniff(data)["embedded"]] == [(2, len(updated)), (4 + len(updated), len(out.getvalue())), (6 + len(updated) + len(out.getvalue()), len(PDF))]


def test_boxes_and_matroska():
    box = lambda kind, body: struct.pack(">I", 8 + len(body)) + kind + body
    mp4 = box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", b"m" * 30) + box(b"mdat", b"d" * 50)
    mkv = b"\x1a\x45\xdf\xa3\x84\x42\x82\x81w" + b"\x18\x53\x80\x67\x85hello"
    found = media.sniff(b"xx" + mp4 + b"junk" + mkv + b"--" + box(b"ftyp", b"isom") + b"ftyp")["embedded"]
    assert found == [(2, len(mp4), "video/mp4"), (6 + len(mp4), len(mkv), "video/x-matroska")]
    assert media.sniff(mp4[:-1])["length"] == len(mp4) - 58


def test_jpeg_needs_a_frame_before_its_scan():
    segment = lambda m, n: b"\xff" + bytes([m]) + struct.pack(">H", n + 2) + b"\1" * n
    good = b"\xff\xd8" + segment(0xE0, 14) + segment(0xC0, 9) + segment(0xDA, 6) + b"ab\xff\0cd\xff\xd0ef" + segment(0xDA, 6) + b"gh\xff\xd9"
    assert media.sniff(b"--" + good + b"tail")["embedded"] == [(2, len(good), "image/jpeg")]
    assert media.sniff(good.replace(b"\xff\xc0", b"\xff\xe1"))["type"] == media.DECLARED


def flac(frames, tail=0):
    """A stream of frames of 16 equal samples, with metadata."""
    def check(table, width, data):
        value = 0
        for byte in data:
            value = (value << 8 & (1 << width) - 1) ^ table[value >> (width - 8) ^ byte] if width > 8 else table[value ^ byte]
        return value

    out = b"fLaC" + b"\x00" + (34).to_bytes(3, "big") + b"\0" * 34 + b"\x81" + (5).to_bytes(3, "big") + b"notes"
    for k in range(frames):
        number = bytes([k]) if k < 128 else bytes([0xC0 | k >> 6, 0x80 | k & 63])
        head = b"\xff\xf8\x69\x08" + number + bytes([15])
        head += bytes([check(media.CRC8, 8, head)])
        body = head + b"\x00" + struct.pack(">h", 300 - k)
        out += body + check(media.CRC16, 16, body).to_bytes(2, "big")
    return out


def test_flac_ends_with_its_last_frame():
    for frames in (1, 3, 200):
        whole = flac(frames)
        assert media.sniff(whole) == {"type": "audio/flac", "corrected": False, "length": len(whole), "embedded": []}
        assert media.sniff(b"--" + whole + b"--" + GIF)["embedded"][0] == (2, len(whole), "audio/flac")
    broken = bytearray(flac(3))
    broken[-1] ^= 1
    assert media.sniff(bytes(broken))["length"] < len(broken) or media.sniff(bytes(broken))["type"] == media.DECLARED
    assert media.sniff(b"fLaC" + b"\0" * 100)["type"] == media.DECLARED
    one = flac(1)
    for piece in (flac(0) + b"\xff\xf8", one, one[:-1] + b"\0", flac(3)):
        assert timed(lambda: media.extents(piece * (300_000 // len(piece)))) < 5, piece  # noqa: B023
    assert [n for _, n, _ in media.sniff(b"-" + one * 5)["embedded"]] == [len(one)] * 5

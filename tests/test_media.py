import gzip
import io
import random
import struct
import zipfile
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedimenta.functions import bytesafe, media


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


PNG = media.PNG_MAGIC + chunk(b"IHDR", b"\0" * 13) + chunk(b"IDAT", zlib.compress(b"x" * 999)) + chunk(b"IEND", b"")


def zipped(method=zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr("a.txt", "hello " * 100)
    return out.getvalue()


def box(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I4s", 8 + len(data), kind) + data


def tiff(date: bytes, tag: int = 0x9003) -> bytes:
    ifd = struct.pack("<H", 1) + struct.pack("<HHII", 0x8769, 4, 1, 26) + struct.pack("<I", 0)
    exif = struct.pack("<H", 1) + struct.pack("<HHII", tag, 2, 20, 44) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", 8) + ifd + exif + date


JPEG = b"\xff\xd8\xff\xe1" + struct.pack(">H", 2 + 6 + 64) + b"Exif\0\0" + tiff(b"2020:02:03 04:05:06\0") + b"\xff\xda\x00\x04ab" + b"picture\xff\x00data" + b"\xff\xd9"


def pdf(data: bytes) -> bytes:
    return b"%PDF-1.4\n1 0 obj << /Length " + str(len(data)).encode() + b" /Filter /FlateDecode >>\nstream\n" + data + b"\nendstream endobj\n%%EOF"


def test_containers():
    assert media.verify_bytes(PNG)[0] == "proven"
    assert media.verify_bytes(PNG[:60] + bytes([PNG[60] ^ 1]) + PNG[61:])[0] == "damaged"
    assert media.verify_bytes(PNG[:-8])[0] == "damaged"
    g = gzip.compress(b"text" * 500)
    assert media.verify_bytes(g)[0] == "proven" and media.verify_bytes(g[:-5])[0] == "damaged"
    assert media.verify_bytes(g[:-8] + b"\0\0\0\0" + g[-4:])[0] == "damaged"
    z = zipped()
    assert media.verify_bytes(z)[0] == "proven" and media.verify_bytes(zipped(zipfile.ZIP_BZIP2))[0] == "unproven"
    assert media.verify_bytes(z[:45] + bytes([z[45] ^ 255]) + z[46:])[0] == "damaged"
    assert media.verify_bytes(JPEG)[0] == "unproven" and media.verify_bytes(JPEG[:-2])[0] == "damaged"
    assert media.verify_bytes(JPEG + b"trailing")[0] == "unproven"
    flate = zlib.compress(b"page " * 99)
    assert media.verify_bytes(pdf(flate))[0] == "proven" and media.verify_bytes(pdf(flate[:-1] + b"\0"))[0] == "damaged"
    assert media.verify_bytes(pdf(flate).replace(b"%%EOF", b""))[0] == "damaged"
    assert media.verify_bytes(pdf(flate) + b" /Encrypt %%EOF")[0] == "unproven"
    mov = box(b"ftyp", b"qt  ") + box(b"mdat", b"x" * 50)
    assert media.verify_bytes(mov)[0] == "unproven" and media.verify_bytes(mov[:-1])[0] == "damaged"
    assert media.verify_bytes(b"anything") == ("unproven", "") == media.verify_bytes(None)


def test_compare():
    rng = random.Random(1)
    a = bytes(rng.randrange(1, 256) for _ in range(4096))
    assert media.compare_bytes(a, a)["kind"] == "same"
    assert media.compare_bytes(a, a[:9] + bytes([a[9] ^ 4]) + a[10:]) == {"kind": "bitflip", "side": "", "first": 9, "bytes": 1, "bits": 1}
    assert media.compare_bytes(a, a[:2048] + bytes(2048)) | {"bits": 0} == {"kind": "tail", "side": "b", "first": 2048, "bytes": 2048, "bits": 0}
    assert media.compare_bytes(a[:100] + bytes(600) + a[700:], a)["kind"] == "zeros"
    assert media.compare_bytes(a, a[:100] + bytes(511) + a[611:])["kind"] == "mixed"
    assert media.compare_bytes(a, a[::-1])["kind"] == "mixed"


def test_dates():
    assert media.captured(JPEG, "jpg") == "2020-02-03 04:05:06"
    assert media.captured(tiff(b"1969:01:01 00:00:00\0"), "TIFF") == "" and media.captured(tiff(b"2011:01:02 03:04:05\0", 0x0132), "TIF") == "2011-01-02 03:04:05"
    seconds = 3_000_000_000
    mov = box(b"ftyp", b"qt  ") + box(b"moov", box(b"mvhd", struct.pack(">IIIII", 0, seconds, 0, 1000, 0)))
    assert media.captured(mov, "MOV") == "1999-01-24 05:20:00"
    keys = box(b"keys", struct.pack(">II", 0, 1) + box(b"mdta", b"com.apple.quicktime.creationdate"))
    ilst = box(b"ilst", struct.pack(">II", 8 + 8 + 8 + 25, 1) + box(b"data", struct.pack(">II", 1, 0) + b"2022-05-06T07:08:09+0200\0"))
    mov = box(b"moov", box(b"meta", keys + ilst))
    assert media.captured(mov, "MP4") == "2022-05-06 07:08:09"
    payload = struct.pack(">I", 0) + tiff(b"2018:09:10 11:12:13\0")
    infe = box(b"infe", struct.pack(">IHH4sB", 2 << 24, 7, 0, b"Exif", 0))
    iinf = box(b"iinf", struct.pack(">IH", 0, 1) + infe)

    def heic(at: int) -> bytes:
        iloc = box(b"iloc", struct.pack(">IBBHHHHII", 0, 0x44, 0, 1, 7, 0, 1, at, len(payload)))
        return box(b"ftyp", b"heic") + box(b"meta", struct.pack(">I", 0) + iinf + iloc) + box(b"mdat", payload)

    assert media.captured(heic(len(heic(0)) - len(payload)), "HEIC") == "2018-09-10 11:12:13"


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([PNG, gzip.compress(b"q" * 99), zipped(), JPEG, pdf(zlib.compress(b"z" * 99)), box(b"ftyp", b"isom")]), st.lists(st.tuples(st.integers(0, 2000), st.integers(0, 255)), max_size=6), st.integers(0, 2000))
def test_no_damage_crashes(data, edits, cut):
    raw = bytearray(data)
    for at, b in edits:
        raw[at % len(raw)] = b
    assert media.verify_bytes(bytes(raw[: max(1, cut)]))[0] in ("proven", "unproven", "damaged")
    for ext in ("jpg", "tiff", "heic", "mov"):
        media.captured(bytes(raw), ext)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40) | st.sampled_from([chr(0x10FE80).encode(), b"\xff" + chr(0x10FEFF).encode(), "é".encode()]))
def test_byte_names_round_trip(raw):
    assert bytesafe.unescape(bytesafe.escape(raw)) == raw


def test_media_udfs(spark):
    df = spark.createDataFrame([(bytearray(PNG), bytearray(PNG[:-1] + b"\0"), "png", bytearray(b"a\xff"))], "a binary, b binary, ext string, name binary")
    row = df.select(media.verify_content("a").alias("v"), media.compare_content("a", "b").alias("c"), media.captured_date(F.lit(bytearray(JPEG)), F.lit("JPG")).alias("d"), bytesafe.display_name("name").alias("n")).first()
    assert row["v"]["state"] == "proven" and row["c"]["bytes"] == 1 and row["d"].startswith("2020") and bytesafe.unescape(row["n"]) == b"a\xff"

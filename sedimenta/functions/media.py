"""What file content itself proves: container checks, differences, and dates of capture.

Everything here takes bytes and runs inside Arrow-batched UDFs, on the few
rows that a set or a page has left.
"""

from __future__ import annotations

import gzip
import io
import re
import struct
import zipfile
import zlib
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bounds of the checks, and the least run of zeros that tells which side is damaged.
INFLATE_MOST = 8 << 30
ZIP_ENTRIES_MOST = 262_144
ZERO_RUN = 512
EXIF_WINDOW = 256 << 10
IFD_ENTRIES_MOST = 512
# EXIF tags of dates, best first, and where the EXIF directory is found.
DATE_TAGS = (0x9003, 0x9004, 0x0132)
EXIF_POINTER = 0x8769
YEARS = range(1971, 2101)

PROVEN, UNPROVEN, DAMAGED = "proven", "unproven", "damaged"
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def _png(data: bytes) -> tuple[str, str]:
    at, kinds = len(PNG_MAGIC), []
    while at < len(data):
        if at + 12 > len(data):
            return DAMAGED, "a PNG chunk is cut short"
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        end = at + 8 + size
        if end + 4 > len(data):
            return DAMAGED, "a PNG chunk is cut short"
        if zlib.crc32(data[at + 4 : end]) != struct.unpack_from(">I", data, end)[0]:
            return DAMAGED, f"the checksum of PNG chunk {kind.decode('latin-1')} is wrong"
        kinds.append(kind)
        at = end + 4
        if kind == b"IEND":
            return (PROVEN, "") if kinds[0] == b"IHDR" else (UNPROVEN, "")
    return DAMAGED, "the PNG has no end"


def _inflate(data: bytes, wbits: int) -> tuple[bool, int]:
    """(stream is whole and its checksum right, bytes of input it took)."""
    d, made = zlib.decompressobj(wbits), 0
    view, at = memoryview(data), 0
    try:
        while not d.eof:
            piece = d.unconsumed_tail or view[at : at + 65536]
            if not len(piece):
                return False, at
            if not d.unconsumed_tail:
                at += len(piece)
            made += len(d.decompress(piece, 1 << 20))
            if made > INFLATE_MOST:
                return True, at
    except zlib.error:
        return False, at
    return True, at - len(d.unused_data)


def _gzip(data: bytes) -> tuple[str, str]:
    try:
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
            made = 0
            while piece := f.read(1 << 20):
                made += len(piece)
                if made > INFLATE_MOST:
                    return UNPROVEN, ""
    except gzip.BadGzipFile as e:
        return (DAMAGED, "the gzip checksum is wrong") if "CRC" in str(e) or "length" in str(e) else (UNPROVEN, "")
    except EOFError:
        return DAMAGED, "the gzip stream is cut short"
    except zlib.error:
        return DAMAGED, "the gzip stream cannot be unpacked"
    return PROVEN, ""


def _zip(data: bytes) -> tuple[str, str]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = z.infolist()
            if not infos or len(infos) > ZIP_ENTRIES_MOST:
                return UNPROVEN, ""
            if any(i.flag_bits & 1 or i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) for i in infos):
                return UNPROVEN, ""
            if sum(i.file_size for i in infos) > INFLATE_MOST:
                return UNPROVEN, ""
            for info in infos:
                try:
                    with z.open(info) as f:
                        while f.read(1 << 20):
                            pass
                except (zipfile.BadZipFile, zlib.error, EOFError, OSError):
                    return DAMAGED, f"ZIP member {info.filename} does not match its checksum"
    except (zipfile.BadZipFile, NotImplementedError, ValueError, struct.error):
        return UNPROVEN, ""
    return PROVEN, ""


def _jpeg(data: bytes) -> tuple[str, str]:
    """Segment framing only: no picture decoder is at hand, so a JPEG can be convicted but not proven."""
    at, scan = 2, False
    while at < len(data):
        if scan:
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                return DAMAGED, "the JPEG ends inside its picture"
            if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
                at += 2
                continue
        if data[at] != 0xFF:
            return DAMAGED, "a JPEG segment does not begin where the one before ends"
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            break
        marker, at = data[at], at + 1
        if marker == 0xD9:
            return UNPROVEN, ""
        if 0xD0 <= marker <= 0xD8 or marker == 0x01:
            continue
        if at + 2 > len(data):
            break
        (size,) = struct.unpack_from(">H", data, at)
        if size < 2 or at + size > len(data):
            return DAMAGED, "a JPEG segment is cut short"
        scan, at = marker == 0xDA, at + size
    return DAMAGED, "the JPEG has no end"


_STREAM = re.compile(rb"<<((?:[^<>]|<(?!<)|>(?!>)|<<(?:[^<>]|<(?!<)|>(?!>))*>>)*)>>\s*stream\r?\n")


def _pdf(data: bytes) -> tuple[str, str]:
    if b"%%EOF" not in data[-65_536:]:
        return DAMAGED, "the PDF has no end mark"
    if b"/Encrypt" in data:
        return UNPROVEN, ""
    checked, open_ = 0, False
    for head in _STREAM.finditer(data):
        about, body = head[1], head.end()
        filters = re.findall(rb"/(FlateDecode|DCTDecode|[A-Z][A-Za-z0-9]*Decode)\b", about)
        length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", about)
        end = body + int(length[1]) if length else data.find(b"endstream", body)
        if end < body or end > len(data):
            open_ = True
            continue
        if filters == [b"FlateDecode"]:
            if not _inflate(data[body:end], zlib.MAX_WBITS)[0]:
                return DAMAGED, "a compressed stream of the PDF does not match its checksum"
            checked += 1
        elif filters == [b"DCTDecode"]:
            state, why = _jpeg(data[body:end].rstrip(b"\r\n"))
            if state == DAMAGED:
                return DAMAGED, "a picture in the PDF is damaged: " + why
            open_ = True
        else:
            open_ = True
    return (PROVEN, "") if checked and not open_ else (UNPROVEN, "")


def _bmff(data: bytes) -> tuple[str, str]:
    """Boxes must tile the file exactly; that alone proves nothing."""
    at = 0
    while at < len(data):
        if at + 8 > len(data):
            return DAMAGED, "the last box is cut short"
        size, head = struct.unpack_from(">I", data, at)[0], 8
        if size == 1:
            if at + 16 > len(data):
                return DAMAGED, "a box is cut short"
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        if size == 0:
            return UNPROVEN, ""
        if size < head or at + size > len(data):
            return DAMAGED, "a box runs beyond the end of the file"
        at += size
    return UNPROVEN, ""


def verify_bytes(data: bytes | None) -> tuple[str, str]:
    """(proven, unproven or damaged; why) of whole content, by its magic and never by its name."""
    data = bytes(data or b"")
    if data.startswith(PNG_MAGIC):
        return _png(data)
    if data[:3] == b"\x1f\x8b\x08":
        return _gzip(data)
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return _zip(data)
    if data[:3] == b"\xff\xd8\xff":
        return _jpeg(data)
    if data[:5] == b"%PDF-":
        return _pdf(data)
    if data[4:8] == b"ftyp":
        return _bmff(data)
    return UNPROVEN, ""


def compare_bytes(a: bytes | None, b: bytes | None) -> dict:
    """How two contents of equal size differ: kind (same, bitflip, zeros, tail, mixed), side, first, bytes, bits."""
    x, y = (np.frombuffer(bytes(v or b""), dtype=np.uint8) for v in (a, b))
    if len(x) != len(y):
        return {"kind": "mixed", "side": "", "first": min(len(x), len(y)), "bytes": abs(len(x) - len(y)), "bits": 0}
    at = np.flatnonzero(x != y)
    if not len(at):
        return {"kind": "same", "side": "", "first": -1, "bytes": 0, "bits": 0}
    bits = int(np.bitwise_count(x[at] ^ y[at]).sum())
    out = {"kind": "mixed", "side": "", "first": int(at[0]), "bytes": len(at), "bits": bits}
    if len(at) <= 8 and bits <= 2:
        return out | {"kind": "bitflip"}
    blank = [not v[at].any() for v in (x, y)]
    if blank[0] != blank[1] and len(at) >= ZERO_RUN:
        return out | {"kind": "tail" if at[-1] == len(x) - 1 else "zeros", "side": "a" if blank[0] else "b"}
    return out


def format_bytes(n: float) -> str:
    if n <= 0:
        return "0 B"
    if n < 1024:
        return f"{n:.0f} B"
    for unit in ("KB", "MB", "GB", "TB"):
        n /= 1024
        if n < 1024 or unit == "TB":
            return f"{n:.0f} {unit}" if n >= 100 else f"{n:.1f} {unit}" if n >= 10 else f"{n:.2f} {unit}"
    raise AssertionError


def describe_difference(shape: dict) -> str:
    first = f"byte {shape['first']}"
    return {
        "same": "the contents are equal",
        "bitflip": f"{shape['bits']} flipped bit(s) at {first}",
        "zeros": f"{format_bytes(shape['bytes'])} are zero from {first} on where the other copy has data",
        "tail": f"everything from {first} on is zero where the other copy has data",
        "mixed": f"{format_bytes(shape['bytes'])} differ from {first} on",
    }[shape["kind"]]


def _date(text: bytes | str) -> str:
    text = text.decode("latin-1") if isinstance(text, bytes) else text
    m = re.match(r"(\d{4})[:-](\d\d)[:-](\d\d)[ T](\d\d):(\d\d):(\d\d)", text)
    if not m:
        return ""
    try:
        when = datetime(*map(int, m.groups()))
    except ValueError:
        return ""
    return when.strftime("%Y-%m-%d %H:%M:%S") if when.year in YEARS else ""


def tiff_date(tiff: bytes) -> str:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return ""

    def directory(at: int) -> dict[int, tuple[int, int]]:
        if at + 2 > len(tiff):
            return {}
        (n,) = struct.unpack_from(order + "H", tiff, at)
        found = {}
        for i in range(min(n, IFD_ENTRIES_MOST)):
            entry = at + 2 + 12 * i
            if entry + 12 > len(tiff):
                break
            tag, _, count, value = struct.unpack_from(order + "HHII", tiff, entry)
            found[tag] = (count, value)
        return found

    tags = directory(struct.unpack_from(order + "I", tiff, 4)[0])
    if EXIF_POINTER in tags:
        tags = tags | {t: v for t, v in directory(tags[EXIF_POINTER][1]).items() if t not in tags}
    for tag in DATE_TAGS:
        if tag in tags:
            count, at = tags[tag]
            if found := _date(tiff[at : at + min(count, 32)]):
                return found
    return ""


def _jpeg_date(data: bytes) -> str:
    data, at = data[:EXIF_WINDOW], 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, (size,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return tiff_date(data[at + 10 : at + 2 + size])
        if marker == 0xDA:
            break
        at += 2 + size
    return ""


def _boxes(data: bytes, start: int = 0, end: int | None = None):
    at, end = start, len(data) if end is None else end
    while at + 8 <= end:
        size, kind, head = *struct.unpack_from(">I4s", data, at), 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = end - at if size == 0 else size
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def _box(data: bytes, path: tuple[bytes, ...], start: int = 0, end: int | None = None):
    for kind, a, b in _boxes(data, start, end):
        if kind == path[0]:
            if len(path) == 1:
                return a, b
            return _box(data, path[1:], a, b)
    return None


def _heif_date(data: bytes) -> str:
    meta = _box(data, (b"meta",))
    if meta is None:
        return ""
    a, b = meta[0] + 4, meta[1]
    info, place = _box(data, (b"iinf",), a, b), _box(data, (b"iloc",), a, b)
    if info is None or place is None:
        return ""
    at = info[0] + 4 + (2 if data[info[0]] == 0 else 4)
    item = None
    for kind, x, _ in _boxes(data, at, info[1]):
        version = data[x]
        wide = 4 if version == 3 else 2
        if kind == b"infe" and version >= 2 and data[x + 4 + wide + 2 : x + 4 + wide + 6] == b"Exif":
            item = int.from_bytes(data[x + 4 : x + 4 + wide], "big")
    if item is None:
        return ""
    at = place[0]
    version, at = data[at], at + 4
    off_n, len_n, base_n, idx_n = data[at] >> 4, data[at] & 15, data[at + 1] >> 4, data[at + 1] & 15 if version else 0
    at += 2
    wide = 4 if version == 2 else 2
    many, at = int.from_bytes(data[at : at + wide], "big"), at + wide
    for _ in range(many):
        own, at = int.from_bytes(data[at : at + wide], "big"), at + wide + (2 if version else 0) + 2
        base, at = int.from_bytes(data[at : at + base_n], "big"), at + base_n
        extents, at = int.from_bytes(data[at : at + 2], "big"), at + 2
        payload = b""
        for _ in range(extents):
            at += idx_n
            off, at = int.from_bytes(data[at : at + off_n], "big"), at + off_n
            size, at = int.from_bytes(data[at : at + len_n], "big"), at + len_n
            if own == item and len(payload) + size <= 1 << 20:
                payload += data[base + off : base + off + size]
        if own == item and len(payload) > 4:
            return tiff_date(payload[4 + int.from_bytes(payload[:4], "big") :])
    return ""


def _quicktime_date(data: bytes) -> str:
    moov = _box(data, (b"moov",))
    if moov is None:
        return ""
    if meta := _box(data, (b"meta",), *moov):
        keys, values = _box(data, (b"keys",), *meta), _box(data, (b"ilst",), *meta)
        if keys and values:
            names = [data[a:b] for _, a, b in _boxes(data, keys[0] + 8, keys[1])]
            for kind, a, b in _boxes(data, *values):
                at = int.from_bytes(kind, "big") - 1
                if 0 <= at < len(names) and names[at] == b"com.apple.quicktime.creationdate" and (box := _box(data, (b"data",), a, b)):
                    if found := _date(data[box[0] + 8 : box[1]]):
                        return found
    head = _box(data, (b"mvhd",), *moov)
    if head is None:
        return ""
    seconds = struct.unpack_from(">Q" if data[head[0]] else ">I", data, head[0] + 4)[0]
    if not seconds or seconds > 1 << 40:
        return ""
    when = datetime(1904, 1, 1) + timedelta(seconds=seconds)
    return when.strftime("%Y-%m-%d %H:%M:%S") if when.year in YEARS else ""


def captured(data: bytes | None, ext: str | None) -> str:
    """Date of capture by the kind that the extension names; empty if there is none."""
    data, ext = bytes(data or b""), (ext or "").upper()
    try:
        if ext in ("JPG", "JPEG"):
            return _jpeg_date(data)
        if ext in ("TIF", "TIFF", "NEF", "CR2", "ARW", "DNG"):
            return tiff_date(data[:EXIF_WINDOW])
        if ext in ("HEIC", "HEIF", "AVIF"):
            return _heif_date(data)
        if ext in ("MOV", "MP4", "M4V"):
            return _quicktime_date(data)
    except (struct.error, IndexError):
        pass
    return ""


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("state", "why")]))
def verify_content(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([verify_bytes(c) for c in content], columns=["state", "why"])


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "side")] + [T.StructField(n, T.LongType()) for n in ("first", "bytes", "bits")]))
def compare_content(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([compare_bytes(x, y) for x, y in zip(a, b, strict=True)], columns=["kind", "side", "first", "bytes", "bits"])


@F.pandas_udf(T.StringType())
def captured_date(content: pd.Series, ext: pd.Series) -> pd.Series:
    return pd.Series([captured(c, e) for c, e in zip(content, ext, strict=True)])

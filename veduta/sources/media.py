"""Media bytes to header facts: one Python boundary per byte stage, Arrow in and out, never raising on damaged input."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import containers, exif
from .containers import synchsafe

#: kbit/s by index for MPEG-1 and MPEG-2/2.5 layer III, and Hz by version and index.
BITRATES = {3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0)}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
FIELDS = (
    "format string, width long, height long, bpp long, alpha int, lossless int, duration_seconds double, channel_count long, pages long, estimated_pages long, "
    "rotation int, orientation int, thumb_offset long, thumb_size long, source_width long, source_height long, arithmetic boolean"
)
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def png(b: bytes) -> dict | None:
    if not b.startswith(b"\x89PNG\r\n\x1a\n") or b[12:16] != b"IHDR" or len(b) < 26:
        return None
    w, h, depth, colour = struct.unpack(">IIBB", b[16:26])
    return {"format": "png", "width": w, "height": h, "bpp": depth * {0: 1, 2: 3, 3: 3, 4: 1, 6: 3}.get(colour, 3), "alpha": int(colour in (4, 6)), "lossless": 1}


def gif(b: bytes) -> dict | None:
    if b[:6] not in (b"GIF87a", b"GIF89a") or len(b) < 10:
        return None
    w, h = struct.unpack("<HH", b[6:10])
    return {"format": "gif", "width": w, "height": h, "bpp": 24, "alpha": 1, "lossless": 1}


def bmp(b: bytes) -> dict | None:
    if b[:2] != b"BM" or len(b) < 30:
        return None
    w, h, _, bits = struct.unpack("<iiHH", b[18:30])
    return {"format": "bmp", "width": w, "height": abs(h), "bpp": min(bits, 24), "alpha": int(bits == 32), "lossless": 1}


def jpeg(b: bytes) -> dict | None:
    """Frame size from the first start-of-frame before the scan, or the first one anywhere; whether the coding is arithmetic."""
    if b[:2] != b"\xff\xd8":
        return None
    out: dict = {"format": "jpeg", "arithmetic": False}
    for mark, at, end in exif.jpeg_segments(b):
        if mark in (0xC0, 0xC1, 0xC2) and at + 6 <= end:
            depth, h, w, parts = struct.unpack(">BHHB", b[at : at + 6])
            return out | {"width": w, "height": h, "bpp": depth * parts, "alpha": 0, "lossless": 0}
        if mark in (0xC9, 0xCA):
            out["arithmetic"] = True
    return out


def jpeg_app_end(b: bytes) -> int | None:
    """Where the application segments of a JPEG end: its first table, frame or scan."""
    return next((at - 4 for mark, at, _ in exif.jpeg_segments(b) if mark in (0xC0, 0xC1, 0xC2, 0xC4, 0xDA, 0xDB)), None)


def find_frame(b: bytes) -> tuple[int, int, int] | None:
    """(width, height, bits a pixel) of the first frame header with an area, wherever it stands."""
    for found in re.finditer(rb"\xff[\xc0-\xc2]..(.)(..)(..)(.)", b, re.S):
        h, w = (int.from_bytes(found[i], "big") for i in (2, 3))
        if w and h:
            return w, h, found[4][0] * found[1][0]
    return None


def tiff(b: bytes) -> dict | None:
    try:
        found = exif.Tiff(b)
    except ValueError:
        return None
    size = found.size() or (None, None)
    return {"format": "tiff", "width": size[0], "height": size[1], "lossless": 1}


def ico(b: bytes) -> dict | None:
    """The first of the icon's pictures; a side of 0 is 256."""
    if b[:4] != b"\0\0\1\0" or len(b) < 22 or not b[4]:
        return None
    return {"format": "ico", "width": b[6] or 256, "height": b[7] or 256, "bpp": 24, "alpha": 1, "lossless": 1}


def webp(b: bytes) -> dict | None:
    if b[:4] != b"RIFF" or b[8:12] != b"WEBP" or len(b) < 30:
        return None
    kind = b[12:16]
    if kind == b"VP8X":
        w, h = 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little")
    elif kind == b"VP8L":
        bits = int.from_bytes(b[21:25], "little")
        w, h = 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    else:
        w, h = (x & 0x3FFF for x in struct.unpack("<HH", b[26:30]))
    return {"format": "webp", "width": w, "height": h, "lossless": int(kind == b"VP8L")}


def webp_size(code: Column) -> Column:
    """(width, height) of a WebP file's hex, by kind, or null."""
    byte = lambda at: F.conv(F.substring(code, 2 * at + 1, 2), 16, 10).cast("long")
    number = lambda at, size: sum((byte(at + i) * (1 << 8 * i) for i in range(1, size)), byte(at))
    sides = lambda w, h, least: F.when((w > least) & (h > least), F.struct(w.alias("width"), h.alias("height")))
    bits = number(21, 4)
    kind = F.substring(code, 25, 8)
    return F.when((F.substring(code, 1, 8) == "52494646") & (F.substring(code, 17, 8) == "57454250"), F.coalesce(
        F.when(kind == "56503820", sides(number(26, 2) % 16384, number(28, 2) % 16384, 0)),
        F.when(kind == "5650384C", sides(bits % 16384 + 1, F.floor(bits / 16384) % 16384 + 1, 1)),
        F.when(kind == "56503858", sides(number(24, 3) + 1, number(27, 3) + 1, 1)),
    ))


def mp3(b: bytes) -> dict | None:
    """Duration from the bit rate of the first layer III frame in the 2 KiB after any ID3v2 tag, over the bytes after the tag."""
    tagged = b[:3] == b"ID3" and len(b) >= 10
    start = 10 + synchsafe(b[6:10]) if tagged else 0
    for found in re.finditer(rb"\xff(?=[\xe0-\xff])", b[start : start + 2048] if tagged else b[:1]):
        head = int.from_bytes(b[start + found.start() : start + found.start() + 4].ljust(4, b"\0"), "big")
        version, layer, index, rate = head >> 19 & 3, head >> 17 & 3, head >> 12 & 15, head >> 10 & 3
        kbit = BITRATES[3 if version == 3 else 2][index]
        if layer == 1 and version != 1 and rate != 3 and kbit:
            return {"format": "mp3", "channel_count": 1 if head >> 6 & 3 == 3 else 2, "duration_seconds": (len(b) - start) * 8 / (kbit * 1000)}
    return {"format": "mp3"} if tagged or b[:2] == b"\xff\xfb" else None


def pdf(b: bytes) -> dict | None:
    """Pages are page objects, those in object streams included."""
    if not b.startswith(b"%PDF-"):
        return None
    return {"format": "pdf", "pages": containers.pdf_document(b).get("pages")}


def zipped(b: bytes) -> dict | None:
    if b[:4] != b"PK\x03\x04":
        return None
    try:
        names = set(containers.Zip(b).entries)
    except ValueError:
        return {"format": "zip"}
    kinds = (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx"), ("content.xml", "odt"))
    kind = next((k for name, k in kinds if name in names), "zip")
    return {"format": kind} | {k: v for k, v in containers.zip_document(b).items() if k != "preview"}


#: Boxes that hold other boxes.
_HOLDERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"meta", b"iinf", b"ipco", b"iprp", b"dinf"))


def heif(b: bytes) -> dict | None:
    """Rotation from an ``irot`` property, found by walking the boxes down meta, iprp and ipco."""
    if b[4:8] != b"ftyp":
        return None

    def walk(at: int, end: int, depth: int) -> int | None:
        while at + 8 <= end and depth < 8:
            size, kind = struct.unpack(">I4s", b[at : at + 8])
            stop = end if size == 0 else at + size
            if size == 1 or (size and size < 8) or stop > end:
                return None
            if kind == b"irot" and at + 9 <= end:
                return {1: 270, 2: 180, 3: 90}.get(b[at + 8] & 3, 0)
            full = 4 * (kind in (b"meta", b"iinf"))
            if kind in _HOLDERS and (found := walk(at + 8 + full, stop, depth + 1)):
                return found
            at = stop
        return None

    return {"format": "heic" if b[8:12] in (b"heic", b"heix", b"mif1") else "mp4", "rotation": walk(0, len(b), 0)}


PARSERS = (png, gif, bmp, jpeg, webp, tiff, ico, zipped, pdf, heif, mp3)
#: Formats that may hold a camera's directory.
_CAMERA = ("jpeg", "png", "webp", "tiff")


def probe(content: bytes | None) -> dict:
    """Facts of one file; {} if it is none of the known formats or too short to say."""
    for parser in PARSERS if content else ():
        try:
            if (out := parser(content)) is not None:
                return out | (exif.camera(content) if out["format"] in _CAMERA else {})
        except (struct.error, IndexError, ValueError):
            return {}
    return {}


def parse(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with one nullable column per fact appended."""
    schema = ", ".join(f"{c} {t}" for c, t in df.drop(content).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            facts = [probe(x) for x in b.column(content).to_pylist()]
            kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
            made = [pa.array([f.get(n) for f in facts], kinds[t]) for n, t in (x.split() for x in FIELDS.split(", "))]
            kept = [n for n in b.schema.names if n != content]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in kept] + made, names=kept + _NAMES)

    return df.mapInArrow(run, ", ".join(x for x in (schema, FIELDS) if x))


def files(spark: SparkSession, path: str) -> DataFrame:
    """Local or remote files as path, modificationTime, length, content."""
    return spark.read.format("binaryFile").load(path)


def local_answer(spark: SparkSession, paths: DataFrame, found: DataFrame) -> DataFrame:
    """Answers to requests for files: ``paths`` (path, error) against ``found`` (path, length, content), as url, status, headers, content.

    A file that is there is 200 with its length and that ranges are accepted; one that is not is 404, one that may not be read 403, other errors 500.
    ``error`` is what a listing said of a path (null, denied or another word).
    """
    status = F.when(F.col("length").isNotNull(), 200).when(F.col("error").isNull(), 404).when(F.col("error") == "denied", 403).otherwise(500)
    headers = F.when(F.col("length").isNotNull(), F.create_map(F.lit("content-length"), F.col("length").cast("string"), F.lit("accept-ranges"), F.lit("bytes")))
    rows = paths.join(found, "path", "left")
    return rows.select(F.concat(F.lit("file://"), "path").alias("url"), status.alias("status"), headers.alias("headers"), "content")


def batch_items(df: DataFrame, body: str = "body", limit: int = 12, most: int = 256 << 10) -> DataFrame:
    """JSON batch bodies to one row per item: url, cache token, and whether it is within the batch limit.

    An item is a bare URL string or an object with ``url`` and ``cache``. A body of more than ``most`` bytes has no items.
    """
    raw = F.from_json(F.when(F.octet_length(F.col(body)) <= most, F.col(body)), "items array<string>")["items"]
    rows = df.select("*", F.posexplode_outer(raw).alias("idx", "item"))
    one = F.from_json("item", "url string, cache string")
    return rows.select(
        *df.columns, "idx", F.coalesce(one["url"], F.when(~F.col("item").startswith("{"), F.col("item"))).alias("url"), one["cache"].alias("cache"), (F.col("idx") < limit).alias("within")
    )

"""What a file is: magic bytes, then its URL's extension, then its Content-Type. Spark columns over hex heads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables

#: Public file signatures, tried in this order: extension, kind, media type, then places (byte offset, hex) that must all hold.
MAGIC = [
    ("jpeg", "image", "image/jpeg", [(0, "FFD8FF")]),
    ("png", "image", "image/png", [(0, "89504E470D0A1A0A")]),
    ("gif", "image", "image/gif", [(0, "474946")]),
    ("webp", "image", "image/webp", [(0, "52494646"), (8, "57454250")]),
    ("tiff", "image", "image/tiff", [(0, "49492A00")]),
    ("tiff", "image", "image/tiff", [(0, "4D4D002A")]),
    ("bmp", "image", "image/bmp", [(0, "424D")]),
    ("psd", "image", "image/vnd.adobe.photoshop", [(0, "38425053")]),
    ("ico", "image", "image/vnd.microsoft.icon", [(0, "00000100")]),
    ("avif", "image", "image/avif", [(4, "6674797061766966")]),
    ("heic", "image", "image/heif", [(4, "6674797068656963")]),
    ("heic", "image", "image/heif", [(4, "667479706D696631")]),
    ("jxl", "image", "image/jxl", [(0, "FF0A")]),
    ("jp2", "image", "image/jp2", [(0, "0000000C6A5020200D0A870A")]),
    ("m4v", "video", "video/x-m4v", [(4, "667479704D3456")]),
    ("mov", "video", "video/quicktime", [(4, "6674797071742020")]),
    ("mp4", "video", "video/mp4", [(4, "66747970")]),
    ("mkv", "video", "video/x-matroska", [(0, "1A45DFA3")]),
    ("avi", "video", "video/x-msvideo", [(0, "52494646"), (8, "415649")]),
    ("flv", "video", "video/x-flv", [(0, "464C5601")]),
    ("mpeg", "video", "video/mpeg", [(0, "000001BA")]),
    ("mp3", "audio", "audio/mpeg", [(0, "494433")]),
    ("mp3", "audio", "audio/mpeg", [(0, "FFFB")]),
    ("flac", "audio", "audio/x-flac", [(0, "664C6143")]),
    ("ogg", "audio", "audio/ogg", [(0, "4F676753")]),
    ("wav", "audio", "audio/x-wav", [(0, "52494646"), (8, "57415645")]),
    ("midi", "audio", "audio/midi", [(0, "4D546864")]),
    ("aiff", "audio", "audio/x-aiff", [(0, "464F524D"), (8, "41494646")]),
    ("pdf", "archive", "application/pdf", [(0, "25504446")]),
    ("zip", "archive", "application/zip", [(0, "504B0304")]),
    ("gz", "archive", "application/gzip", [(0, "1F8B")]),
    ("bz2", "archive", "application/x-bzip2", [(0, "425A68")]),
    ("xz", "archive", "application/x-xz", [(0, "FD377A585A00")]),
    ("rar", "archive", "application/vnd.rar", [(0, "526172211A07")]),
    ("7z", "archive", "application/x-7z-compressed", [(0, "377ABCAF271C")]),
    ("tar", "archive", "application/x-tar", [(257, "7573746172")]),
    ("rtf", "archive", "application/rtf", [(0, "7B5C72746631")]),
    ("exe", "binary", "application/vnd.microsoft.portable-executable", [(0, "4D5A")]),
    ("elf", "binary", "application/x-executable", [(0, "7F454C46")]),
    ("wasm", "binary", "application/wasm", [(0, "0061736D")]),
]
#: Camera-raw formats that are TIFF files by their magic.
RAW_TIFF = "dng cr2 nef arw orf rw2 pef srw raf 3fr fff iiq mef rwl raw"
#: Bytes of a file's beginning that are looked at.
PREFIX = 4096
_GENERIC = ("archive", "binary", "unknown")


def _table(rows: list[tuple[str, str]]) -> Column:
    return F.create_map(*[F.lit(x) for row in rows for x in row])


def kind_of_extension(ext: Column) -> Column:
    return F.coalesce(F.try_element_at(_table(tables.kind_rows()), ext), F.lit("unknown"))


def mime_of_extension(ext: Column) -> Column:
    return F.coalesce(F.try_element_at(_table(tables.mime_rows()), ext), F.lit("application/octet-stream"))


def extension_of_mime(mime: Column) -> Column:
    return F.coalesce(F.try_element_at(_table(tables.extension_rows()), mime), F.lit("bin"))


def canonical_extension(raw: Column) -> Column:
    return F.coalesce(F.try_element_at(_table(tables.alias_rows()), raw), raw)


def url_extension(u: Column) -> Column:
    """Canonical text after the last dot of the last path segment; null without a dot. A bare host gives its last label."""
    segment = F.element_at(F.split(F.split_part(F.split_part(u, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), "/"), -1)
    return canonical_extension(F.nullif(F.when(segment.contains("."), F.lower(F.element_at(F.split(segment, r"\."), -1))), F.lit("")))


def kind_of_mime(mime: Column, ext: Column) -> Column:
    return (
        F.when(F.startswith(mime, F.lit("image/")), F.when(ext == "svg", F.lit("vector")).otherwise(F.lit("image")))
        .when(F.startswith(mime, F.lit("video/")), F.lit("video"))
        .when(F.startswith(mime, F.lit("audio/")), F.lit("audio"))
        .when(mime.isin(*tables.MIME_DOCUMENT.split()), F.lit("document"))
        .when(F.startswith(mime, F.lit("text/")), F.lit("text"))
        .when(mime.isin(*tables.MIME_ARCHIVE.split()), F.lit("archive"))
        .when(mime.isin(*tables.MIME_GEOMETRY.split()), F.lit("geometry"))
        .otherwise(kind_of_extension(ext))
    )


def magic(head: Column) -> Column:
    """(ext, kind, mime) of the first signature that the hex ``head`` holds, or null. HTML and XML count as text, told by their first tag."""
    out = F.lit(None).cast("struct<ext:string,kind:string,mime:string>")
    made = lambda e, k, m: F.struct(F.lit(e).alias("ext"), F.lit(k).alias("kind"), F.lit(m).alias("mime"))
    text = F.decode(F.unhex(F.left(head, F.lit(2 * 512))), "ISO-8859-1")
    out = F.when(text.rlike(r"(?i)^\s*<\?xml"), made("xml", "text", "text/xml")).otherwise(out)
    out = F.when(text.rlike(r"(?i)^\s*<(?:!doctype html|html|head|body|script|iframe|h1|div|table|p)[ >]"), made("html", "text", "text/html")).otherwise(out)
    for ext, kind, mime, places in reversed(MAGIC):
        hit = F.lit(True)
        for at, code in places:
            hit = hit & (F.substring(head, 2 * at + 1, len(code)) == code)
        kind = "document" if ext in ("pdf", "rtf") else kind
        out = F.when(hit, made(ext, kind, mime)).otherwise(out)
    return out


def has_svg(head: Column) -> Column:
    """Whether an ``<svg`` tag begins in the hex ``head``."""
    return F.decode(F.unhex(head), "ISO-8859-1").rlike(r"(?i)<svg[ \t\n\r>/]")


def sniff(head: Column, url: Column, content_type: Column) -> Column:
    """(kind, mime, ext) of a file by its hex ``head``, URL and Content-Type.

    Magic bytes come first, with four corrections: HTML is a document; text that holds an SVG tag, or is named so, is a vector; a generic
    container takes a more specific kind from the URL; TIFF takes a camera-raw name. Then a URL extension of known kind, then a
    Content-Type of known kind, then an unknown extension as it is.
    """
    made = lambda k, m, e: F.struct(k.alias("kind"), m.alias("mime"), e.alias("ext"))

    def of(x):
        ext, found = x["u"], x["m"]
        by_url = kind_of_extension(ext)
        kind = F.when(found["mime"] == "text/html", F.lit("document")).otherwise(found["kind"])
        mime = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
        named = F.coalesce(ext, extension_of_mime(mime))
        by_type = kind_of_mime(mime, named)
        vector = (kind == "text") & (F.coalesce(ext == "svg", F.lit(False)) | has_svg(head))
        own = made(by_url, mime_of_extension(ext), ext)
        return (
            F.when(found.isNotNull() & vector, made(F.lit("vector"), F.lit("image/svg+xml"), F.lit("svg")))
            .when(found.isNotNull() & kind.isin(*_GENERIC) & ext.isNotNull() & ~by_url.isin(*_GENERIC), own)
            .when((found["ext"] == "tiff") & ext.isin(*RAW_TIFF.split()), made(F.lit("image"), mime_of_extension(ext), ext))
            .when(found.isNotNull(), made(kind, found["mime"], canonical_extension(found["ext"])))
            .when(ext.isNotNull() & (by_url != "unknown"), own)
            .when(content_type.isNotNull() & (by_type != "unknown"), made(by_type, mime, named))
            .when(ext.isNotNull(), made(F.lit("unknown"), mime_of_extension(ext), ext))
            .otherwise(made(F.lit("unknown"), F.lit("application/octet-stream"), F.lit("bin")))
        )

    return F.transform(F.array(F.struct(url_extension(url).alias("u"), magic(head).alias("m"))), of)[0]

"""Pictures and page counts inside containers: ZIP documents, MP3 tags, PDF files; and GLB clean-up."""

from __future__ import annotations

import json
import re
import struct
import zlib

#: Where ZIP documents keep a preview.
ZIP_PREVIEWS = ("Thumbnails/thumbnail.png", "docProps/thumbnail.jpeg", "docProps/thumbnail.jpg", "docProps/thumbnail.png")
#: Bytes of content.xml a page, of a file's head in which meta.xml is read, that an inflated entry and a PDF image may have.
PAGE_BYTES, META_HEAD, MOST_INFLATED, MOST_PDF_IMAGE = 11_750, 16 << 10, 64 << 20, 16 << 20


def inflate(data: bytes, most: int, raw: bool = True) -> bytes | None:
    """Deflated bytes, or None if they are damaged or give more than ``most``."""
    z = zlib.decompressobj(-15 if raw else 15)
    try:
        out = z.decompress(data, most)
    except zlib.error:
        return None
    return out if z.eof else None


class Zip:
    """A ZIP file's directory: (method, packed, size, offset) by name, the first entry of a name. Raises ValueError if there is none."""

    def __init__(self, b: bytes):
        end = b.rfind(b"PK\x05\x06", max(0, len(b) - 22 - 65_535))
        if end < 0 or end + 22 > len(b):
            raise ValueError("no end of central directory")
        size, at = struct.unpack("<II", b[end + 12 : end + 20])
        self.data, self.entries, stop = b, {}, min(at + size, len(b))
        while at + 46 <= stop and b[at : at + 4] == b"PK\x01\x02":
            method, packed, full, name, extra, comment, offset = struct.unpack("<10xH8xIIHHH8xI", b[at : at + 46])
            key = b[at + 46 : at + 46 + name].decode("utf-8", "replace")
            self.entries.setdefault(key, (method, packed, full, offset))
            at += 46 + name + extra + comment

    def read(self, name: str, upto: int | None = None) -> bytes | None:
        """An entry's bytes, from the part of the file before ``upto``; None if they are not all there, damaged or packed in another way."""
        if name not in self.entries:
            return None
        method, packed, _, at = self.entries[name]
        b = self.data if upto is None else self.data[:upto]
        if b[at : at + 4] != b"PK\x03\x04" or at + 30 > len(b):
            return None
        start = at + 30 + sum(struct.unpack("<HH", b[at + 26 : at + 30]))
        raw = b[start : start + packed]
        if len(raw) < packed:
            return None
        return raw if method == 0 else inflate(raw, MOST_INFLATED) if method == 8 else None


def zip_document(b: bytes) -> dict:
    """pages (exact from meta.xml if it lies in the head), estimated_pages (by the size of content.xml) and preview of a ZIP document."""
    try:
        z = Zip(b)
    except (ValueError, struct.error):
        return {}
    out: dict = {}
    if "meta.xml" in z.entries:
        _, packed, _, at = z.entries["meta.xml"]
        if at + packed + 512 <= META_HEAD and (meta := z.read("meta.xml")) and (found := re.search(rb'page-count="([0-9]{1,9})"', meta)):
            out["pages"] = int(found[1])
    if "pages" not in out and "content.xml" in z.entries:
        out["estimated_pages"] = max(1, z.entries["content.xml"][2] // PAGE_BYTES)
    for name in z.entries:  # in the order of the directory
        if name in ZIP_PREVIEWS:
            if (preview := z.read(name)) is not None:
                out["preview"] = preview
            break
    return out


def synchsafe(b: bytes) -> int:
    return sum((x & 0x7F) << 7 * (3 - i) for i, x in enumerate(b[:4]))


def cover(b: bytes) -> bytes | None:
    """The picture of an ID3 tag of version 2.3 or 2.4."""
    if b[:3] != b"ID3" or len(b) < 10 or b[3] < 3:
        return None
    at = 10 + (synchsafe(b[10:14]) if b[5] & 0x40 else 0)
    while re.fullmatch(rb"[A-Z][A-Z][A-Z][A-Z0-9]", b[at : at + 4]):
        size = synchsafe(b[at + 4 : at + 8]) if b[3] >= 4 else int.from_bytes(b[at + 4 : at + 8], "big")
        if b[at : at + 4] == b"APIC":
            return _picture(b[at + 10 : at + 10 + size])
        at += 10 + size
    return None


def _picture(frame: bytes) -> bytes | None:
    """What follows the media type, the picture's kind and its description; both texts end with a zero of their encoding's width."""
    width = 2 if frame[:1] in (b"\x01", b"\x02") else 1

    def after(at: int) -> int | None:
        while at + width <= len(frame):
            if not any(frame[at : at + width]):
                return at + width
            at += width
        return None

    end = after(1)
    end = None if end is None else after(end + 1)
    return None if end is None else frame[end:] or None


def pdf_objects(b: bytes) -> dict[int, bytes]:
    """Objects by number, the last of each; those in object streams are inflated."""
    out = {int(m[1]): m[2] for m in re.finditer(rb"(?:^|[\r\n ])(\d{1,9}) \d{1,5} obj\b(.*?)\bendobj", b, re.S)}
    for body in list(out.values()):
        if b"/ObjStm" not in body or (data := _stream(body)) is None:
            continue
        count, first = (int(m[1]) if (m := re.search(key + rb"\s+(\d{1,9})", body)) else 0 for key in (rb"/N", rb"/First"))
        head = [int(x) for x in data[:first].split()[: 2 * count] if x.isdigit()]
        places = [*head[1::2], len(data) - first]
        for i, n in enumerate(head[::2]):
            if i + 1 < len(places):
                out.setdefault(n, data[first + places[i] : first + places[i + 1]])
    return out


def _stream(body: bytes) -> bytes | None:
    found = re.search(rb"stream\r?\n(.*?)\r?\nendstream", body, re.S) or re.search(rb"stream\r?\n(.*)endstream", body, re.S)
    if not found:
        return None
    return inflate(found[1], MOST_PDF_IMAGE, raw=False) if b"/FlateDecode" in body[: found.start()] else found[1]


def pdf_document(b: bytes) -> dict:
    """pages (page objects) and preview (the first page thumbnail that is a JPEG, or 8-bit grey or RGB as (width, height, channels, bytes)) of a PDF file."""
    if not b.startswith(b"%PDF-"):
        return {}
    objects = pdf_objects(b)
    pages = [body for body in objects.values() if re.search(rb"/Type\s*/Page\b(?!s)", body)]
    out: dict = {"pages": len(pages)} if pages else {}
    for body in pages:
        found = re.search(rb"/Thumb\s+(\d{1,9})\s+\d{1,5}\s+R", body)
        thumb = objects.get(int(found[1])) if found else None
        if thumb is None or not re.search(rb"/Subtype\s*/Image\b", thumb):
            continue
        head = thumb.split(b"stream", 1)[0]
        if re.search(rb"/DCT(?:Decode)?\b", head):
            if raw := re.search(rb"stream\r?\n(.*?)\r?\n?endstream", thumb, re.S):
                out["preview"] = raw[1]
                break
            continue
        number = lambda key: int(m[1]) if (m := re.search(rb"/" + key + rb"\s+(\d{1,9})", head)) else None  # noqa: B023, E731
        w, h, channels = number(b"Width"), number(b"Height"), 3 if re.search(rb"/(?:DeviceRGB|RGB)\b", head) else 1 if re.search(rb"/(?:DeviceGray|G)\b", head) else 0
        data = _stream(thumb) if channels and (number(b"BitsPerComponent") or 8) == 8 else None
        if data is not None and w and h and len(data) >= w * h * channels:
            out["preview_pixels"] = (w, h, channels, data[: w * h * channels])
            break
    return out


def clean_glb(b: bytes) -> bytes:
    """A GLB file without images, textures, materials, samplers and texture transforms; other files as they are."""
    if len(b) < 20 or b[:4] != b"glTF":
        return b
    size = int.from_bytes(b[12:16], "little")
    gone = "KHR_texture_transform"

    def clean(x):
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if k != gone}
        return [clean(v) for v in x] if isinstance(x, list) else x

    scene = clean(json.loads(b[20 : 20 + size]))
    if isinstance(scene, dict):
        scene = {k: v for k, v in scene.items() if k not in ("images", "textures", "materials", "samplers")}
        if "extensionsUsed" in scene:
            scene["extensionsUsed"] = [e for e in scene["extensionsUsed"] if e != gone]
    text = json.dumps(scene, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    rest = b[20 + size + (-size % 4) :]
    return b[:8] + struct.pack("<II", 20 + len(text) + len(rest), len(text)) + b"JSON" + text + rest

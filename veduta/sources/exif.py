"""TIFF directories and what cameras put in them: orientation, sizes and embedded JPEG previews of JPEG, PNG, WebP, TIFF and raw files."""

from __future__ import annotations

import struct
from collections import deque

#: TIFF tags.
WIDTH, LENGTH, COMPRESSION, STRIPS, STRIP_SIZES, ORIENTATION = 0x0100, 0x0101, 0x0103, 0x0111, 0x0117, 0x0112
TILES, TILE_SIZES, SUB_IFDS, JPEG_AT, JPEG_SIZE, EXIF_IFD = 0x0144, 0x0145, 0x014A, 0x0201, 0x0202, 0x8769
PIXEL_X, PIXEL_Y = 0xA002, 0xA003
#: Sub-directories looked at, and bytes of a WebP file's end in which its EXIF chunk is looked for.
MOST_SUBS, WEBP_TAIL = 32, 131_072


class Tiff:
    """A TIFF file, or the TIFF inside another: directories by offset. Raises ValueError if it is none."""

    def __init__(self, data: bytes):
        if data[:2] not in (b"II", b"MM") or len(data) < 8:
            raise ValueError("not a TIFF file")
        self.data, self._order = data, "<" if data[:2] == b"II" else ">"
        magic, self.first = struct.unpack(f"{self._order}HI", data[2:8])
        if magic != 42:
            raise ValueError("not a TIFF file")

    def number(self, at: int, size: int) -> int | None:
        raw = self.data[at : at + size]
        return int.from_bytes(raw, "little" if self._order == "<" else "big") if at >= 0 and len(raw) == size else None

    def directory(self, at: int) -> tuple[dict[int, tuple[int, int, int]], int] | None:
        """Entries by tag as (type, count, place of the value), and the next directory's offset; None if it is cut off."""
        n = self.number(at, 2)
        if n is None:
            return None
        entries = {}
        for place in range(at + 2, at + 2 + 12 * n, 12):
            if place + 12 > len(self.data):
                break
            tag, kind, count = struct.unpack(f"{self._order}HHI", self.data[place : place + 8])
            entries.setdefault(tag, (kind, count, place + 8))
        return entries, self.number(at + 2 + 12 * n, 4) or 0

    def values(self, entry: tuple[int, int, int] | None, most: int = 1) -> list[int]:
        """Short and long values of an entry, from the entry itself or from where it points."""
        if entry is None or entry[0] not in (3, 4):
            return []
        size, count = 2 if entry[0] == 3 else 4, entry[1]
        at = entry[2] if size * count <= 4 else self.number(entry[2], 4)
        found = [self.number(at + size * i, size) for i in range(min(count, most))] if at is not None else []
        return [x for x in found if x is not None]

    def value(self, entries: dict, tag: int) -> int | None:
        return next(iter(self.values(entries.get(tag))), None)

    def orientation(self) -> int:
        found = self.directory(self.first)
        return min(max(self.value(found[0], ORIENTATION) or 1, 1), 8) if found else 1

    def size(self) -> tuple[int, int] | None:
        """Pixels as the EXIF directory says, or else the first directory."""
        found = self.directory(self.first)
        if not found:
            return None
        entries, out = found[0], []
        pointer = self.number(entries[EXIF_IFD][2], 4) if EXIF_IFD in entries else None
        inner = (self.directory(pointer) or ({}, 0))[0] if pointer is not None else {}
        for exact, plain in ((PIXEL_X, WIDTH), (PIXEL_Y, LENGTH)):
            out.append(self.value(inner, exact) or self.value(entries, plain) or 0)
        return tuple(out) if all(out) else None

    def preview_of(self, entries: dict) -> tuple[int, int] | None:
        """(offset, size) of the JPEG that a directory names: by its own tags, or as the first strip or tile of a JPEG-compressed image."""
        at, size = self.value(entries, JPEG_AT), self.value(entries, JPEG_SIZE)
        if (at is None or size is None) and self.value(entries, COMPRESSION) in (6, 7):
            for places, sizes in ((STRIPS, STRIP_SIZES), (TILES, TILE_SIZES)):
                at, size = self.value(entries, places), self.value(entries, sizes)
                if at is not None and size is not None:
                    break
        return (at, size) if at is not None and size is not None and size >= 4 else None

    def thumbnail(self) -> tuple[int, int] | None:
        """(offset, size) of the second directory's JPEG."""
        found = self.directory(self.first)
        second = self.directory(found[1]) if found and found[1] else None
        return self.preview_of({k: v for k, v in second[0].items() if k in (JPEG_AT, JPEG_SIZE)}) if second else None

    def largest_preview(self) -> tuple[int, int] | None:
        """(offset, size) of the largest JPEG in all directories and sub-directories, the first of equals, each directory read once."""
        queue, seen, best = deque([self.first]), set(), None
        while queue:
            at = queue.popleft()
            if at in seen or (found := self.directory(at)) is None:
                continue
            seen.add(at)
            entries, following = found
            if (jpeg := self.preview_of(entries)) and (best is None or jpeg[1] > best[1]):
                best = jpeg
            queue.extend(x for x in (following, *self.values(entries.get(SUB_IFDS), MOST_SUBS)) if x)
        return best


def _opened(data: bytes) -> Tiff | None:
    try:
        return Tiff(data)
    except (ValueError, struct.error):
        return None


def jpeg_segments(b: bytes):
    """(marker, payload start, payload end) of a JPEG's segments up to its scan."""
    at = 2
    while at + 4 <= len(b) and b[:2] == b"\xff\xd8":
        if b[at] != 0xFF:
            at += 1
            continue
        marker = b[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0x00 or marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        if marker == 0xD9:
            return
        size = int.from_bytes(b[at + 2 : at + 4], "big")
        if size < 2:
            return
        yield marker, at + 4, min(at + 2 + size, len(b))
        if marker == 0xDA:
            return
        at += 2 + size


def exif_blocks(b: bytes):
    """(TIFF data, its offset in the file) of a file's EXIF blocks: JPEG APP1, PNG eXIf before the image, WebP EXIF near the end, or a TIFF file itself."""
    if b[:2] == b"\xff\xd8":
        for marker, start, end in jpeg_segments(b):
            if marker == 0xE1 and b[start : start + 6] == b"Exif\0\0":
                yield b[start + 6 : end], start + 6
    elif b[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 12 <= len(b):
            size, kind = int.from_bytes(b[at : at + 4], "big"), b[at + 4 : at + 8]
            if kind == b"eXIf":
                yield b[at + 8 : at + 8 + size], at + 8
            if kind in (b"IDAT", b"IEND", b"eXIf"):
                return
            at += 12 + size
    elif b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        at = b.find(b"EXIF", max(0, len(b) - WEBP_TAIL))
        while at >= 0:
            size = int.from_bytes(b[at + 4 : at + 8], "little")
            data = b[at + 8 : at + 8 + size]
            yield (data[6:], at + 14) if data[:6] == b"Exif\0\0" else (data, at + 8)
            at = b.find(b"EXIF", at + 4)
    elif b[:2] in (b"II", b"MM"):
        yield b, 0


def camera(b: bytes) -> dict:
    """orientation, and of an embedded JPEG its place and size with the pixels of the whole image, where a file says so.

    A TIFF file gives its largest preview, others the thumbnail of their EXIF block.
    """
    out: dict = {}
    for data, base in exif_blocks(b):
        tiff = _opened(data)
        if tiff is None:
            continue
        out.setdefault("orientation", tiff.orientation())
        found = tiff.largest_preview() if base == 0 else tiff.thumbnail()
        if found and "thumb_offset" not in out:
            out |= {"thumb_offset": base + found[0], "thumb_size": found[1]}
            if size := tiff.size():
                out |= {"source_width": size[0], "source_height": size[1]}
    return out


def thumbnail(b: bytes) -> bytes | None:
    """The embedded JPEG's bytes, if they lie in the file and begin like one."""
    found = camera(b)
    if "thumb_offset" not in found:
        return None
    raw = b[found["thumb_offset"] : found["thumb_offset"] + found["thumb_size"]]
    return raw if len(raw) >= 4 and raw[:2] == b"\xff\xd8" else None

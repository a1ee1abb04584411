import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest

from veduta.plans.files import QUERIES
from veduta.sources import containers, exif, media, pixels

JPEG = b"\xff\xd8" + bytes(range(40)) + b"\xff\xd9"


def ifd(entries, following, order="<"):
    return struct.pack(f"{order}H", len(entries)) + b"".join(struct.pack(f"{order}HHI", t, k, n) + v for t, k, n, v in entries) + struct.pack(f"{order}I", following)


def tiff(order="<", orientation=6, exact=True):
    """A TIFF block with sizes, an EXIF directory and a second directory that names a JPEG at its end."""
    short = lambda v: struct.pack(f"{order}HH", v, 0)
    long = lambda v: struct.pack(f"{order}I", v)
    first = 8
    second = first + 2 + 4 * 12 + 4
    inner = second + 2 + 2 * 12 + 4
    at = inner + 2 + 2 * 12 + 4
    out = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, first)
    out += ifd([(0x0100, 3, 1, short(640)), (0x0101, 4, 1, long(480)), (0x0112, 3, 1, short(orientation)), (0x8769, 4, 1, long(inner))], second, order)
    out += ifd([(0x0201, 4, 1, long(at)), (0x0202, 4, 1, long(len(JPEG)))], 0, order)
    out += ifd([(0xA002, 4, 1, long(600)), (0xA003, 4, 1, long(400))] if exact else [(0x1, 4, 1, long(1)), (0x2, 4, 1, long(1))], 0, order)
    return out + JPEG


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + b"\0\0\0\0"


def camera_files():
    block = tiff()
    frame = b"\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x01\x01\x11\x00"
    app = b"\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 8, 8, 2, 0, 0, 0)) + chunk(b"eXIf", block) + chunk(b"IDAT", b"x")
    webp = b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<I", 10) + b"\0" * 4 + b"\x09\0\0\x07\0\0" + b"EXIF" + struct.pack("<I", len(block)) + block
    return {"jpeg": b"\xff\xd8" + app + frame + b"\xff\xda", "png": png, "webp": webp, "tiff": block, "big": tiff(">", 8)}


def test_camera_facts_and_thumbnails():
    for name, data in camera_files().items():
        got = exif.camera(data)
        assert (got["orientation"], got["source_width"], got["source_height"]) == (8 if name == "big" else 6, 600, 400), name
        assert exif.thumbnail(data) == JPEG, name
        assert media.probe(data)["thumb_size"] == len(JPEG)
    assert exif.camera(tiff(exact=False))["source_width"] == 640 and exif.camera(b"\xff\xd8\xff\xd9") == {}


def test_largest_preview_in_sub_directories():
    """Of three JPEGs, one of them a strip in a sub-directory, the largest; directories that point in a circle end."""
    long = lambda v: struct.pack("<I", v)
    subs = 8 + 2 + 24 + 4
    a, b = subs + 8, subs + 8 + 2 + 36 + 4
    data = b"II" + struct.pack("<HI", 42, 8)
    data += ifd([(0x0201, 4, 1, long(500)), (0x014A, 4, 2, long(subs))], 8)
    data += struct.pack("<II", a, b)
    data += ifd([(0x0103, 3, 1, struct.pack("<HH", 7, 0)), (0x0111, 4, 1, long(700)), (0x0117, 4, 1, long(90))], 0)
    data += ifd([(0x0201, 4, 1, long(800)), (0x0202, 4, 1, long(60))], 8)
    assert exif.Tiff(data).largest_preview() == (700, 90)


def test_jpeg_markers():
    frame = b"\xff\xc2\x00\x0b\x08\x00\x10\x00\x20\x03\x01\x11\x00"
    head = b"\xff\xd8\xff\xe0\x00\x04ab"
    assert media.jpeg_app_end(head + b"\xff\xdb\x00\x03x" + frame) == 8 and media.jpeg_app_end(head) is None
    assert media.find_frame(b"junk\xff\xc0\x00\x0b\x08\x00\x00\x00\x20\x01" + frame) == (32, 16, 24) and media.find_frame(b"\xff\xc0") is None
    assert media.jpeg(head + b"\xff\xc9\x00\x04xx\xff\xda\x00\x02")["arithmetic"] and not media.jpeg(head + frame)["arithmetic"]
    assert media.ico(b"\0\0\1\0\1\0" + b"\0\x10" + b"\0" * 14)["width"] == 256


def zip_file(files, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data, method in files:
            z.writestr(name, data, method)
        z.comment = comment
    return out.getvalue()


def test_zip_documents():
    meta = b'<meta:document-statistic meta:page-count="17" x="1"/>'
    for method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        odt = zip_file([("meta.xml", meta, method), ("content.xml", b"x" * 50_000, method), ("Thumbnails/thumbnail.png", b"PNGDATA" * 9, method)], b"PK comment")
        assert containers.zip_document(odt) == {"pages": 17, "preview": b"PNGDATA" * 9}
        assert media.probe(odt)["pages"] == 17 and media.probe(odt)["format"] == "odt"
        late = zip_file([("a", bytes(20_000), zipfile.ZIP_STORED), ("meta.xml", meta, method), ("content.xml", b"x" * 50_000, method), ("docProps/thumbnail.jpg", JPEG, method)])
        assert containers.zip_document(late) == {"estimated_pages": 4, "preview": JPEG}
    assert containers.zip_document(b"PK\x05\x06") == {} and containers.zip_document(b"") == {}


def id3(version, encoding, extended=False):
    zero = b"\0\0" if encoding in (1, 2) else b"\0"
    text = (lambda s: s.encode("utf-16-le")) if encoding in (1, 2) else (lambda s: s.encode())
    frame = bytes([encoding]) + text("image/jpeg") + zero + b"\x03" + text("ab") + zero + JPEG
    pack = (lambda n: bytes(n >> 7 * i & 0x7F for i in (3, 2, 1, 0))) if version >= 4 else (lambda n: struct.pack(">I", n))
    body = (b"\0\0\0\x06\0\0" if extended else b"") + b"TIT2" + pack(4) + b"\0\0\0abc" + b"APIC" + pack(len(frame)) + b"\0\0" + frame
    return b"ID3" + bytes([version, 0, 0x40 if extended else 0]) + bytes(len(body) >> 7 * i & 0x7F for i in (3, 2, 1, 0)) + body


@pytest.mark.parametrize("version", [3, 4])
@pytest.mark.parametrize("encoding", [0, 1, 3])
def test_cover_art(version, encoding):
    assert containers.cover(id3(version, encoding)) == JPEG and containers.cover(id3(version, encoding, True)) == JPEG
    assert containers.cover(id3(2, encoding)) is None


def pdf_file(channels=3, dct=False, packed=False):
    pixels_ = bytes(range(4 * channels))
    data = JPEG if dct else zlib.compress(pixels_)
    kind = b"/Filter /DCTDecode" if dct else b"/Filter /FlateDecode /ColorSpace /" + (b"DeviceRGB" if channels == 3 else b"DeviceGray")
    thumb = b"9 0 obj <</Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 " + kind + b">> stream\n" + data + b"\nendstream endobj\n"
    pages = [b"<</Type /Page /Parent 1 0 R>>", b"<</Type /Page /Parent 1 0 R /Thumb 9 0 R>>"]
    out = b"%PDF-1.5\n1 0 obj <</Type /Pages /Count 2>> endobj\n" + thumb
    if not packed:
        return out + b"".join(b"%d 0 obj %s endobj\n" % (i + 2, p) for i, p in enumerate(pages))
    head = b"2 0 3 %d " % len(pages[0])
    stream = zlib.compress(head + pages[0] + pages[1])
    return out + b"7 0 obj <</Type /ObjStm /N 2 /First %d /Filter /FlateDecode>> stream\n%s\nendstream endobj\n" % (len(head), stream)


def test_pdf_pages_and_thumbnails():
    for packed in (False, True):
        assert containers.pdf_document(pdf_file(packed=packed)) == {"pages": 2, "preview_pixels": (2, 2, 3, bytes(range(12)))}
        assert containers.pdf_document(pdf_file(1, packed=packed))["preview_pixels"] == (2, 2, 1, bytes(range(4)))
        assert containers.pdf_document(pdf_file(dct=True, packed=packed)) == {"pages": 2, "preview": JPEG}
    assert containers.pdf_document(b"no") == {}


def test_glb_clean_up():
    scene = {"images": [1], "materials": [{}], "meshes": [{"extensions": {"KHR_texture_transform": 1, "b": 2}}], "extensionsUsed": ["KHR_texture_transform", "b"]}
    text = json.dumps(scene).encode()
    text += b" " * (-len(text) % 4)
    rest = struct.pack("<I", 4) + b"BIN\0abcd"
    glb = b"glTF" + struct.pack("<III", 2, 20 + len(text) + len(rest), len(text)) + b"JSON" + text + rest
    out = containers.clean_glb(glb)
    size = struct.unpack("<I", out[12:16])[0]
    assert json.loads(out[20 : 20 + size]) == {"meshes": [{"extensions": {"b": 2}}], "extensionsUsed": ["b"]}
    assert out[20 + size :] == rest and struct.unpack("<I", out[8:12])[0] == len(out) and size % 4 == 0 and containers.clean_glb(b"x") == b"x"


def test_damaged_files_never_raise():
    files = [*camera_files().values(), zip_file([("meta.xml", b"x" * 99, 8), ("docProps/thumbnail.png", b"y" * 99, 8)]), id3(3, 1), id3(4, 0), pdf_file(), pdf_file(packed=True)]
    for data in files:
        for n in range(len(data)):
            for part in (data[:n], data[:n] + bytes([data[n] ^ 0xFF]) + data[n + 1 :]):
                media.probe(part)
                exif.thumbnail(part)
                containers.cover(part)
                containers.zip_document(part)
                containers.pdf_document(part)


# -- pixels
def picture(h, w, channels, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w, channels), dtype=np.uint8)


def test_png_round_trip_and_filters():
    for channels in (1, 2, 3, 4):
        img = picture(7, 9, channels)
        assert (pixels.decode_png(pixels.encode_png(img)) == img).all()
        stride, raw, above = 9 * channels, b"", np.zeros(9 * channels, int)
        for y in range(7):
            line, kind = img[y].ravel().astype(int), y % 5
            left, corner = (np.r_[np.zeros(channels, int), x[: stride - channels]] for x in (line, above))
            p = left + above - corner
            paeth = np.array([min((abs(q - v), i, v) for i, v in enumerate(t))[2] for q, t in zip(p, zip(left, above, corner))])
            guess = [0 * line, left, above, (left + above) // 2, paeth][kind]
            raw += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
            above = line
        data = pixels.encode_png(img)
        at = data.index(b"IDAT") - 4
        packed = zlib.compress(raw)
        again = data[:at] + struct.pack(">I", len(packed)) + b"IDAT" + packed + b"\0" * 4
        assert (pixels.decode_png(again) == img).all()
    assert pixels.decode_png(b"") is None and pixels.decode_png(pixels.encode_png(img)[:60]) is None


def test_resize_equals_a_plain_one():
    img = picture(11, 7, 3)
    for w, h in ((4, 5), (14, 22), (7, 11)):
        out = pixels.resize(img, w, h).astype(int)
        for y in range(h):
            for x in range(w):
                total, weight = np.zeros(3), 0.0
                for j in range(11):
                    for i in range(7):
                        a = max(0.0, 1 - abs((j + 0.5) - (y + 0.5) * 11 / h) / max(11 / h, 1)) * max(0.0, 1 - abs((i + 0.5) - (x + 0.5) * 7 / w) / max(7 / w, 1))
                        total, weight = total + a * img[j, i], weight + a
                assert (np.abs(out[y, x] - total / weight) <= 0.51).all()
    clear = np.dstack([np.full((4, 4, 3), 200, np.uint8), np.array([[0, 0, 255, 255]] * 4, np.uint8)])
    assert (pixels.resize(clear, 2, 2)[:, 1, :3] >= 198).all()  # no dark halo
    assert (pixels.resize(img, 14, 22, nearest=True)[::2, ::2] == img).all()


def test_geometry():
    assert pixels.geometry(799, 546)[4:] == (250, 200)
    for size, want in {(1000, 1000): (250, 250, 0, 12, 250, 200), (4000, 100): (4800, 120, 2275, 0, 250, 120), (100, 4000): (150, 6000, 0, 1450, 150, 200), (1600, 900): (278, 156, 14, 0, 250, 156)}.items():
        assert pixels.geometry(*size) == want
    near = picture(198, 248, 3)
    assert pixels.fit(near).shape == (200, 250, 3) or (pixels.fit(near) == near).all()


def test_pixel_steps_equal_plain_ones():
    img = picture(6, 8, 4)
    half = pixels.box_half(img).astype(int)
    assert all(half[y, x, c] == (int(img[2 * y : 2 * y + 2, 2 * x : 2 * x + 2, c].astype(int).sum()) + 2) >> 2 for y in range(3) for x in range(4) for c in range(4))
    placed = pixels.place(img, (10, 20, 30), 12, 10).astype(int)
    assert (placed[0, 0] == [10, 20, 30]).all()
    for y in range(6):
        for x in range(8):
            a = int(img[y, x, 3])
            assert [(int(img[y, x, c]) * a + b * (255 - a) + 127) // 255 for c, b in enumerate((10, 20, 30))] == placed[2 + y, 2 + x].tolist()
    flat = np.full((200, 250, 3), 200, np.uint8)
    assert (pixels.unsharp(flat) == flat).all()
    shade = pixels.vignette(flat)
    assert shade[100, 125, 0] == 199 and shade[0, 0, 0] == int(np.float32(200) * (1 - 0.25 * (124.5**2 + 99.5**2) / 25625))
    assert (pixels.gamma(img)[..., 3] == img[..., 3]).all() and pixels.gamma(np.array([[[0, 128, 255]]], np.uint8)).tolist() == [[[0, 186, 255]]]
    assert pixels.cmyk(np.array([[[10, 20, 30, 40]]], np.uint8)).tolist() == [[[206, 198, 189]]]
    assert pixels.contrast(np.array([[[128, 0, 255, 9]]], np.uint8))[0, 0, 1:].tolist() == [0, 255, 9]


def test_orientation_and_autocrop():
    img = picture(2, 3, 3)
    a = img[..., 0]
    want = {1: a, 2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1], 6: a[::-1].T, 8: a[:, ::-1].T, 5: a[::-1].T[:, ::-1], 7: a[:, ::-1].T[:, ::-1]}
    for k, x in want.items():
        assert (pixels.oriented(img, k)[..., 0] == x).all(), k
    clear = np.zeros((60, 50, 4), np.uint8)
    assert pixels.autocrop(clear).shape == clear.shape
    clear[20:30, 15:40, 3] = 1
    assert pixels.autocrop(clear).shape == (26, 41, 4)
    clear[:, :, 3] = 1
    assert pixels.autocrop(clear).shape == clear.shape


def test_page_edges_equal_plain_ones():
    h, w, n = 30, 40, 5
    out = pixels.page_edges(np.full((h, w, 3), 7, np.uint8), n)
    knots = [0.25, 0, 0.25, 0.5, 0.75, 1, 0.75]

    def wave(u):
        i = min(int(u * 6), 5)
        return knots[i] + (knots[i + 1] - knots[i]) * (u * 6 - i)

    for y in range(h):
        for x in range(w):
            right, below = w - 1 - x, h - 1 - y
            if right >= n and below >= n:
                assert out[y, x].tolist() == [7, 7, 7, 255]
            elif (right < n and y < n and right + y < n - 1) or (below < n and x < n and x + below < n - 1):
                assert out[y, x].tolist() == [0, 0, 0, 0]
            else:
                face = right < n and (below >= n or right <= below)
                t = wave(y / (h - 1)) if face else 1 - wave(x / (w - 1))
                base = [int(a + (b - a) * t + 0.5) for a, b in zip(pixels.GOLD, pixels.PURPLE, strict=True)]
                k = 7 if (x if face else y) % 2 == 0 else 9
                assert all(abs(int(v) - b * k // 10) <= 1 for v, b in zip(out[y, x, :3], base, strict=True))


def test_tone_map_keeps_order_and_alpha():
    grey = np.dstack([np.arange(256, dtype=np.uint8)[None, :]] * 3 + [np.full((1, 256), 255, np.uint8)])
    out = pixels.tone_map(grey)
    assert out[0, 0, 2] > out[0, 0, 0] and out[0, 255, 0] > out[0, 255, 2] and (np.diff(out[0, :, 1].astype(int)) >= -1).all()
    grey[0, 5, 3] = 0
    assert pixels.tone_map(grey)[0, 5].tolist() == [5, 5, 5, 0]


def test_thumbnail_of_any_picture():
    for h, w, c in ((1, 1, 3), (30, 900, 4), (900, 30, 1), (500, 600, 2), (64, 64, 3)):
        assert pixels.thumbnail(pixels.pre_scale(picture(h, w, c)), page_edge=4).shape == (200, 250, 3)


def test_answers_for_local_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"hello")
    found = media.files(spark, str(tmp_path)).selectExpr("replace(path, 'file:', '') AS path", "length", "content")
    paths = spark.createDataFrame([(f"{tmp_path}/a.bin", None), (f"{tmp_path}/b.bin", None), ("/c", "denied"), ("/d", "broken")], "path string, error string")
    got = {r.url.rsplit("/", 1)[1]: (r.status, r.headers) for r in media.local_answer(spark, paths, found).collect()}
    assert got == {"a.bin": (200, {"content-length": "5", "accept-ranges": "bytes"}), "b.bin": (404, None), "c": (403, None), "d": (500, None)}


def test_resize_takes_only_pixels_with_a_weight():
    for size, to in ((4000, 250), (848, 213), (7, 14), (1, 5), (5, 1), (300, 300)):
        at, weight = pixels._taps(size, to)
        step = size / to
        want = np.maximum(0.0, 1 - np.abs(np.arange(size) + 0.5 - (np.arange(to)[:, None] + 0.5) * step) / max(step, 1.0))
        got = np.zeros((to, size))
        np.add.at(got, (np.arange(to)[:, None], at), weight)
        assert np.allclose(got, want / want.sum(axis=1, keepdims=True)) and at.shape[1] <= 2 * max(step, 1) + 3


def test_thumbnails_are_made_in_many_tasks(spark):
    """One small file of numbers is many pictures."""
    made = QUERIES["thumbnail_pipeline"](spark, "/root/testdata/sf0.1")
    assert made.rdd.getNumPartitions() >= 8

"""Pixels of thumbnails in numpy: PNG in and out, resizing, canvas, edges, sharpening, vignette, colour maps. Arrays are height x width x channels, 8 bits."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

#: Canvas, the share of it that must be filled, what an image may grow for it, side up to which an image is pixel art, vignette.
WIDTH, HEIGHT, LEAST_FILL, BUDGET, PIXEL_ART, VIGNETTE = 250, 200, 0.6, 0.1, 100, 0.25
#: Page edges' two colours, and a geometry's three tones.
GOLD, PURPLE = (236, 212, 155), (98, 80, 138)
SHADOW, MID, HIGH = (84.0, 54.0, 146.0), (184.0, 150.0, 100.0), (210.0, 185.0, 140.0)
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Pixels that a PNG may have.
MOST_PIXELS = 1 << 26


def encode_png(img: np.ndarray) -> bytes:
    """8-bit grey, RGB or RGBA as PNG."""
    h, w, channels = img.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    rows = np.concatenate([np.zeros((h, 1), np.uint8), img.reshape(h, w * channels)], axis=1)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_png(b: bytes) -> np.ndarray | None:
    """Pixels of a PNG file of 8 bits a sample or a palette, not interlaced; None for others and damaged ones."""
    if b[:8] != _SIGNATURE or len(b) < 33:
        return None
    w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", b[16:29])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if channels is None or depth != 8 or interlaced or not 0 < w * h <= MOST_PIXELS:
        return None
    at, packed, palette = 8, [], None
    while at + 12 <= len(b):
        size, kind = int.from_bytes(b[at : at + 4], "big"), b[at + 4 : at + 8]
        if kind == b"IDAT":
            packed.append(b[at + 8 : at + 8 + size])
        elif kind == b"PLTE":
            palette = np.frombuffer(b[at + 8 : at + 8 + size // 3 * 3], np.uint8).reshape(-1, 3)
        at += 12 + size
    stride = w * channels
    try:
        raw = zlib.decompressobj().decompress(b"".join(packed), h * (stride + 1))
    except zlib.error:
        return None
    if len(raw) < h * (stride + 1):
        return None
    lines = np.frombuffer(raw, np.uint8).reshape(h, stride + 1)
    out, above = np.empty((h, stride), np.uint8), np.zeros(stride, np.uint8)
    for y in range(h):
        above = _unfilter(int(lines[y, 0]), lines[y, 1:], above, channels)
        if above is None:
            return None
        out[y] = above
    if colour == 3:
        return palette[np.minimum(out, len(palette) - 1)] if palette is not None and len(palette) else None
    return out.reshape(h, w, channels)


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray | None:
    """A PNG line from its filtered form and the line above."""
    if kind == 0:
        return line.copy()
    if kind == 1:
        return np.cumsum(line.reshape(-1, step).astype(np.uint32), axis=0).astype(np.uint8).ravel()
    if kind == 2:
        return line + above
    if kind > 4:
        return None
    cur, up, out = line.tolist(), above.tolist(), [0] * len(line)
    for i, x in enumerate(cur):
        a, c = (out[i - step], up[i - step]) if i >= step else (0, 0)
        if kind == 3:
            guess = (a + up[i]) >> 1
        else:
            p = a + up[i] - c
            guess = min((abs(p - v), n, v) for n, v in enumerate((a, up[i], c)))[2]
        out[i] = (x + guess) & 255
    return np.array(out, np.uint8)


def _taps(size: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Triangle weights: for each of ``to`` pixels those of ``size`` that it is made of, and their shares. The filter is as wide as a step where the image shrinks, two pixels where it grows."""
    step = size / to
    reach = max(step, 1.0)
    centre = ((np.arange(to) + 0.5) * step)[:, None]
    at = np.maximum(np.floor(centre - reach - 0.5), 0).astype(int) + np.arange(math.floor(2 * reach) + 3)
    weight = np.where(at < size, np.maximum(0.0, 1.0 - np.abs(at + 0.5 - centre) / reach), 0.0)
    return np.minimum(at, size - 1), weight / weight.sum(axis=1, keepdims=True)


def _weighted(img: np.ndarray, to: int) -> np.ndarray:
    """Rows of ``img`` to ``to`` rows, tap by tap: work follows the pixels that have a weight."""
    at, weight = _taps(img.shape[0], to)
    return sum(w.reshape(-1, *[1] * (img.ndim - 1)) * img[i] for i, w in zip(at.T, weight.T, strict=True))


def resize(img: np.ndarray, w: int, h: int, nearest: bool = False) -> np.ndarray:
    """To ``w`` by ``h``: nearest pixels, or a triangle filter, over colours multiplied by their alpha."""
    if nearest:
        y, x = (np.minimum(((np.arange(n) + 0.5) * s / n).astype(int), s - 1) for n, s in ((h, img.shape[0]), (w, img.shape[1])))
        return img[y][:, x]
    src = premultiply(img) if img.shape[2] == 4 else img
    out = _weighted(_weighted(src, h).swapaxes(0, 1), w).swapaxes(0, 1)
    out = np.floor(np.clip(out, 0, 255) + 0.5).astype(np.uint8)
    return unpremultiply(out) if img.shape[2] == 4 else out


def premultiply(img: np.ndarray) -> np.ndarray:
    a = img[..., 3:].astype(np.uint32)
    return np.concatenate([(img[..., :3] * a + 127) // 255, a], axis=2).astype(np.uint8)


def unpremultiply(img: np.ndarray) -> np.ndarray:
    a = img[..., 3:].astype(np.uint32)
    colour = np.where(a > 0, np.minimum((img[..., :3].astype(np.uint32) * 255 + a // 2) // np.maximum(a, 1), 255), img[..., :3])
    return np.concatenate([colour, a], axis=2).astype(np.uint8)


def box_half(img: np.ndarray) -> np.ndarray:
    """Half the size: means of four pixels, halves up; a last odd row or column is dropped."""
    x = img[: img.shape[0] // 2 * 2, : img.shape[1] // 2 * 2].astype(np.uint16)
    return ((x[::2, ::2] + x[1::2, ::2] + x[::2, 1::2] + x[1::2, 1::2] + 2) >> 2).astype(np.uint8)


def pre_scale(img: np.ndarray, w: int = WIDTH, h: int = HEIGHT) -> np.ndarray:
    """Halved while both sides keep twice the target."""
    while img.shape[1] // 2 >= 2 * w and img.shape[0] // 2 >= 2 * h:
        img = box_half(img)
    return img


def geometry(w: int, h: int, tw: int = WIDTH, th: int = HEIGHT) -> tuple[int, int, int, int, int, int]:
    """resize_w, resize_h, crop_x, crop_y, crop_w, crop_h: see the query ``fit_to_target_vectors``. In 32-bit floats."""
    f = np.float32
    near = lambda x: int(math.floor(float(f(x)) + 0.5))
    min_w, min_h = round(tw * LEAST_FILL), round(th * LEAST_FILL)
    inside, filling = min(f(tw) / f(w), f(th) / f(h)), max(f(tw) / f(w), f(th) / f(h))
    if min(max(near(f(h) * inside), 1), th) < min_h:
        rw, rh = max(tw, near(f(w) * (f(min_h) / f(h)))), min_h
    elif min(max(near(f(w) * inside), 1), tw) < min_w:
        rw, rh = min_w, max(th, near(f(h) * (f(min_w) / f(w))))
    else:
        scale = filling if f(1) <= f(w) / f(h) <= f(1.5) else min(filling, inside / (f(1) - f(BUDGET)))
        rw, rh = max(1, near(f(w) * scale)), max(1, near(f(h) * scale))
    cw, ch = min(rw, tw), min(rh, th)
    return rw, rh, (rw - cw) // 2, int((rh - ch) * 0.25), cw, ch


def fit(img: np.ndarray, pixel_art: bool = False) -> np.ndarray:
    """Resized and cropped for the canvas. An image that is nearly there, and inside, stays as it is."""
    h, w = img.shape[:2]
    rw, rh, x, y, cw, ch = geometry(w, h)
    crop = (cw, ch) != (rw, rh)
    trivial = not pixel_art and not crop and w <= rw and h <= rh and abs(np.float32(rw) / np.float32(w) - 1) <= 0.06 and abs(rw - w) <= 8
    out = img if trivial or (rw, rh) == (w, h) else resize(img, rw, rh, pixel_art)
    return out[y : y + ch, x : x + cw] if crop else out


def place(img: np.ndarray, background=(255, 255, 255), w: int = WIDTH, h: int = HEIGHT) -> np.ndarray:
    """In the middle of a canvas, as RGB: a colour, or an image of the canvas's size, shows through."""
    back = np.asarray(background, np.uint8)
    out = back.copy() if back.shape == (h, w, 3) else np.broadcast_to(back.reshape(-1, 3)[0], (h, w, 3)).copy()
    y, x = max(0, h - img.shape[0]) // 2, max(0, w - img.shape[1]) // 2
    under = out[y : y + img.shape[0], x : x + img.shape[1]]
    img = img[: under.shape[0], : under.shape[1]]
    if img.shape[2] == 4:
        a = img[..., 3:].astype(np.uint32)
        under[:] = (img[..., :3] * a + under * (255 - a) + 127) // 255
    else:
        under[:] = img[..., :3]
    return out


def unsharp(img: np.ndarray, sigma: float = 0.8, threshold: int = 5) -> np.ndarray:
    """Differences to a Gaussian blur above the threshold are added once more."""
    r = max(1, math.ceil(2 * sigma))
    g = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    g /= g.sum()
    x = np.pad(img.astype(np.float64), ((r, r), (r, r), (0, 0)), mode="edge")
    x = sum(k * x[i : i + img.shape[0]] for i, k in enumerate(g))
    blurred = np.floor(sum(k * x[:, i : i + img.shape[1]] for i, k in enumerate(g)) + 0.5).astype(int)
    diff = img.astype(int) - blurred
    return np.where(np.abs(diff) > threshold, np.clip(img.astype(int) + diff, 0, 255), img).astype(np.uint8)


def vignette(img: np.ndarray, strength: float = VIGNETTE) -> np.ndarray:
    """Darker by the squared distance from the centre, in 32-bit floats, cut off to whole numbers."""
    f = np.float32
    h, w = img.shape[:2]
    dy, dx = (np.arange(n, dtype=f) + f(0.5) - f(n) * f(0.5) for n in (h, w))
    most = (f(w) * f(0.5)) ** 2 + (f(h) * f(0.5)) ** 2
    factor = f(1) - f(strength) * ((dx[None, :] * dx[None, :] + dy[:, None] * dy[:, None]) / most)
    return (img.astype(f) * factor[..., None]).astype(np.uint8)


def wave(u: np.ndarray) -> np.ndarray:
    return np.interp(u, np.arange(7) / 6, [0.25, 0.0, 0.25, 0.5, 0.75, 1.0, 0.75])


def page_edges(img: np.ndarray, thickness: int) -> np.ndarray:
    """A striped border on the right and bottom edges, as a stack of pages: gold to purple along each edge, its far ends cut at 45 degrees."""
    n = min(max(thickness, 2), 10)
    h, w = img.shape[:2]
    out = img if img.shape[2] == 4 else np.concatenate([img, np.full((h, w, 1), 255, np.uint8)], axis=2)
    out = out.copy()
    nw, nh = min(n, w), min(n, h)
    y, x = np.mgrid[:h, :w]
    right, bottom = x >= w - nw, y >= h - nh
    cut = right & (y < nw) & (w - 1 - x + y < nw - 1) | bottom & (x < nh) & (x + h - 1 - y < nh - 1)
    face = right & ~(bottom & (w - 1 - x > h - 1 - y))
    t = np.where(face, wave(y / max(h - 1, 1)), 1.0 - wave(x / max(w - 1, 1)))[..., None]
    colour = np.floor(np.array(GOLD) + (np.array(PURPLE) - np.array(GOLD)) * t + 0.5).astype(np.uint32)
    dark = (np.where(face, x, y) % 2 == 0)[..., None]
    edge = np.concatenate([np.where(dark, colour * 7 // 10, colour * 9 // 10), np.full((h, w, 1), 255)], axis=2)
    out[right | bottom] = edge[right | bottom]
    out[cut] = 0
    return out


def oriented(img: np.ndarray, orientation: int) -> np.ndarray:
    """As an EXIF orientation of 1 to 8 says."""
    turned = np.rot90(img, {3: 2, 5: 3, 6: 3, 7: 1, 8: 1}.get(orientation, 0))
    flip = {2: np.s_[:, ::-1], 4: np.s_[::-1], 5: np.s_[:, ::-1], 7: np.s_[:, ::-1]}.get(orientation)
    return turned if flip is None else turned[flip]


def gamma(img: np.ndarray) -> np.ndarray:
    """Linear light to display values; alpha stays."""
    table = np.floor((np.arange(256) / 255.0) ** (1 / 2.2) * 255 + 0.5).astype(np.uint8)
    return np.concatenate([table[img[..., :3]], img[..., 3:]], axis=2)


def cmyk(img: np.ndarray) -> np.ndarray:
    x = 255 - img.astype(np.uint32)
    return (x[..., :3] * x[..., 3:] // 255).astype(np.uint8)


def tone_map(img: np.ndarray) -> np.ndarray:
    """Purple shadows to golden lights by brightness; alpha and transparent pixels stay."""
    step = lambda x: np.clip(x, 0.0, 1.0)
    smooth = lambda x: x * x * (3.0 - 2.0 * x)
    rgb = img[..., :3] / 255.0
    t = step((rgb @ np.array([0.2126, 0.7152, 0.0722]) - 0.5) * 1.28 + 0.5)[..., None]
    warm = np.array(MID) + (np.array(HIGH) - np.array(MID)) * step((t - 0.14) / 0.86)
    shadow, deep = smooth(step((0.58 - t) / 0.58)), step((0.30 - t) / 0.30) ** 2
    shift = np.concatenate([-(16.0 * shadow + 18.0 * deep), np.zeros_like(t), 26.0 * shadow + 28.0 * deep], axis=2)
    lift, shade = 1.01 + 0.20 * smooth(step((t - 0.10) / 0.90)), 0.80 + 0.30 * t
    out = np.clip((warm * (1 - shadow) + np.array(SHADOW) * shadow + shift) * lift * shade, 0, 255).astype(np.uint8)
    out = np.where(img[..., 3:] > 0, out, img[..., :3])
    return np.concatenate([out, img[..., 3:]], axis=2)


def contrast(img: np.ndarray, percent: float = 14.0) -> np.ndarray:
    """Away from the middle by a contrast setting; alpha stays."""
    k = ((100.0 + percent) / 100.0) ** 2
    out = np.clip(((img[..., :3] / 255.0 - 0.5) * k + 0.5) * 255.0, 0, 255).astype(np.uint8)
    return np.concatenate([out, img[..., 3:]], axis=2)


def autocrop(img: np.ndarray, border: int = 8) -> np.ndarray:
    """Without transparent margins but for a border; an image that is all transparent, or one line, stays."""
    rows, columns = (np.flatnonzero((img[..., 3] > 0).any(axis=a)) for a in (1, 0))
    if len(rows) < 2 or len(columns) < 2:
        return img
    return img[max(rows[0] - border, 0) : rows[-1] + border + 1, max(columns[0] - border, 0) : columns[-1] + border + 1]


def thumbnail(img: np.ndarray, page_edge: int = 0, background=(255, 255, 255)) -> np.ndarray:
    """The finished canvas of an image: fitted, edged, placed, sharpened (but for pixel art) and shaded."""
    img = img if img.shape[2] >= 3 else np.concatenate([np.repeat(img[..., :1], 3, axis=2), img[..., 1:]], axis=2)
    pixel_art = max(img.shape[:2]) <= PIXEL_ART
    out = fit(img, pixel_art)
    out = place(page_edges(out, page_edge) if page_edge >= 2 else out, background)
    return vignette(out if pixel_art else unsharp(out))

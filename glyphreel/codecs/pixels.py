"""Pixel conventions and image operators on (h, w, 4) uint8 arrays.

Decoders put straight colour bytes into a container that is read as premultiplied; the conversions below reproduce
that, modulo-256 wrap included, unless straight_alpha is asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import sub

import numpy as np


def _products() -> tuple[np.ndarray, np.ndarray]:
    a, c = np.arange(256, dtype=np.uint32)[:, None], np.arange(256, dtype=np.uint32)
    straight = np.where(a == 255, c, c * 0xFFFF // np.maximum(a, 1) >> 8 & 0xFF)
    straight[0] = 0
    return straight.astype(np.uint8), (c * (a * 0x101) // 0xFF >> 8).astype(np.uint8)


#: By alpha and colour; a look-up for each value costs less than its arithmetic on images of a few thousand pixels.
STRAIGHT, PREMULTIPLIED = _products()


def _opaque(rgba: np.ndarray) -> bool:
    return bool((rgba[..., 3] == 255).all())


def unpremultiply(rgba: np.ndarray) -> np.ndarray:
    """Premultiplied to straight; wraps where colour exceeds alpha. Fully opaque images are copied."""
    out = rgba.copy()
    if not _opaque(rgba):
        out[..., :3] = STRAIGHT[rgba[..., 3:], rgba[..., :3]]
    return out


def premultiply(nrgba: np.ndarray) -> np.ndarray:
    out = nrgba.copy()
    if not _opaque(nrgba):
        out[..., :3] = PREMULTIPLIED[nrgba[..., 3:], nrgba[..., :3]]
    return out


def over(below: np.ndarray, above: np.ndarray) -> np.ndarray:
    """above blended over below, both in the premultiplied container."""
    if _opaque(above):
        return above
    # 255 * 0x101 * 0xFFFF fits 32 bits
    s = above.astype(np.uint32) * 0x101
    keep = (0xFFFF - s[..., 3:]) * 0x101
    return ((below * keep // 0xFFFF + s) >> 8 & 0xFF).astype(np.uint8)


def blend_at(canvas: np.ndarray, sprite: np.ndarray, x: int, y: int) -> None:
    h, w = sprite.shape[:2]
    x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + w, canvas.shape[1]), min(y + h, canvas.shape[0])
    if x1 > x0 and y1 > y0:
        canvas[y0:y1, x0:x1] = over(canvas[y0:y1, x0:x1], sprite[y0 - y : y1 - y, x0 - x : x1 - x])


def bounding_box(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """(x0, y0, x1, y1), ends exclusive, of the true cells."""
    ys, xs = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    return (int(xs[0]), int(ys[0]), int(xs[-1]) + 1, int(ys[-1]) + 1) if len(xs) else None


def alpha_box(img: np.ndarray) -> tuple[int, int, int, int] | None:
    return bounding_box(img[..., 3] > 0) if img.size else None


def difference_box(img: np.ndarray, rgb: np.ndarray) -> tuple[int, int, int, int] | None:
    """Pixels whose colour differs from rgb; alpha doesn't count."""
    return bounding_box((img[..., :3] != rgb[:3]).any(axis=2)) if img.size else None


def crop(img: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    h, w = img.shape[:2]
    x0, y0, x1, y1 = max(box[0], 0), max(box[1], 0), min(box[2], w), min(box[3], h)
    return img[y0:y1, x0:x1].copy() if x1 > x0 and y1 > y0 else np.zeros((0, 0, 4), np.uint8)


def window(img: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """A w x h view at (x, y); what lies outside the image is transparent."""
    if w <= 0 or h <= 0:
        return np.zeros((0, 0, 4), np.uint8)
    out = np.zeros((h, w, 4), np.uint8)
    part = img[y : y + h, x : x + w]
    out[: part.shape[0], : part.shape[1]] = part
    return out


def crop_solid(img: np.ndarray) -> np.ndarray:
    """Without the border of one colour, if the four corners are one pixel value."""
    if img.size == 0:
        return img
    corner = img[0, 0]
    if any((c != corner).any() for c in (img[0, -1], img[-1, 0], img[-1, -1])):
        return img
    box = difference_box(img, corner)
    return crop(img, box) if box else img


def autocrop(img: np.ndarray, solid_fallback: bool = False) -> np.ndarray:
    box = alpha_box(img)
    if box is None:
        return img.copy()
    if box != (0, 0, img.shape[1], img.shape[0]):
        return crop(img, box)
    return crop_solid(img) if solid_fallback else img.copy()


def pad(img: np.ndarray, padding: int) -> np.ndarray:
    if padding < 0:
        raise ValueError("padding must be >= 0")
    h, w = img.shape[:2]
    out = np.zeros((h + 2 * padding, w + 2 * padding, 4), np.uint8)
    out[padding : padding + h, padding : padding + w] = img
    return out


def runs_of(row: np.ndarray) -> Iterator[tuple[int, int]]:
    """Values of a row from left to right, each with the length of its run."""
    if not len(row):
        return iter(())
    ends = ((row[1:] != row[:-1]).nonzero()[0] + 1).tolist()
    ends.append(len(row))
    begins = [0, *ends[:-1]]
    return zip(row[begins].tolist(), map(sub, ends, begins), strict=True)


def half_away(x: float) -> int:
    return math.floor(x + 0.5) if x >= 0 else math.ceil(x - 0.5)


def fitted_size(w: int, h: int, max_width: int) -> tuple[int, int]:
    if max_width <= 0:
        raise ValueError("max_width must be > 0")
    return (w, h) if w <= max_width else (max_width, max(1, half_away(h * (max_width / w))))


def bilinear(img: np.ndarray, w: int, h: int) -> np.ndarray:
    """Pixel-centre mapping, edge clamp, straight alpha, the four nearest pixels, halves rounded away from zero."""
    if w <= 0 or h <= 0:
        return np.zeros((0, 0, 4), np.uint8)
    sh, sw = img.shape[:2]
    if not sh or not sw:
        return np.zeros((h, w, 4), np.uint8)

    def taps(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(n) + 0.5) * (size / n) - 0.5
        low = np.floor(at)
        return np.maximum(low, 0).astype(int), np.minimum(low + 1, size - 1).astype(int), at - low

    x0, x1, wx = taps(w, sw)
    y0, y1, wy = taps(h, sh)
    f = img.astype(np.float64)
    wx, wy = wx[None, :, None], wy[:, None, None]
    rows = []
    for y in (y0, y1):
        a, b = f[y][:, x0], f[y][:, x1]
        rows.append(a + (b - a) * wx)
    value = rows[0] + (rows[1] - rows[0]) * wy
    return np.floor(np.clip(value, 0, 255) + 0.5).astype(np.uint8)


def fit_width(img: np.ndarray, max_width: int) -> np.ndarray:
    h, w = img.shape[:2]
    nw, nh = fitted_size(w, h, max_width)
    return img.copy() if (nw, nh) == (w, h) else bilinear(img, nw, nh)


def whiten(img: np.ndarray) -> np.ndarray:
    out = img.copy()
    out[..., :3][img[..., 3] != 0] = 255
    return out


def preprocess(rgba: np.ndarray, max_width: int = 1080, padding: int = 10, force_white: bool = False, solid_fallback: bool = False, straight_alpha: bool = False) -> np.ndarray:
    """Crop, pad, shrink, whiten: padding counts against the width. In and out in the premultiplied container."""
    img = rgba if straight_alpha else unpremultiply(rgba)
    img = fit_width(pad(autocrop(img, solid_fallback), padding), max_width)
    return premultiply(whiten(img) if force_white else img)

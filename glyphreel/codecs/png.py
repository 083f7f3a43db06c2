"""PNG: 8-bit colour with or without alpha out; grey, colour, palette and alpha images of 8 bits in."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from glyphreel.codecs.pixels import unpremultiply

MAGIC = b"\x89PNG\r\n\x1a\n"


class PngError(ValueError):
    pass


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def encode(rgba: np.ndarray) -> bytes:
    """From the premultiplied container; alpha goes if every pixel is opaque."""
    h, w = rgba.shape[:2]
    if not h or not w:
        raise PngError(f"invalid size {w}x{h}")
    opaque = bool((rgba[..., 3] == 255).all())
    px = rgba[..., :3] if opaque else unpremultiply(rgba)
    flat = np.ascontiguousarray(px).reshape(h, -1)
    rows = np.zeros((h, flat.shape[1] + 1), np.uint8)
    rows[:, 1:] = flat
    rows[1:, 0] = 2
    rows[1:, 1:] -= flat[:-1]
    return MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if opaque else 6, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """(h, w, 4) straight pixels."""
    if data[:8] != MAGIC:
        raise PngError("not a PNG file")
    at, head, packed, palette, fade, ended = 8, None, [], None, b"", False
    while at + 12 <= len(data) and not ended:
        (n,) = struct.unpack_from(">I", data, at)
        name, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) != n or at + 12 + n > len(data) or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(name + body):
            raise PngError(f"damaged chunk {name!r}")
        at += 12 + n
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            packed.append(body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            fade = body
        ended = name == b"IEND"
    if not head or not ended:
        raise PngError("truncated")
    w, h, depth, colour, _, _, laced = head
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour, 0)
    if depth != 8 or laced or not n:
        raise PngError("only 8-bit images that aren't interlaced are read")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise PngError(str(e)) from e
    if len(raw) != h * (w * n + 1):
        raise PngError("wrong amount of pixels")
    rows = raw.reshape(h, w * n + 1)
    px = np.zeros((h, w * n), np.uint8)
    for y in range(h):
        kind, line, above = rows[y, 0], rows[y, 1:], px[y - 1] if y else np.zeros(w * n, np.uint8)
        if kind == 0:
            px[y] = line
        elif kind == 1:
            px[y] = np.cumsum(line.reshape(w, n), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            px[y] = line + above
        elif kind in (3, 4):
            out, up = line.tolist(), above.tolist()
            for i in range(len(out)):
                a, c = (out[i - n], up[i - n]) if i >= n else (0, 0)
                guess = (a + up[i]) // 2 if kind == 3 else min((a, up[i], c), key=lambda v, p=a + up[i] - c: abs(p - v))
                out[i] = (out[i] + guess) & 255
            px[y] = out
        else:
            raise PngError(f"row filter {kind}")
    px = px.reshape(h, w, n)
    out = np.full((h, w, 4), 255, np.uint8)
    if colour == 3:
        if palette is None:
            raise PngError("no palette")
        out[..., :3] = palette[px[..., 0]]
        if fade:
            alpha = np.full(256, 255, np.uint8)
            alpha[: len(fade)] = np.frombuffer(fade, np.uint8)
            out[..., 3] = alpha[px[..., 0]]
    else:
        out[..., :3] = px[..., :1] if n < 3 else px[..., :3]
        if n in (2, 4):
            out[..., 3] = px[..., -1]
    return out

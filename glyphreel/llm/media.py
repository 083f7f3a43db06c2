"""Media columns: texts kept as 8-bit grey PNG images in a binary column, read back, and hashed by low frequencies.

The writer filters bands of rows and deflates them into IDAT chunks; the reader tests the signature, the checksum of
each chunk and the sizes, inflates and undoes the five row filters with numpy. The feature is a hash of the image's
8 x 8 lowest cosine-transform coefficients.

Cases: null is read as the empty text, whose payload is one row of 64 zero bytes; equal texts give equal values; a
damaged file raises BadImage (in `read_column`, a null image gives null values); filters that cost alike are tied by their
number; repeated rows give equal rows; an empty table gives no rows; extra columns aren't read. Beside the text, its
payload and the stored form, a long text needs room for a few bands only.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from glyphreel.llm.common import map_text, table

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
CHUNK = 1 << 16
BAND = 64
#: Bands that are filtered at once.
BANDS = 64


class BadImage(ValueError):
    pass


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def write_png(pixels: np.ndarray, level: int = 6) -> bytes:
    """A grey image of uint8 rows. Each band of rows takes the one of no, left and upper filter with least sum of differences."""
    h, w = pixels.shape
    deflate, parts = zlib.compressobj(level), []
    for at in range(0, h, BANDS * BAND):
        band = pixels[at : at + BANDS * BAND]
        left = band.copy()
        left[:, 1:] -= band[:, :-1]
        upper = band.copy()
        upper[1:] -= band[:-1]
        if at:
            upper[0] -= pixels[at - 1]
        starts = np.arange(0, len(band), BAND)
        cost = [np.add.reduceat(np.abs(x.view(np.int8).astype(np.int32)).sum(1), starts) for x in (band, left, upper)]
        best = np.repeat(np.argmin(np.stack(cost), 0), np.diff([*starts, len(band)])).astype(np.uint8)
        rows = np.empty((len(band), w + 1), np.uint8)
        rows[:, 0] = best
        for k, x in enumerate((band, left, upper)):
            rows[best == k, 1:] = x[best == k]
        parts.append(deflate.compress(rows.tobytes()))
    packed = b"".join([*parts, deflate.flush()])
    body = b"".join(chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + body + chunk(b"IEND", b"")


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise BadImage("no PNG signature")
    at, found = 8, []
    while at < len(data):
        if at + 12 > len(data):
            raise BadImage("truncated chunk")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body, end = data[at + 4 : at + 8], data[at + 8 : at + 8 + n], at + 12 + n
        if end > len(data):
            raise BadImage("truncated chunk")
        if struct.unpack_from(">I", data, end - 4)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise BadImage(f"checksum of {kind!r}")
        found.append((kind, body))
        at = end
        if kind == b"IEND":
            return found
    raise BadImage("no IEND")


def paeth_row(row: np.ndarray, above: np.ndarray, step: int) -> None:
    for i in range(len(row)):
        a, b, c = (int(row[i - step]), int(above[i]), int(above[i - step])) if i >= step else (0, int(above[i]), 0)
        p = a + b - c
        da, db, dc = abs(p - a), abs(p - b), abs(p - c)
        row[i] = (int(row[i]) + (a if da <= db and da <= dc else b if db <= dc else c)) & 255


def average_row(row: np.ndarray, above: np.ndarray, step: int) -> None:
    for i in range(len(row)):
        row[i] = (int(row[i]) + ((int(row[i - step]) if i >= step else 0) + int(above[i])) // 2) & 255


def unfilter(rows: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Rows of like filter are undone together: the left filter is a running sum along rows, the upper one down them."""
    out = rows.copy()
    h, w = out.shape
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1), h]
    for a, b in zip(edges, edges[1:], strict=False):
        kind = kinds[a]
        above = out[a - 1] if a else np.zeros(w, np.uint8)
        if kind == 1:
            out[a:b] = np.cumsum(out[a:b].reshape(b - a, w // step, step), axis=1, dtype=np.uint8).reshape(b - a, w)
        elif kind == 2:
            out[a] += above
            np.cumsum(out[a:b], axis=0, dtype=np.uint8, out=out[a:b])
        elif kind in (3, 4):
            for r in range(a, b):
                (average_row if kind == 3 else paeth_row)(out[r], out[r - 1] if r else above, step)
        elif kind:
            raise BadImage(f"row filter {kind}")
    return out


def read_png(data: bytes) -> np.ndarray:
    """uint8 pixels of a not interlaced image of 8 bits a channel: (h, w) for grey, else (h, w, channels)."""
    parts = chunks(data)
    if not parts or parts[0][0] != b"IHDR" or len(parts[0][1]) != 13:
        raise BadImage("no IHDR")
    w, h, depth, colour, method, filters, interlaced = struct.unpack(">IIBBBBB", parts[0][1])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or method or filters or interlaced or not w or not h:
        raise BadImage("unsupported kind of image")
    try:
        raw = zlib.decompress(b"".join(b for k, b in parts if k == b"IDAT"))
    except zlib.error as e:
        raise BadImage(str(e)) from e
    if len(raw) != h * (w * channels + 1):
        raise BadImage("wrong amount of data")
    rows = np.frombuffer(raw, np.uint8).reshape(h, -1)
    out = unfilter(rows[:, 1:], rows[:, 0], channels)
    return out if channels == 1 else out.reshape(h, w, channels)


_SIDE, _LOW = 32, 8
_COSINE = np.cos(np.pi / _SIDE * (np.arange(_SIDE) + 0.5)[None, :] * np.arange(_LOW)[:, None])


def cosine_hash(pixels: np.ndarray) -> str:
    """16 hex digits: which of the 64 lowest coefficients of the 32 x 32 image exceed their median."""
    grey = pixels if pixels.ndim == 2 else pixels[..., :3].mean(2)
    small = grey
    for axis in (0, 1):
        n = small.shape[axis]
        a = np.arange(_SIDE) * n // _SIDE
        b = np.maximum(a + 1, (np.arange(_SIDE) + 1) * n // _SIDE)
        # sums of runs, without an array of all running sums
        small = np.stack([(small[i:j] if axis == 0 else small[:, i:j]).sum(axis, dtype=np.float64) / (j - i) for i, j in zip(a.tolist(), b.tolist(), strict=True)], axis)
    low = np.round(_COSINE @ small @ _COSINE.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def payload(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "replace")
    return len(data), data + b"\0" * (max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def media_column(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, n_bytes and media (binary): each text as an image."""

    def make():
        def one(t):
            n, data = payload(t)
            return n, write_png(np.frombuffer(data, np.uint8).reshape(-1, WIDTH))

        return one

    return map_text(docs, keys, text, make, "n_bytes long, media binary")


def read_column(media: DataFrame, keys: list[str], column: str = "media") -> DataFrame:
    """keys and what the stored images hold: sizes, digests and the feature."""

    def make():
        def one(data):
            if data is None:
                return (None,) * 6
            pixels = read_png(data)
            raw = pixels.tobytes()
            return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(pixels)

        return one

    return map_text(media, keys, column, make, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_column(media_column(table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id", "n_bytes"])

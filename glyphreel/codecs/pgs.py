"""Presentation graphic streams: segments, palettes, run lengths, display sets."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from glyphreel.codecs.pixels import blend_at, runs_of, window

PCS, PDS, ODS, END = 0x16, 0x14, 0x15, 0x80


class PgsError(ValueError):
    pass


def u16(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 2], "big")


def u24(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 3], "big")


def split_segments(data: bytes) -> list[tuple[int, int, int, bytes]]:
    """(byte offset, PTS in 90 kHz ticks, type, body); any damage fails the file."""
    found, at = [], 0
    while at < len(data):
        if at + 13 > len(data):
            raise PgsError(f"truncated header at {at}")
        if data[at : at + 2] != b"PG":
            raise PgsError(f"bad magic at {at}")
        size = u16(data, at + 11)
        if at + 13 + size > len(data):
            raise PgsError(f"truncated body at {at}")
        found.append((at, int.from_bytes(data[at + 2 : at + 6], "big"), data[at + 10], data[at + 13 : at + 13 + size]))
        at += 13 + size
    return found


def decode_runs(data: bytes, width: int, height: int) -> np.ndarray:
    """(height, width) palette indexes. A row ends at its end-of-line mark only; what overflows a row is dropped."""
    if width <= 0 or height <= 0:
        return np.zeros((0, 0), np.uint8)
    out = np.zeros((height, width), np.uint8)
    x = y = i = 0
    n = len(data)
    while i < n and y < height:
        value = data[i]
        i += 1
        run = 1
        if value == 0:
            if i >= n:
                break
            flag = data[i]
            i += 1
            if flag == 0:
                x, y = 0, y + 1
                continue
            tail = 1 if 0x40 <= flag < 0xC0 else 2 if flag >= 0xC0 else 0
            if i + tail > n:
                continue  # a cut-off run gives no pixel; bytes left are read afresh
            run = flag & 0x3F
            if flag & 0x40:
                run = run << 8 | data[i]
            value = data[i + tail - 1] if flag & 0x80 else 0
            i += tail
        end = min(width, x + run)
        if end > x:
            out[y, x:end] = value
            x = end
    return out


def encode_runs(pixels: np.ndarray) -> bytes:
    """The inverse of decode_runs."""
    out = bytearray()
    for row in pixels:
        for value, left in runs_of(row):
            while left:
                run = min(left, 0x3FFF)
                left -= run
                if value and run < 3:
                    out += bytes([value]) * run
                elif value:
                    out += bytes([0, 0x80 | run, value]) if run < 64 else bytes([0, 0xC0 | run >> 8, run & 255, value])
                else:
                    out += bytes([0, run]) if run < 64 else bytes([0, 0x40 | run >> 8, run & 255])
        out += b"\0\0"
    return bytes(out)


def ycbcr_to_rgba(y: int, cb: int, cr: int, alpha: int) -> tuple[int, int, int, int]:
    c, d, e = y - 16, cb - 128, cr - 128
    r, g, b = (298 * c + 409 * e + 128) >> 8, (298 * c - 100 * d - 208 * e + 128) >> 8, (298 * c + 516 * d + 128) >> 8
    return min(255, max(0, r)), min(255, max(0, g)), min(255, max(0, b)), alpha


Palette = dict[int, tuple[int, int, int, int]]  # index -> y, cb, cr, alpha


def parse_palette(body: bytes) -> tuple[int, Palette]:
    if len(body) < 2:
        raise PgsError(f"palette packet of {len(body)} bytes")
    return body[0], {body[i]: (body[i + 1], body[i + 3], body[i + 2], body[i + 4]) for i in range(2, len(body) - 4, 5)}


@dataclass(frozen=True)
class Placed:
    object_id: int
    x: int
    y: int
    crop: tuple[int, int, int, int] | None = None


@dataclass(frozen=True)
class Composition:
    pts90k: int
    palette_id: int
    objects: tuple[Placed, ...]


def parse_composition(body: bytes, pts90k: int) -> Composition:
    if len(body) < 11:
        raise PgsError(f"composition packet of {len(body)} bytes")
    objects, at = [], 11
    for _ in range(body[10]):
        if at + 8 > len(body):
            break
        cropped = body[at + 3] & 0x40
        if cropped and at + 16 > len(body):
            break
        crop = tuple(u16(body, at + k) for k in (8, 10, 12, 14)) if cropped else None
        objects.append(Placed(u16(body, at), u16(body, at + 4), u16(body, at + 6), crop))
        at += 16 if cropped else 8
    return Composition(pts90k, body[9], tuple(objects))


@dataclass(frozen=True)
class Bitmap:
    width: int
    height: int
    rle: bytes


def render(bitmap: Bitmap, palette: Palette | None) -> np.ndarray:
    table = np.zeros((256, 4), np.uint8)
    for i, (y, cb, cr, a) in (palette or {}).items():
        table[i] = ycbcr_to_rgba(y, cb, cr, a)
    return table[decode_runs(bitmap.rle, bitmap.width, bitmap.height)]


@dataclass
class Decoder:
    """Folds the segments of one stream in order; feed() returns a frame where a display set shows something.

    The end of a display set resets the composition only; palettes and objects stay in force.
    """

    palettes: dict[int, Palette] = field(default_factory=dict)
    objects: dict[int, Bitmap] = field(default_factory=dict)
    partial: dict[int, tuple[int, int, int, bytearray]] = field(default_factory=dict)
    shown: Composition | None = None

    def feed(self, pts90k: int, kind: int, body: bytes) -> tuple[int, np.ndarray] | None:
        if kind == PCS:
            self.shown = parse_composition(body, pts90k)
        elif kind == PDS:
            number, palette = parse_palette(body)
            self.palettes[number] = palette
        elif kind == ODS:
            self.add_object(body)
        elif kind == END:
            shown, self.shown = self.shown, None
            if shown:
                frame = self.compose(shown)
                return None if frame is None else (shown.pts90k, frame)
        return None

    def add_object(self, body: bytes) -> None:
        if len(body) < 4:
            raise PgsError(f"object packet of {len(body)} bytes")
        number, flag = u16(body, 0), body[3]
        if flag in (0x80, 0xC0):
            if len(body) < 11:
                raise PgsError(f"first object packet of {len(body)} bytes")
            size = u24(body, 4)
            self.partial[number] = (u16(body, 7), u16(body, 9), size - 4 if size >= 4 else size, bytearray(body[11:]))
        elif number in self.partial:
            self.partial[number][3].extend(body[4:])
        else:
            return
        if flag in (0x40, 0xC0):
            w, h, size, data = self.partial.pop(number)
            self.objects[number] = Bitmap(w, h, bytes(data[:size]))

    def compose(self, shown: Composition) -> np.ndarray | None:
        if not shown.objects:
            return None
        left, top = min(o.x for o in shown.objects), min(o.y for o in shown.objects)
        right, bottom = shown.objects[0].x, shown.objects[0].y
        sprites = []
        for o in shown.objects:
            if o.object_id not in self.objects:
                continue
            sprite = render(self.objects[o.object_id], self.palettes.get(shown.palette_id))
            if sprite.size == 0:
                b = self.objects[o.object_id]
                sprite = np.zeros((b.height, b.width, 4), np.uint8)
            if o.crop:
                sprite = window(sprite, *o.crop)
            sprites.append((o, sprite))
            right, bottom = max(right, o.x + sprite.shape[1]), max(bottom, o.y + sprite.shape[0])
        if not sprites:
            return None
        canvas = np.zeros((bottom - top, right - left, 4), np.uint8)
        for o, sprite in sprites:
            blend_at(canvas, sprite, o.x - left, o.y - top)
        return canvas


def ticks_to_ms(pts90k: int) -> int:
    return (pts90k + 45) // 90


def segment(pts90k: int, kind: int, body: bytes) -> bytes:
    return b"PG" + (pts90k & 0xFFFFFFFF).to_bytes(4, "big") + bytes(4) + bytes([kind]) + len(body).to_bytes(2, "big") + body


def pcs_body(palette_id: int, objects: list[Placed]) -> bytes:
    out = bytes(9) + bytes([palette_id, len(objects)])
    for o in objects:
        out += o.object_id.to_bytes(2, "big") + bytes([0, 0x40 if o.crop else 0]) + o.x.to_bytes(2, "big") + o.y.to_bytes(2, "big")
        out += b"".join(v.to_bytes(2, "big") for v in o.crop or ())
    return out


def pds_body(palette_id: int, palette: Palette) -> bytes:
    return bytes([palette_id, 0]) + b"".join(bytes([i, y, cr, cb, a]) for i, (y, cb, cr, a) in palette.items())


def ods_bodies(object_id: int, pixels: np.ndarray, part: int = 60_000) -> list[bytes]:
    rle = encode_runs(pixels)
    pieces = [rle[i : i + part] for i in range(0, max(len(rle), 1), part)]
    out = []
    for i, piece in enumerate(pieces):
        flag = (0x80 if i == 0 else 0) | (0x40 if i == len(pieces) - 1 else 0)
        head = (len(rle) + 4).to_bytes(3, "big") + pixels.shape[1].to_bytes(2, "big") + pixels.shape[0].to_bytes(2, "big") if i == 0 else b""
        out.append(object_id.to_bytes(2, "big") + bytes([0, flag]) + head + piece)
    return out

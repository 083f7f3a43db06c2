"""DVD subtitle units: packets of a private stream, control sequences, two-bit run lengths of two fields."""

from __future__ import annotations

import math

import numpy as np

from glyphreel.codecs.pixels import runs_of

MARK = b"\x00\x00\x01\xbd"


class SpuError(ValueError):
    pass


class NoPayload(SpuError):
    pass


def payload_start(data: bytes, a: int, b: int) -> int:
    """Behind the packet header in data[a:b], of either header form."""
    if a >= b:
        return b
    if data[a] & 0xC0 == 0x80:
        return min(b, a + 3 + data[a + 2])
    while a < b and data[a] == 0xFF:
        a += 1
    if a < b and data[a] & 0xC0 == 0x40:
        a += 2
    if a < b:
        skip = {0x20: 5, 0x30: 10}.get(data[a] & 0xF0, 1 if data[a] == 0x0F else 0)
        return min(b, a + skip) if skip else a
    return a


def merge_unit(data: bytes, start: int, end: int, stream: int = 0) -> bytes:
    """The unit whose parts lie in data[start:end]; stream 0 takes any subtitle stream.

    Raises NoPayload if there is none, SpuError if parts are missing.
    """
    start, end = max(start, 0), min(end, len(data))
    got, want, at = bytearray(), 0, start
    while at + 6 <= end:
        mark = data.find(MARK, at, end)
        if mark < 0:
            break
        at = mark + 4
        if mark + 6 > end:
            continue
        size = int.from_bytes(data[mark + 4 : mark + 6], "big")
        stop = min(end, mark + 6 + size) if size else end
        if mark + 9 > stop:
            continue
        first = payload_start(data, mark + 6, stop)
        if first >= stop:
            continue
        at = stop
        if 0x20 <= data[first] <= 0x3F and stream in (0, data[first]) and first + 1 < stop:
            got += data[first + 1 : stop]
            want = want or (int.from_bytes(got[:2], "big") if len(got) >= 2 else 0)
            if want and len(got) >= want:
                return bytes(got[:want])
    if len(got) < 2:
        raise NoPayload("no subtitle payload at idx filepos")
    if want > len(got):
        raise SpuError("incomplete subtitle payload between idx offsets")
    return bytes(got[:want])


def find_unit(data: bytes, start: int, end: int, stream: int) -> bytes:
    """The wanted stream's unit or, where it has none, that of any stream."""
    try:
        return merge_unit(data, start, end, stream)
    except NoPayload:
        return merge_unit(data, start, end)


#: Bytes behind each command.
NEEDS = {0: 0, 1: 0, 2: 0, 3: 2, 4: 2, 5: 6, 6: 4}


def read_control(unit: bytes) -> dict:
    """Colours, alphas, rectangle and field offsets; later sequences overwrite earlier ones."""
    c = {"colours": [0, 1, 2, 3], "alphas": [15] * 4, "rect": (0, 0, 0, 0), "fields": (0, 0)}
    at = int.from_bytes(unit[2:4], "big")
    while 0 < at and at + 4 <= len(unit):
        following, i = int.from_bytes(unit[at + 2 : at + 4], "big"), at + 4
        while i < len(unit):
            command, need = unit[i], NEEDS.get(unit[i], -1)
            b = unit[i + 1 : i + 1 + max(need, 0)]
            if need < 0 or len(b) < need:
                break
            if command in (3, 4):
                c["colours" if command == 3 else "alphas"] = [b[1] & 15, b[1] >> 4, b[0] & 15, b[0] >> 4]
            elif command == 5:
                c["rect"] = (b[0] << 4 | b[1] >> 4, b[3] << 4 | b[4] >> 4, (b[1] & 15) << 8 | b[2], (b[4] & 15) << 8 | b[5])
            elif command == 6:
                c["fields"] = (b[0] << 8 | b[1], b[2] << 8 | b[3])
            i += 1 + need
        if not at < following < len(unit):
            break
        at = following
    return c


def decode_field(unit: bytes, offset: int, width: int, rows: int) -> np.ndarray:
    """(rows, width) values 0 to 3. A run below 4 fills its row; a run beyond the row is an error; rows begin at bytes."""
    out = np.zeros((rows, width), np.uint8)
    at, end = 2 * offset, 2 * len(unit)
    for y in range(rows):
        x = 0
        while x < width:
            if at >= end:
                raise SpuError("RLE bitstream ended early")
            code, limit = 0, 1
            while code < limit <= 64:
                byte = unit[at >> 1] if at < end else 0
                code = code << 4 | (byte & 15 if at & 1 else byte >> 4)
                at += 1
                limit <<= 2
            run = code >> 2 if code >= 4 else width - x
            if run > width - x:
                raise SpuError(f"RLE run overflow: run={run} remain={width - x}")
            out[y, x : x + run] = code & 3
            x += run
        at += at & 1
    return out


def decode_unit(unit: bytes, palette: list[int]) -> np.ndarray:
    """(h, w, 4): even rows from the first field, odd rows from the second."""
    if len(unit) < 4:
        raise SpuError(f"SPU packet too short: {len(unit)}")
    size = int.from_bytes(unit[:2], "big")
    if size > len(unit):
        raise SpuError(f"incomplete SPU packet: expected {size} bytes, got {len(unit)}")
    unit = unit[:size]
    c = read_control(unit)
    x1, y1, x2, y2 = c["rect"]
    w, h = x2 - x1 + 1, y2 - y1 + 1
    if w <= 0 or h <= 0:
        raise SpuError(f"invalid VobSub dimensions: width={w} height={h}")
    if min(c["fields"]) <= 0:
        raise SpuError("missing VobSub bitmap offsets")
    if max(c["fields"]) >= len(unit):
        raise SpuError(f"VobSub bitmap offsets out of range: {c['fields']}")
    shades = (palette[k] if k < len(palette) else 0xFFFFFF for k in c["colours"])
    table = np.array([(rgb >> 16 & 255, rgb >> 8 & 255, rgb & 255, a * 17) for rgb, a in zip(shades, c["alphas"], strict=True)], np.uint8)
    pixels = np.zeros((h, w), np.uint8)
    pixels[0::2] = decode_field(unit, c["fields"][0], w, math.ceil(h / 2))
    pixels[1::2] = decode_field(unit, c["fields"][1], w, h // 2)
    return table[pixels]


def encode_field(rows: np.ndarray) -> bytes:
    out = bytearray()
    for row in rows:
        nibbles = []
        for colour, left in runs_of(row):
            while left:
                run = min(left, 255)
                left -= run
                code = run << 2 | colour
                nibbles.append("%0*X" % (1 if code < 16 else 2 if code < 64 else 3 if code < 256 else 4, code))
        text = "".join(nibbles)
        out += bytes.fromhex(text + "0" * (len(text) % 2))
    return bytes(out)


def encode_unit(pixels: np.ndarray, x: int = 0, y: int = 0, colours: tuple[int, ...] = (0, 1, 2, 3), alphas: tuple[int, ...] = (15, 15, 15, 15)) -> bytes:
    h, w = pixels.shape
    top, low = encode_field(pixels[0::2]), encode_field(pixels[1::2]) or b"\0"
    control = 4 + len(top) + len(low)
    x2, y2 = x + w - 1, y + h - 1
    rect = bytes([x >> 4, (x & 15) << 4 | x2 >> 8, x2 & 255, y >> 4, (y & 15) << 4 | y2 >> 8, y2 & 255])
    pair = lambda v: bytes([v[3] << 4 | v[2], v[1] << 4 | v[0]])
    tail = b"\0\0" + control.to_bytes(2, "big") + b"\3" + pair(colours) + b"\4" + pair(alphas) + b"\5" + rect + b"\6" + (4).to_bytes(2, "big") + (4 + len(top)).to_bytes(2, "big") + b"\xff"
    return (control + len(tail)).to_bytes(2, "big") + control.to_bytes(2, "big") + top + low + tail


def packets(unit: bytes, stream: int = 0x20, part: int = 2000) -> bytes:
    """The unit in packets, by turns with the old and the new header form."""
    out = b""
    for k, i in enumerate(range(0, len(unit), part)):
        head = b"\x0f" if k % 2 == 0 else b"\x80\x00\x00"
        body = head + bytes([stream]) + unit[i : i + part]
        out += MARK + len(body).to_bytes(2, "big") + body
    return out

"""Vectors of the formats, and round trips of made-up streams."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphreel.codecs import glyphs, pgs, pixels, png, vobsub

HEX = bytes.fromhex


@pytest.mark.parametrize(
    ("data", "w", "h", "want"),
    [
        ("00 84 01 00 00 00 84 01 00 00", 4, 2, [1] * 8),
        ("01 00 00", 4, 1, [1, 0, 0, 0]),
        ("00 02 07 00 00 00 40 03 09 00 00 00 82 05 00 00 00 C0 03 06 00 00", 4, 4, [0, 0, 7, 0, 0, 0, 0, 9, 5, 5, 0, 0, 6, 6, 6, 0]),
        ("00 40", 3, 1, [0, 0, 0]),
        ("00 86 04 00 00", 4, 1, [4] * 4),
        ("00 C1 05", 3, 1, [5, 0, 0]),
        ("01", 0, 2, []),
        ("01", 2, -1, []),
    ],
)
def test_pgs_runs(data, w, h, want):
    assert pgs.decode_runs(HEX(data), w, h).ravel().tolist() == want


rows = st.integers(1, 6).flatmap(lambda h: st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 300)), min_size=1, max_size=5), min_size=h, max_size=h))


def image(spec):
    lines = [[c for c, n in line for _ in range(n)] for line in spec]
    w = max(map(len, lines))
    return np.array([x + [0] * (w - len(x)) for x in lines], np.uint8)


@settings(max_examples=40, deadline=None)
@given(rows)
def test_round_trips(spec):
    px = image(spec)
    assert (pgs.decode_runs(pgs.encode_runs(px), px.shape[1], px.shape[0]) == px).all()
    unit = vobsub.encode_unit(px)
    got = vobsub.decode_unit(vobsub.find_unit(b"junk" + vobsub.packets(unit, 0x21, 60), 0, 1 << 30, 0x21), [0x010000, 0x020000, 0x030000, 0x040000])
    assert (got[..., 0] == px + 1).all() and (got[..., 3] == 255).all()


def frame_stream():
    seg = pgs.segment
    rle = b"\x01"
    ods = b"\0\1\0\xc0" + (len(rle) + 4).to_bytes(3, "big") + b"\0\1\0\1" + rle
    shown = pgs.pcs_body(0, [pgs.Placed(1, 10, 20)])
    return seg(0, pgs.PDS, pgs.pds_body(0, {1: (235, 128, 128, 255)})) + seg(0, pgs.ODS, ods) + seg(90000, pgs.PCS, shown) + seg(90000, pgs.END, b"") + seg(180000, pgs.PCS, shown) + seg(180000, pgs.END, b"")


def test_pgs_stream():
    d = pgs.Decoder()
    got = [f for s in pgs.split_segments(frame_stream()) if (f := d.feed(*s[1:]))]
    assert [(pgs.ticks_to_ms(t), f.shape, f[0, 0].tolist()) for t, f in got] == [(1000, (1, 1, 4), [255] * 4), (2000, (1, 1, 4), [255] * 4)]


@pytest.mark.parametrize("data", [b"XG" + bytes(11), pgs.segment(0, 0x80, b"abc")[:-1], pgs.segment(0, 0x80, b"") + b"\xff"])
def test_pgs_damage(data):
    with pytest.raises(pgs.PgsError):
        pgs.split_segments(data)


def test_object_in_parts_and_crop():
    px = np.arange(1, 241, dtype=np.uint8).reshape(12, 20)
    d = pgs.Decoder()
    for body in pgs.ods_bodies(7, px, 50):
        d.feed(0, pgs.ODS, body)
    d.feed(0, pgs.PDS, pgs.pds_body(3, {i: (16 + i % 200, 128, 128, 255) for i in range(256)}))
    d.feed(5, pgs.PCS, pgs.pcs_body(3, [pgs.Placed(7, 100, 50, (2, 3, 30, 4)), pgs.Placed(99, 90, 60)]))
    _, frame = d.feed(5, pgs.END, b"")
    assert frame.shape == (4, 40, 4)  # the box begins at the undefined object's left side
    assert frame[0, :10].sum() == 0 and (frame[0, 10:28, 3] == 255).all() and frame[0, 28:].sum() == 0
    assert d.feed(6, pgs.END, b"") is None  # nothing is composed any more


def test_render_absent_index():
    got = pgs.render(pgs.Bitmap(3, 1, HEX("01 02 03 00 00")), {1: (235, 128, 128, 255), 2: (16, 128, 128, 255)})
    assert got[0].tolist() == [[255] * 4, [0, 0, 0, 255], [0] * 4]


PACKET = HEX("00 19 00 08 90 A0 00 00 00 00 00 08 05 00 00 01 00 00 01 06 00 04 00 05 FF")
PALETTE = [0, 0xFF0000, 0x00FF00, 0x0000FF]


def test_vobsub_packet():
    data = HEX("00 00 01 BD 00 1B 0F 20") + PACKET
    got = vobsub.decode_unit(vobsub.find_unit(data, 0, len(data), 0x20), PALETTE)
    assert got[0].tolist() == [[255, 0, 0, 255]] * 2 and got[1].tolist() == [[0, 255, 0, 255]] * 2
    other = vobsub.packets(b"\0\4zz", 0x20) + vobsub.packets(PACKET, 0x21)
    assert vobsub.find_unit(other, 0, len(other), 0x21) == PACKET
    assert vobsub.find_unit(data, 0, len(data), 0x25) == PACKET  # falls back to any stream


def test_vobsub_field_and_headers():
    assert vobsub.decode_field(HEX("9A"), 0, 4, 1).tolist() == [[1, 1, 2, 2]]
    for head, want in (("FF FF 40 00 21 00 00 00 00 00", 9), ("30" + "00" * 9, 10), ("0F AA BB", 1), ("21 00 00", 3), ("80 00 02 00 00 00", 5)):
        assert vobsub.payload_start(HEX(head), 0, len(HEX(head))) == want


@pytest.mark.parametrize("unit", [HEX("00 02"), HEX("00 10 00 04"), PACKET[:11] + b"\x00\x00\xff", PACKET[:-4] + HEX("01 04 00 05")])
def test_vobsub_damage(unit):
    with pytest.raises(vobsub.SpuError):
        vobsub.decode_unit(unit, PALETTE)
    with pytest.raises(vobsub.NoPayload):
        vobsub.merge_unit(b"", 0, 0)


def box(h, w, y0, y1, x0, x1):
    img = np.zeros((h, w, 4), np.uint8)
    img[y0 : y1 + 1, x0 : x1 + 1] = 255
    return img


def test_crop_pad_resize():
    assert pixels.autocrop(box(10, 10, 3, 7, 2, 5)).shape == (5, 4, 4)
    solid = box(10, 12, 2, 7, 3, 8)
    solid[..., 3] = 255
    assert pixels.autocrop(solid, True).shape == (6, 6, 4) and pixels.autocrop(solid).shape == (10, 12, 4)
    solid[0, 0, :3] = 1
    assert pixels.autocrop(solid, True).shape == (10, 12, 4)
    assert pixels.fitted_size(2000, 1000, 1000) == (1000, 500)
    padded = pixels.pad(np.full((10, 20, 4), 255, np.uint8), 10)
    assert padded.shape == (30, 40, 4) and padded[0, 0, 3] == 0 and (padded[10, 10] == 255).all()
    for bad in (lambda: pixels.pad(solid, -1), lambda: pixels.fitted_size(1, 1, 0)):
        with pytest.raises(ValueError, match="must be"):
            bad()
    clear = np.tile(np.array([99, 88, 77, 0], np.uint8), (3, 4, 1))
    assert pixels.autocrop(pixels.unpremultiply(clear), True).sum() == 0


def test_alpha_conventions():
    one = lambda *v: np.array([[v]], np.uint8)
    assert pixels.unpremultiply(one(64, 32, 16, 128))[0, 0].tolist() == [127, 63, 31, 128]
    assert pixels.unpremultiply(one(255, 0, 0, 128))[0, 0].tolist() == [253, 0, 0, 128]  # wraps
    assert pixels.whiten(np.array([[[10, 20, 30, 0], [10, 20, 30, 128], [1, 2, 3, 255]]], np.uint8)).tolist() == [[[10, 20, 30, 0], [255, 255, 255, 128], [255] * 4]]


def test_bilinear_by_loop():
    import math

    src = np.random.default_rng(1).integers(0, 256, (13, 29, 4), dtype=np.uint8)
    got = pixels.bilinear(src, 11, 5)
    for y, x, c in np.ndindex(5, 11, 4):
        sx, sy = (x + 0.5) * 29 / 11 - 0.5, (y + 0.5) * 13 / 5 - 0.5
        x0, y0 = math.floor(sx), math.floor(sy)
        at = lambda j, i: float(src[min(max(j, 0), 12), min(max(i, 0), 28), c])
        top = at(y0, x0) + (at(y0, x0 + 1) - at(y0, x0)) * (sx - x0)
        low = at(y0 + 1, x0) + (at(y0 + 1, x0 + 1) - at(y0 + 1, x0)) * (sx - x0)
        assert abs(int(got[y, x, c]) - (top + (low - top) * (sy - y0))) <= 0.5 + 1e-9


def test_png_round_trip():
    img = np.random.default_rng(2).integers(0, 256, (7, 9, 4), dtype=np.uint8)
    img[..., 3] = 255
    assert (png.decode(png.encode(img)) == img).all()
    img[0, 0] = (10, 20, 30, 128)
    assert png.decode(png.encode(img))[0, 0].tolist() == pixels.unpremultiply(img)[0, 0].tolist()
    for bad in (b"", b"GIF89a", png.encode(img)[:-6], png.encode(img)[:23] + b"\xff" + png.encode(img)[24:]):
        with pytest.raises(png.PngError):
            png.decode(bad)


def test_separator_row():
    row = glyphs.separator_row(200, 27)
    assert row.shape == (27, 200, 4) and (row[..., 3] == 255).all() and 0 < (row[..., 0] == 0).sum() < 27 * 200 / 2
    assert (glyphs.separator_row(2, 9) == 255).all()


def test_row_without_pixels():
    assert pgs.encode_runs(np.zeros((1, 0), np.uint8)) == b"\0\0"
    assert [*pixels.runs_of(np.array([7, 7, 0, 9, 9, 9], np.uint8))] == [(7, 2), (0, 1), (9, 3)]

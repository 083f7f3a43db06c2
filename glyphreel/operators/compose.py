"""Sheets: geometry by windows over narrow columns, pixels pasted once for each sheet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from glyphreel import schemas
from glyphreel.codecs import glyphs, pixels, png
from glyphreel.operators import relational as R
from glyphreel.operators.frames import batched, rows_of

LAYOUTS = ("digits", "no-row-index")


def placements(frames: DataFrame, limit: int = 6) -> DataFrame:
    """Where each cue goes; only keys and sizes are read, so pixels are pruned from the scan and the shuffle."""
    return R.place_on_sheets(frames.select("stream_id", "cue_index", "width", "height"), ["stream_id"], ["cue_index"], limit)


def paste(rows: list[tuple[np.ndarray, int, int]], width: int, height: int, gap: int, layout: str) -> np.ndarray:
    """rows: image, x, y in order. Black, each image over it, a row of digits or of white between or below."""
    canvas = np.zeros((height, width, 4), np.uint8)
    canvas[..., 3] = 255
    between = glyphs.separator_row(width, gap) if layout == "digits" else 255
    for i, (img, x, y) in enumerate(rows):
        pixels.blend_at(canvas, img, x, y)
        a = y + img.shape[0]
        if layout == "digits":
            canvas[a : a + gap] = between
        elif i + 1 < len(rows):
            canvas[a : a + gap] = between
    return canvas


def compose(frames: DataFrame, limit: int = 6, layout: str = "digits", separator: int = 12) -> DataFrame:
    """Sheets of each stream as SHEET rows. A frame without area is an error."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown sheet layout {layout!r}")
    placed = R.cue_offsets(placements(frames, limit), ["stream_id", "sheet_no"], ["cue_index"], layout, separator)
    # never a broadcast: the planner takes decoded frames for as small as what they were decoded from
    wide = placed.hint("merge").join(frames.select("stream_id", "cue_index", "rgba"), ["stream_id", "cue_index"])

    columns = ("stream_id", "sheet", "position_in_sheet", "cue_index", "width", "height", "x", "y", "rgba")
    schema = schemas.struct(schemas.SHEET)
    arrow = to_arrow_schema(schema)

    def draw(cues: list[tuple]) -> tuple:
        stream, sheet = cues[0][0], cues[0][1]
        if any(c[4] <= 0 or c[5] <= 0 for c in cues):
            raise ValueError(f"{stream}: invalid frame size on {sheet}")
        gap = max(separator, min(c[5] for c in cues)) if layout == "digits" else separator
        w, h = max(c[4] for c in cues), sum(c[5] for c in cues) + gap * (len(cues) - (layout != "digits"))
        rows = [(np.frombuffer(c[8], np.uint8).reshape(c[5], c[4], 4), c[6], c[7]) for c in cues]
        return stream, sheet, w, h, png.encode(paste(rows, w, h, gap, layout)), [c[3] for c in cues]

    def sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[tuple] = []
        for cue in rows_of(batches, *columns):
            if held and cue[:2] != held[0][:2]:
                yield draw(held)
                held = []
            held.append(cue)
        if held:
            yield draw(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(sheets(batches), arrow)

    # one sheet's frames are held at a time
    ordered = wide.repartition("stream_id", "sheet_no").sortWithinPartitions("stream_id", "sheet_no", "position_in_sheet")
    return ordered.select(*columns).mapInArrow(run, schema)

"""Frames from bytes: one row a stream in, one row a frame out. A stream's fold is sequential, streams are parallel.

Pixels leave these tasks once, as raw RGBA, and only narrow columns go through windows and joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from glyphreel import schemas
from glyphreel.codecs import pgs, pixels, png, vobsub
from glyphreel.functions import exprs as E
from glyphreel.operators import relational as R


def pieces(batch: pa.RecordBatch, size: int = 1 << 20, most: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of about that many bytes: a whole batch, of up to 64 MB, must not become Python values at once."""
    step = max(1, min(most, size * batch.num_rows // max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows as tuples of the named columns."""
    for batch in batches:
        for part in pieces(batch):
            yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


def pgs_segments(files: DataFrame) -> DataFrame:
    """files: stream_id, content. One row for each packet, in order."""
    arrow = to_arrow_schema(schemas.struct(schemas.SEGMENT))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for stream, content in rows_of(batches, "stream_id", "content"):
            for n, segment in enumerate(pgs.split_segments(content)):
                yield stream, n, *segment

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(rows(batches), arrow)

    return files.select("stream_id", "content").mapInArrow(run, schemas.struct(schemas.SEGMENT))


def _fold(stream: str, segments: Iterator[tuple[int, int, bytes]], permissive: bool) -> list[tuple]:
    """Rows of SHOWN. One bad segment fails the stream: by an exception or, where permissive, by its error row alone."""
    rows, decoder = [], pgs.Decoder()
    try:
        for pts, kind, body in segments:
            got = decoder.feed(pts, kind, body)
            if got:
                h, w = got[1].shape[:2]
                rows.append((stream, len(rows) + 1, got[0], w, h, got[1].tobytes(), None))
    except pgs.PgsError as e:
        if not permissive:
            raise
        return [(stream, 0, None, None, None, None, f"{stream}: {e}")]
    return rows


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)


def batched(rows: Iterator[tuple], arrow: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows together up to some bytes of pixels: neither a batch for each frame nor all frames in one."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes)) + 64
        if size >= limit:
            yield _batch(held, arrow)
            held, size = [], 0
    if held:
        yield _batch(held, arrow)


def pgs_frames(files: DataFrame, permissive: bool = False) -> DataFrame:
    """Split and fold in one task for each stream, without a shuffle."""
    arrow = to_arrow_schema(schemas.struct(schemas.SHOWN))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for stream, content in rows_of(batches, "stream_id", "content"):
            try:
                segments = pgs.split_segments(content)
            except pgs.PgsError as e:
                if not permissive:
                    raise
                yield stream, 0, None, None, None, None, f"{stream}: {e}"
                continue
            yield from _fold(stream, iter(s[1:] for s in segments), permissive)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # short streams share a batch: one for each of them would cost more than its frames
        return batched(rows(batches), arrow)

    return files.select("stream_id", "content").mapInArrow(run, schemas.struct(schemas.SHOWN))


def fold_segments(segments: DataFrame, permissive: bool = False) -> DataFrame:
    """The same from a table of segments: one shuffle and sort by stream, then a fold that holds one stream's state at a time."""
    arrow = to_arrow_schema(schemas.struct(schemas.SHOWN))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, decoder, n, failed = None, pgs.Decoder(), 0, False
        for stream, pts, kind, body in rows_of(batches, "stream_id", "pts90k", "seg_type", "body"):
            if stream != now:
                now, decoder, n, failed = stream, pgs.Decoder(), 0, False
            if failed:
                continue
            try:
                got = decoder.feed(pts, kind, body)
            except pgs.PgsError as e:
                if not permissive:
                    raise
                failed = True
                yield stream, 0, None, None, None, None, f"{stream}: {e}"
                continue
            if got:
                n += 1
                yield stream, n, got[0], got[1].shape[1], got[1].shape[0], got[1].tobytes(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(rows(batches), arrow)

    out = segments.repartition("stream_id").sortWithinPartitions("stream_id", "seg_no").select("stream_id", "pts90k", "seg_type", "body").mapInArrow(run, schemas.struct(schemas.SHOWN))
    if not permissive:
        return out
    # frames before the damage go too
    bad = out.where("error is not null").select("stream_id").distinct()
    return out.where("error is not null").unionByName(out.where("error is null").join(bad, "stream_id", "left_anti"))


def timed_frames(shown: DataFrame) -> DataFrame:
    """Frames with their start, in stream order (not in the order of time)."""
    return shown.where("error is null").select("stream_id", F.col("frame_no").alias("cue_index"), E.ticks_to_ms("pts90k").alias("start_ms"), "width", "height", "rgba")


def shown_cues(shown: DataFrame) -> DataFrame:
    """Cues of frames in stream order (not in the order of time)."""
    narrow = timed_frames(shown).select("stream_id", "cue_index", "start_ms")
    return R.infer_ends(narrow, ["stream_id"], ["cue_index"]).select("stream_id", "cue_index", "start_ms", "end_ms")


def shown_frames(shown: DataFrame) -> DataFrame:
    return timed_frames(shown).drop("start_ms")


def palettes_in_force(segments: DataFrame) -> DataFrame:
    """stream_id, seg_no, palette_seg_no for each end of a display set: which palette packet it is drawn with.

    The as-of form of the fold: the composition is the last one since the set before, the palette the last packet of its
    number. It lets one very large stream decode its frames in parallel.
    """
    from pyspark.sql import Window as W

    flow = W.partitionBy("stream_id").orderBy("seg_no").rowsBetween(W.unboundedPreceding, -1)
    s = segments.withColumn("wanted", F.last(F.when(F.col("seg_type") == pgs.PCS, E.be_uint("body", 9, 1)), True).over(flow))
    number = F.when(F.col("seg_type") == pgs.PDS, E.be_uint("body", 0, 1)).when(F.col("seg_type") == pgs.END, F.col("wanted"))
    own = W.partitionBy("stream_id", "number").orderBy("seg_no").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("number", number).where("number is not null")
    return s.withColumn("palette_seg_no", F.last(F.when(F.col("seg_type") == pgs.PDS, F.col("seg_no")), True).over(own)).where(F.col("seg_type") == pgs.END).select("stream_id", "seg_no", "palette_seg_no")


def vobsub_frames(pairs: DataFrame, entries: DataFrame, header: DataFrame, permissive: bool = False) -> DataFrame:
    """Frames of subtitle units. pairs: stream_id, content (.sub); entries: start_ms, file_pos; header: palette, lang_idx.

    An entry's bytes go up to the next entry's. One bad entry fails its stream.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy("stream_id").orderBy("file_pos", "entry_no")
    spans = entries.withColumn("cue_index", F.row_number().over(w)).withColumn("span_end", F.lead("file_pos").over(w))
    listed = spans.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("cue_index", "start_ms", "file_pos", "span_end"))).alias("spans"))
    # never a broadcast: the planner may take whole files for as small as what they were read from
    todo = pairs.select("stream_id", "content").hint("merge").join(listed.hint("merge").join(header, "stream_id"), "stream_id")
    schema = schemas.struct("stream_id string, cue_index int, start_ms bigint, width int, height int, rgba binary, error string")
    arrow = to_arrow_schema(schema)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for stream, content, entries_, palette, lang in rows_of(batches, "stream_id", "content", "spans", "palette", "lang_idx"):
            rows = []
            try:
                for e in entries_:
                    if e["file_pos"] >= len(content):
                        raise vobsub.SpuError(f"filepos {e['file_pos']} beyond the file")
                    end = min(e["span_end"] if e["span_end"] is not None else len(content), len(content))
                    img = vobsub.decode_unit(vobsub.find_unit(content, e["file_pos"], end, 0x20 + lang), palette)
                    rows.append((stream, e["cue_index"], e["start_ms"], img.shape[1], img.shape[0], img.tobytes(), None))
            except vobsub.SpuError as x:
                if not permissive:
                    raise
                rows = [(stream, 0, None, None, None, None, f"{stream}: {x}")]
            yield from rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(drawn(batches), arrow)

    return todo.select("stream_id", "content", "spans", "palette", "lang_idx").mapInArrow(run, schema)


def image_frames(files: DataFrame, permissive: bool = False) -> DataFrame:
    """Frames of PNG files: stream_id, cue_index, content."""
    schema = schemas.struct(schemas.FRAME + ", error string")
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for stream, cue, content in rows_of(batches, "stream_id", "cue_index", "content"):
            try:
                img = pixels.premultiply(png.decode(content))
            except png.PngError as e:
                if not permissive:
                    raise
                yield stream, cue, None, None, None, f"{stream}: {e}"
                continue
            yield stream, cue, img.shape[1], img.shape[0], img.tobytes(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(rows(batches), arrow)

    return files.select("stream_id", "cue_index", "content").mapInArrow(run, schema)


def preprocess(frames: DataFrame, max_width: int = 1080, padding: int = 10, force_white: bool = False, solid_fallback: bool = False, straight_alpha: bool = False) -> DataFrame:
    """Crop, pad, shrink and whiten each frame, fused in one pass over the pixels."""
    schema = schemas.struct(schemas.FRAME)
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for stream, cue, w, h, raw in rows_of(batches, "stream_id", "cue_index", "width", "height", "rgba"):
            img = pixels.preprocess(np.frombuffer(raw, np.uint8).reshape(h, w, 4), max_width, padding, force_white, solid_fallback, straight_alpha)
            yield stream, cue, img.shape[1], img.shape[0], img.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(rows(batches), arrow)

    return frames.select("stream_id", "cue_index", "width", "height", "rgba").mapInArrow(run, schema)


def png_column(frames: DataFrame) -> DataFrame:
    """stream_id, cue_index, png of each frame."""
    schema = schemas.struct("stream_id string, cue_index int, png binary")
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for stream, cue, w, h, raw in rows_of(batches, "stream_id", "cue_index", "width", "height", "rgba"):
            yield stream, cue, png.encode(np.frombuffer(raw, np.uint8).reshape(h, w, 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(rows(batches), arrow)

    return frames.select("stream_id", "cue_index", "width", "height", "rgba").mapInArrow(run, schema)

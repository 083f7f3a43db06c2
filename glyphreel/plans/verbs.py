"""The three verbs over one input: parse (sheets), export (one image for each cue), and ocr in glyphreel.ocr.runner."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphreel.functions import exprs as E
from glyphreel.operators import compose, frames
from glyphreel.operators import relational as R
from glyphreel.sinks import writers
from glyphreel.sources import files, idx

Progress = Callable[[str, int, int], None]


@dataclass(frozen=True)
class Result:
    output_dir: str
    count: int


def default_output(path: str) -> str:
    path = path.rstrip("/") or path
    return os.path.join(os.path.dirname(path), os.path.basename(path) + "_out") if os.path.isdir(path) else os.path.splitext(path)[0]


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str]:
    """(cues, frames, kind) of a .sup file, an .idx file with its .sub, or a folder of numbered images."""
    if os.path.isdir(path):
        images = files.numbered_images(spark, path)
        files.check_numbers(images)
        return files.image_cues(images), frames.image_frames(files.image_contents(spark, path, images)).drop("error"), "images"
    kind = os.path.splitext(path)[1].lower()
    if kind == ".sup":
        shown = frames.pgs_frames(files.pgs_files(spark, path))
        return frames.shown_cues(shown), frames.shown_frames(shown), "sup"
    if kind == ".idx":
        texts, data, lost = files.vobsub_pairs(spark, path)
        for row in lost.take(1):
            raise files.InputError(f"missing .sub file for {row['stream_id']}")
        lines = idx.lines(texts)
        got = frames.vobsub_frames(data, idx.entries(lines), idx.header(texts))
        cues = R.infer_ends(got.select("stream_id", "cue_index", "start_ms"), ["stream_id"], ["cue_index"])
        return cues, got.drop("start_ms", "error"), "idx"
    raise files.InputError(f"unsupported input: {path}")


def _kept(df: DataFrame) -> DataFrame:
    """Decoded frames are read several times (sizes, pixels, times), so they are kept on disk beside the executors."""
    from pyspark import StorageLevel

    return df.persist(StorageLevel.DISK_ONLY)


def parse(spark: SparkSession, path: str, output: str | None = None, limit: int = 6, layout: str = "digits", max_width: int = 1080, padding: int = 10, force_white: bool = False, progress: Progress | None = None) -> Result:
    output = output or default_output(path)
    if not os.path.exists(path):
        raise files.InputError(f"input not found: {path}")
    tell = progress or (lambda *_: None)
    cues, raw, kind = load(spark, path)
    raw = _kept(raw)
    total = raw.count()
    if not total:
        raise files.InputError(f"no cues found in {path}")
    tell("load", total, total)
    writers.clean(output, "sheet_*.png", ("temp",))
    ready = _kept(frames.preprocess(raw, max_width, padding, force_white, solid_fallback=kind == "images"))
    sheets = compose.compose(ready, limit, layout)
    n = writers.write_binaries(sheets, output, "sheet", "png")
    tell("compose", n, n)
    placed = R.lookup(cues, compose.placements(ready, limit).select("stream_id", "cue_index", "sheet", "position_in_sheet"), ["stream_id", "cue_index"], "sheet")
    writers.write_timeline(placed, output)
    tell("write", n, n)
    for df in (raw, ready):
        df.unpersist()
    return Result(output, n)


def export(spark: SparkSession, path: str, output: str | None = None, progress: Progress | None = None) -> Result:
    """Output is cleaned before the input is read, so a failed export leaves none of the old output."""
    if os.path.isdir(path):
        raise files.InputError("export does not take a directory")
    output = output or default_output(path)
    writers.clean(output, "cue_*.png")
    if not os.path.exists(path):
        raise files.InputError(f"input not found: {path}")
    cues, raw, _ = load(spark, path)
    raw = _kept(raw)
    n = writers.write_binaries(frames.png_column(raw).withColumn("name", E.cue_name("cue_index")), output, "name", "png")
    writers.write_timeline(cues.withColumn("sheet", E.cue_name("cue_index")).withColumn("position_in_sheet", F.lit(1)), output)
    if progress:
        progress("export", n, n)
    raw.unpersist()
    return Result(output, n)

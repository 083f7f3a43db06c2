"""Output files of one folder: images, time line, mapping. Written by tasks to a folder that they share with the driver."""

from __future__ import annotations

import glob
import json
import os
import shutil
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from glyphreel.functions import exprs as E
from glyphreel.operators import relational as R


def write_binaries(df: DataFrame, folder: str, name: str, content: str) -> int:
    """A file for each row; the number of files. A file is written beside its place and then renamed, so retries do no harm."""
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                path = os.path.join(folder, n)
                with open(f"{path}.part", "wb") as f:
                    f.write(data.as_buffer())
                os.replace(f"{path}.part", path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return df.select(name, content).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def srt_text(cues: DataFrame, text: str = "text") -> str:
    """The time line of one stream as it stands in a file."""
    doc = R.srt_documents(R.srt_blocks(cues.withColumn("_s", F.lit(0)), ["_s"], ["cue_index"], F.col(text)), ["_s"]).select("srt").first()
    return doc["srt"] if doc else ""


def write_text(path: str, text: str) -> None:
    with open(f"{path}.part", "w", encoding="utf-8", newline="") as f:
        f.write(text)
    os.replace(f"{path}.part", path)


def mapping_json(items: DataFrame) -> str:
    """Two spaces a level, no end of line; items by cue."""
    fields = ("cue_index", "start_ms", "end_ms", "sheet", "position_in_sheet")
    rows = [{k: r[k] for k in fields} for r in items.select(*fields).orderBy("cue_index").toLocalIterator()]
    return json.dumps({"items": rows}, indent=2, ensure_ascii=False)


def write_timeline(cues: DataFrame, folder: str) -> None:
    """timeline.srt with markers and mapping.json; cues carry sheet and position_in_sheet of every cue."""
    os.makedirs(folder, exist_ok=True)
    write_text(os.path.join(folder, "timeline.srt"), srt_text(cues.withColumn("text", E.marker("sheet", "position_in_sheet"))))
    write_text(os.path.join(folder, "mapping.json"), mapping_json(cues))


def clean(folder: str, images: str, extra: tuple[str, ...] = ()) -> None:
    """Makes the folder; removes earlier output of the same kind, nothing else."""
    os.makedirs(folder, exist_ok=True)
    for path in [*glob.glob(os.path.join(glob.escape(folder), images)), *(os.path.join(folder, n) for n in ("timeline.srt", "mapping.json"))]:
        if os.path.exists(path):
            os.remove(path)
    for n in extra:
        shutil.rmtree(os.path.join(folder, n), ignore_errors=True)


def write_dumps(results: DataFrame, folder: str) -> None:
    """One JSON Lines file of responses for each sheet, made anew."""
    os.makedirs(folder, exist_ok=True)

    def run(rows: Iterator[Row]) -> None:
        for r in rows:
            with open(os.path.join(folder, f"{os.path.splitext(os.path.basename(r['sheet']))[0]}.jsonl"), "w", encoding="utf-8") as f:
                f.write(r["dump"] or "")

    results.select("sheet", "dump").foreachPartition(run)

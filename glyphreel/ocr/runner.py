"""Recognition of all sheets of a folder: one task slot for each concurrent request, results kept before they are used."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphreel import schemas
from glyphreel.functions import exprs as E
from glyphreel.ocr import client
from glyphreel.ocr import config as C
from glyphreel.operators import relational as R
from glyphreel.operators import text as X
from glyphreel.sinks import writers
from glyphreel.sources import files

_SPLIT = re.compile(rf"[{E.PATTERN_SPACE}]*{E.SEPARATOR}[{E.PATTERN_SPACE}]*")


def raw_lines(text: str) -> list[str]:
    return [s for p in _SPLIT.split(text.strip(X.SPACE)) if (s := p.strip(X.SPACE))]


def aligned(lines: list[str], expected: int) -> list[str]:
    if len(lines) <= expected:
        return lines + [""] * (expected - len(lines))
    return [*lines[: expected - 1], " ".join(lines[expected - 1 :])] if expected else []


def recognise_sheet(ask: client.Provider, sheet: str, png: bytes | None, expected: int, strict: bool) -> tuple:
    """A row of OCR_TEXT. A mismatch in strict mode is asked again, up to the limit, and keeps the last lines."""
    dump: list[str] = []
    if png is None:
        return sheet, expected, None, None, 0, "error", f"no image of {sheet}", None
    text, lines, attempt = "", [], 0
    try:
        for attempt in range(1, (C.STRICT_ATTEMPTS if strict else 1) + 1):
            text = ask(sheet, png, expected, dump)
            lines = raw_lines(text)
            if not strict or len(lines) == expected:
                return sheet, expected, text, aligned(lines, expected), attempt, None, None, "".join(dump)
    except Exception as e:  # noqa: BLE001
        return sheet, expected, None, None, attempt, "error", str(e), "".join(dump)
    return sheet, expected, text, aligned(lines, expected), attempt, "strict", str(C.StrictMismatch(sheet, expected, len(lines), lines)), "".join(dump)


def recognise(sheets: DataFrame, make: Callable[[], client.Provider], concurrency: int, strict: bool = False, stop: str | None = None) -> DataFrame:
    """sheets: sheet, png, expected. Errors are rows, so no task fails and none is paid for twice by a task retry.

    stop names a file that all tasks see. The first error makes it, and from then on no task asks for another sheet: such
    sheets get rows of kind `skipped`.
    """

    names = schemas.struct(schemas.OCR_TEXT).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for df in batches:
            for r in df.itertuples(index=False):
                if stop and os.path.exists(stop):
                    row = r.sheet, int(r.expected), None, None, 0, "skipped", None, None
                else:
                    row = recognise_sheet(ask, r.sheet, None if r.png is None else bytes(r.png), int(r.expected), strict)
                if stop and row[5] == "error":
                    with open(stop, "a"):
                        pass
                yield pd.DataFrame([row], columns=names)

    return sheets.select("sheet", "png", "expected").repartition(concurrency).mapInPandas(run, schemas.OCR_TEXT)


def backfill(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items with text: the sheet's k-th line for its k-th item, its marker where that is blank. A cue on several
    sheets takes the text of the sheet whose name sorts last."""
    zipped = R.zip_lines(items, results, ["sheet"], "position_in_sheet")
    texts = R.latest(zipped.where("line is not null"), ["cue_index"], ["sheet", "position_in_sheet"], ["line"])
    return items.join(texts, "cue_index", "left").withColumn("text", E.marker_fallback("line", "sheet", "position_in_sheet")).drop("line")


def run_folder(spark: SparkSession, folder: str, config_path: str, strict: bool = False, dump_dir: str | None = None, make: Callable[[C.OcrConfig], client.Provider] | None = None, progress: Callable[[int, int], None] | None = None) -> str:
    """Recognises the sheets of mapping.json in `folder` and rewrites timeline.srt; its path."""
    config = C.load(config_path)
    if dump_dir and config.provider != C.PADDLE:
        raise C.ConfigError("--dump-paddle-responses requires ocr.provider: paddle_ocr")
    path = os.path.join(folder, "mapping.json")
    if not os.path.exists(path):
        raise files.InputError(f"mapping.json not found in {folder}")
    items = files.read_mapping(spark, path)
    sheets = items.groupBy("sheet").agg(F.count(F.lit(1)).cast("int").alias("expected"))
    n = sheets.count()
    if not n:
        raise files.InputError("mapping.json contains no items")
    if progress:
        progress(0, n)
    images = files.binary_files(spark, folder, "*.png").select(F.element_at(F.split("path", "/"), -1).alias("sheet"), F.col("content").alias("png"))
    ask = make or client.provider
    stop = os.path.join(folder, "temp", "ocr_failed")
    os.makedirs(os.path.dirname(stop), exist_ok=True)
    if os.path.exists(stop):
        os.remove(stop)
    results = recognise(sheets.join(images, "sheet", "left"), lambda: ask(config), min(config.max_concurrency, n), strict, stop)
    # kept on reliable storage before any use: computing it again would pay for every request again
    kept = os.path.join(folder, "temp", "ocr_results")
    results.write.mode("overwrite").parquet(kept)
    results = spark.read.schema(schemas.OCR_TEXT).parquet(kept)
    if dump_dir:
        writers.write_dumps(results, dump_dir)
    if progress:
        progress(n, n)
    for bad in results.where("error_kind = 'error'").orderBy("sheet").take(1):
        raise RuntimeError(bad["error"])
    out = os.path.join(folder, "timeline.srt")
    writers.write_text(out, writers.srt_text(backfill(items, results)))
    wrong = [r["error"] for r in results.where("error_kind = 'strict'").orderBy("sheet").select("error").toLocalIterator()]
    if wrong:
        raise RuntimeError("sheets whose lines do not fit:\n" + "\n".join(f"- {w}" for w in wrong))
    return out

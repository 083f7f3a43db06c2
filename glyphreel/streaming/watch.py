"""Streams: new caption files as they arrive, and a fold that keeps its state between micro-batches."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glyphreel import schemas
from glyphreel.codecs import pgs
from glyphreel.operators import frames


def watch_pgs(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of .sup files as they appear in a folder; a damaged file gives an error row and no more."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.sup").load(folder)
    return frames.pgs_frames(raw.select(F.col("path").alias("stream_id"), "content"), permissive=True)


def fold_stream(segments: DataFrame) -> DataFrame:
    """Frames of a stream of segments (SEGMENT rows, in order within each stream_id), across micro-batches."""

    names = schemas.struct(schemas.SHOWN).names

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        decoder, n = pickle.loads(state.get[0]) if state.exists else (pgs.Decoder(), 0)
        rows = []
        for s in pd.concat(list(batches)).sort_values("seg_no").itertuples():
            got = decoder.feed(s.pts90k, s.seg_type, s.body)
            if got:
                n += 1
                h, w = got[1].shape[:2]
                rows.append((key[0], n, got[0], w, h, got[1].tobytes(), None))
        state.update((pickle.dumps((decoder, n)),))
        yield pd.DataFrame(rows, columns=names)

    return segments.groupBy("stream_id").applyInPandasWithState(run, schemas.SHOWN, "decoder binary", "append", GroupStateTimeout.NoTimeout)


def windowed_cues(cues: DataFrame, ts: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Cues for each stream and window of time, with a watermark for late ones."""
    return cues.withWatermark(ts, late).groupBy(F.window(ts, window), "stream_id").agg(F.count(F.lit(1)).alias("n_cues"))

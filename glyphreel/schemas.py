"""Explicit schemas of the tables that flow between operators. Nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

FRAME = "stream_id string, cue_index int, width int, height int, rgba binary"
SEGMENT = "stream_id string, seg_no int, byte_offset bigint, pts90k bigint, seg_type smallint, body binary"
SHOWN = "stream_id string, frame_no int, pts90k bigint, width int, height int, rgba binary, error string"
CUE = "stream_id string, cue_index int, start_ms bigint, end_ms bigint"
PLACEMENT = "stream_id string, cue_index int, sheet string, position_in_sheet int"
SHEET = "stream_id string, sheet string, width int, height int, png binary, cue_indexes array<int>"
MAPPING = "items array<struct<cue_index:int,start_ms:bigint,end_ms:bigint,sheet:string,position_in_sheet:int>>"
OCR_TEXT = "sheet string, expected int, text string, lines array<string>, attempts int, error_kind string, error string, dump string"
PAGE = "result struct<ocrResults:array<struct<prunedResult:struct<rec_texts:array<string>,rec_boxes:array<array<double>>,dt_polys:array<array<array<double>>>>>>,layoutParsingResults:array<struct<markdown:struct<text:string>>>>"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)

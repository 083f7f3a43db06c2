"""Encoders that turn rows of the test tables into caption files, so that decoders can be checked against the rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from glyphreel import schemas
from glyphreel.codecs import pgs, vobsub
from glyphreel.operators.frames import batched, pieces


def map_rows(df: DataFrame, make, ddl: str) -> DataFrame:
    """make(row as a dict) -> rows of the schema."""
    schema = schemas.struct(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((r for batch in batches for part in pieces(batch) for row in part.to_pylist() for r in make(row)), arrow)

    return df.mapInArrow(run, schema)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows over enough tasks for what is made of them: a file of a few MB may be one task's, and each of its rows an image."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *keys)


def caption_events(events: DataFrame) -> DataFrame:
    """stream_id (user and half day, as ticks are of 32 bits), event_id, us (within the half day), pts90k."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    half = 43_200_000_000
    out = events.select("event_id", F.col("user_id").cast("string").alias("u"), us.alias("t"))
    out = out.select(F.concat_ws("-", "u", F.expr(f"cast(t div {half} as string)")).alias("stream_id"), "event_id", F.expr(f"t % {half}").alias("us"))
    return out.withColumn("pts90k", F.expr("(us * 9) div 100"))


def pgs_stream(ticks: list[int]) -> bytes:
    """A white pixel shown at each tick."""
    out = pgs.segment(0, pgs.PDS, pgs.pds_body(0, {1: (235, 128, 128, 255)}))
    out += b"".join(pgs.segment(0, pgs.ODS, b) for b in pgs.ods_bodies(1, np.ones((1, 1), np.uint8)))
    for t in ticks:
        out += pgs.segment(t, pgs.PCS, pgs.pcs_body(0, [pgs.Placed(1, 10, 20)])) + pgs.segment(t, pgs.END, b"")
    return out


def pgs_files_of(events: DataFrame) -> DataFrame:
    ticks = caption_events(events).groupBy("stream_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("us", "event_id", "pts90k"))), lambda x: x["pts90k"]).alias("ticks"))
    return map_rows(ticks, lambda r: [(r["stream_id"], pgs_stream(r["ticks"]))], "stream_id string, content binary")


def idx_texts_of(events: DataFrame) -> DataFrame:
    """Index text of each stream: a line for each event, by place 2048 bytes apart, latest first, with other lines between."""
    from pyspark.sql import Window as W

    e = caption_events(events).withColumn("n", F.row_number().over(W.partitionBy("stream_id").orderBy("us", "event_id"))).withColumn("ms", F.expr("us div 1000"))
    clock = F.format_string("%02d:%02d:%02d:%03d", F.expr("ms div 3600000"), F.expr("(ms div 60000) % 60"), F.expr("(ms div 1000) % 60"), F.expr("ms % 1000"))
    line = F.concat(F.when(F.col("n") % 2 == 0, "timestamp: ").otherwise("  TimeStamp: "), clock, F.lit(", filepos: "), F.lpad(F.hex((F.col("n") - 1) * 2048), 9, "0"))
    listed = e.groupBy("stream_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), line.alias("line"))), True), lambda x: x["line"]).alias("ls"))
    head = F.array(F.lit("# index file"), F.lit("palette: 000000, ff0000"), F.lit(""), F.lit("timestamp: 00:00:3:000, filepos: 1"), F.lit("timestamp: 00:00:01:000"))
    return listed.select("stream_id", F.array_join(F.concat(head, "ls"), "\n").alias("text"))


def _put(number: int, kind: int, body: bytes) -> bytes:
    return pgs.segment(number, kind, body)


def rich_stream(w: int, luma: int, ticks: int) -> bytes:
    """Two display sets. The first: a cropped object of several parts beside another one. Then the first object and the
    palette are replaced and the set holds that object alone, beside one that isn't known.
    """
    out = _put(0, pgs.PDS, pgs.pds_body(3, {1: (luma, 128, 128, 255), 2: (235, 128, 128, 255)}))
    out += b"".join(_put(0, pgs.ODS, b) for b in pgs.ods_bodies(7, np.ones((9, w + 4), np.uint8), part=5))
    out += b"".join(_put(0, pgs.ODS, b) for b in pgs.ods_bodies(8, np.full((4, w), 2, np.uint8)))
    out += _put(ticks, pgs.PCS, pgs.pcs_body(3, [pgs.Placed(7, 30, 50, (2, 1, w, 6)), pgs.Placed(8, 35 + w, 53)])) + _put(ticks, pgs.END, b"")
    out += _put(ticks, pgs.PDS, pgs.pds_body(3, {1: (235, 128, 128, 255)}))
    out += b"".join(_put(ticks, pgs.ODS, b) for b in pgs.ods_bodies(7, np.ones((3, 5), np.uint8)))
    return out + _put(ticks + 900, pgs.PCS, pgs.pcs_body(3, [pgs.Placed(7, 0, 0), pgs.Placed(99, 40, 40)])) + _put(ticks + 900, pgs.END, b"")


def rich_files_of(part: DataFrame) -> DataFrame:
    rows = part.select(F.col("p_partkey").cast("string").alias("stream_id"), "p_size", (F.col("p_partkey") % 200 + 16).cast("int").alias("luma"), (F.col("p_partkey") * 90).alias("ticks"))
    return map_rows(dealt(rows, "stream_id"), lambda r: [(r["stream_id"], rich_stream(r["p_size"], r["luma"], r["ticks"]))], "stream_id string, content binary")


@lru_cache(maxsize=16)
def sub_unit(width: int) -> bytes:
    img = np.zeros((3, width), np.uint8)
    img[1] = 1
    return vobsub.packets(vobsub.encode_unit(img), 0x20, 40).ljust(2048, b"\xff")


def sub_files_of(events: DataFrame) -> DataFrame:
    """Data files for idx_texts_of: a unit for each event, 2048 bytes apart; 1 + event_id % 7 by 3 pixels of colour 1 over colour 0."""
    listed = caption_events(events).groupBy("stream_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("us", "event_id"))), lambda x: x["event_id"]).alias("ids"))
    return map_rows(listed, lambda r: [(r["stream_id"], b"".join(sub_unit(1 + i % 7) for i in r["ids"]))], "stream_id string, content binary")


def plain_png(pixels: np.ndarray) -> bytes:
    """A PNG of straight pixels without row filters, written without the codec."""
    import struct
    import zlib

    h, w = pixels.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    parts = ((b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)), (b"IDAT", zlib.compress(raw)), (b"IEND", b""))
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b)) for n, b in parts)


def run_codes(lineitem: DataFrame) -> DataFrame:
    """key, width, pgs, nibbles: the pixels of pixel_rows as run codes in hex, put together by expressions, without the codecs."""
    q, colour = F.col("l_quantity").cast("int"), (F.col("l_partkey") % 4).cast("int")
    seen = F.when(colour == 0, F.format_string("00%02X", q)).otherwise(F.format_string("00%02X%02X", q.bitwiseOR(F.lit(128)), colour))
    code = q * 4 + colour
    nibbles = F.when(q < 4, F.format_string("%X", code)).when(q < 16, F.format_string("%02X", code)).otherwise(F.format_string("%03X", code))
    rows = lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", q.alias("q"), seen.alias("seen"), nibbles.alias("nibbles"))
    listed = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_partkey", "seen", "nibbles")))
    joined = lambda k: F.array_join(F.transform(listed, lambda x: x[k]), "")
    return rows.groupBy(F.col("l_orderkey").alias("key")).agg(F.sum("q").cast("int").alias("width"), F.concat(joined("seen"), F.lit("0000")).alias("pgs"), joined("nibbles").alias("nibbles"))


def unit_of_codes(nibbles: str, width: int) -> bytes:
    """A unit of one row from its codes in hex: sizes, codes, an empty second field, one control sequence."""
    field = bytes.fromhex(nibbles + "0" * (len(nibbles) % 2)) + b"\0"
    control, right = 4 + len(field), width - 1
    tail = b"\0\0" + control.to_bytes(2, "big") + bytes.fromhex("03321004ffff05") + bytes([0, right >> 8 & 15, right & 255, 0, 0, 0]) + b"\6\0\4" + (control - 1).to_bytes(2, "big") + b"\xff"
    return (control + len(tail)).to_bytes(2, "big") + control.to_bytes(2, "big") + field + tail


def pixel_rows(lineitem: DataFrame) -> DataFrame:
    """key, row: the pixels of each order, a byte each, colours 0 to 3 by line and quantity as lengths of runs."""
    cells = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_partkey"))), lambda x: F.array_repeat((x["l_partkey"] % 4).cast("tinyint"), x["l_quantity"].cast("int")))
    return lineitem.groupBy("l_orderkey").agg(F.flatten(cells).alias("row")).select(F.col("l_orderkey").alias("key"), "row")


#: What a unit's 16-bit size leaves for its body.
UNIT_BODY = 65533


def spu_rows(documents: DataFrame) -> DataFrame:
    """doc_id, content, starts: each whole text as units (size in front) in packets of the private stream, and where they begin."""

    def make(r: dict) -> list[tuple]:
        body = (r["text"] or "").encode()
        content, starts = bytearray(), []
        for at in range(0, max(len(body), 1), UNIT_BODY):
            part = body[at : at + UNIT_BODY]
            starts.append(len(content))
            content += vobsub.packets(b"\0\x05abc", 0x21)
            content += vobsub.packets((len(part) + 2).to_bytes(2, "big") + part, 0x20, 500)
        return [(r["doc_id"], bytes(content), starts)]

    return map_rows(documents.select("doc_id", "text"), make, "doc_id bigint, content binary, starts array<int>")

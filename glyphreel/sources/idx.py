"""The text side of DVD subtitles: palettes, language index and time entries, by expressions over a table of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphreel.functions import exprs as E
from glyphreel.operators import relational as R


def lines(texts: DataFrame) -> DataFrame:
    """stream_id, line_no, line: trimmed, without blank lines and remarks."""
    split = texts.select("stream_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn("line", E.trim_space("line"))
    return split.where("line <> '' and not startswith(line, '#')")


def entries(idx_lines: DataFrame) -> DataFrame:
    """stream_id, entry_no, start_ms, file_pos of the time lines that can be read, ordered by place in the data file."""
    from pyspark.sql import Window as W

    # each pattern runs once for a line; numbers are read from what it found
    found = idx_lines.where(F.lower(F.substring("line", 1, 10)) == "timestamp:").select("stream_id", "line_no", E.found_stamp("line").alias("stamp"), E.found_pos_digits("line").alias("digits"))
    got = found.select("stream_id", "line_no", E.clock_ms("stamp").alias("start_ms"), E.pos_of_digits("digits").alias("file_pos"))
    got = got.where("start_ms is not null and file_pos is not null")
    return got.select("stream_id", F.row_number().over(W.partitionBy("stream_id").orderBy("file_pos", "line_no")).alias("entry_no"), "start_ms", "file_pos")


def palettes(idx_lines: DataFrame) -> DataFrame:
    """stream_id, palette: 16 colours. A token that isn't hex keeps its slot; later lines overwrite."""
    body = F.regexp_replace("line", "(?i)^palette:", "")
    tokens = idx_lines.where(F.col("line").rlike("(?i)^palette:")).select("stream_id", "line_no", F.posexplode(F.split(body, ",", -1)).alias("slot", "token"))
    hexed = tokens.where("slot < 16").withColumn("token", E.trim_space("token")).where(F.col("token").rlike("^0*[0-9a-fA-F]{1,8}$"))
    latest = R.latest(hexed.withColumn("rgb", F.conv("token", 16, 10).cast("bigint")), ["stream_id", "slot"], ["line_no"], ["rgb"])
    known = latest.groupBy("stream_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "rgb"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint")))
    return known.select("stream_id", full.alias("palette"))


def language_index(idx_lines: DataFrame) -> DataFrame:
    """stream_id, lang_idx: the last one that is a number, held to 0..31."""
    raw = F.regexp_replace("line", "(?i)^langidx:", "")
    got = idx_lines.where(F.col("line").rlike("(?i)^langidx:")).withColumn("raw", E.trim_space(raw)).withColumn("v", F.expr("case when raw rlike '^[+-]?[0-9]+$' then try_cast(raw as bigint) end")).where("v is not null")
    clamped = F.greatest(F.lit(0), F.least(F.lit(31), F.col("v"))).cast("int")
    return R.latest(got.withColumn("lang_idx", clamped), ["stream_id"], ["line_no"], ["lang_idx"])


def header(texts: DataFrame) -> DataFrame:
    """stream_id, palette, lang_idx, with defaults where lines are absent."""
    t = lines(texts)
    none = F.array_repeat(F.lit(0).cast("bigint"), 16)
    out = texts.select("stream_id").join(palettes(t).hint("merge"), "stream_id", "left").join(language_index(t).hint("merge"), "stream_id", "left")
    return out.select("stream_id", F.coalesce("palette", none).alias("palette"), F.coalesce("lang_idx", F.lit(0)).alias("lang_idx"))

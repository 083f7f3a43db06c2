"""Relational operators of the caption pipeline. Every window is partitioned by stream (or sheet), never global,
runs over narrow columns only, and has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphreel.functions import exprs as E


def number_cues(df: DataFrame, stream: list[str], order: list[str], name: str = "cue_index") -> DataFrame:
    """1-based ordinal in each stream."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*stream).orderBy(*order)))


def infer_ends(df: DataFrame, stream: list[str], order: list[str], start: str = "start_ms") -> DataFrame:
    """end_ms: the next cue's start; the last lasts 2 s; one that would not be positive lasts 0.5 s."""
    following = F.lead(start).over(W.partitionBy(*stream).orderBy(*order))
    return df.withColumn("end_ms", E.cue_end(start, following))


def place_on_sheets(df: DataFrame, stream: list[str], order: list[str], limit: int = 6) -> DataFrame:
    """sheet_no, sheet and position_in_sheet: consecutive groups of `limit` cues of a stream."""
    if limit <= 0:
        raise ValueError("limit must be > 0")
    n = F.row_number().over(W.partitionBy(*stream).orderBy(*order)) - 1
    out = df.withColumn("_n", n).withColumn("sheet_no", (F.floor(F.col("_n") / limit) + 1).cast("int"))
    return out.withColumn("sheet", E.sheet_name("sheet_no")).withColumn("position_in_sheet", (F.col("_n") % limit + 1).cast("int")).drop("_n")


def row_gap(least_height: Column, layout: str, separator: int) -> Column:
    return F.greatest(F.lit(separator), least_height) if layout == "digits" else F.lit(separator)


def sheet_geometry(df: DataFrame, keys: list[str], layout: str = "digits", separator: int = 12, width: str = "width", height: str = "height") -> DataFrame:
    """n, sheet_width, row_gap and sheet_height of each sheet: a gap after every cue, or only between cues."""
    if layout not in ("digits", "no-row-index"):
        raise ValueError(f"unknown sheet layout {layout!r}")
    if separator < 0:
        raise ValueError("separator must be >= 0")
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(width).alias("sheet_width"), F.sum(height).alias("_sum"), F.min(height).alias("_min"))
    g = g.withColumn("row_gap", row_gap(F.col("_min"), layout, separator).cast("bigint"))
    gaps = F.col("n") if layout == "digits" else F.col("n") - 1
    return g.withColumn("sheet_height", F.col("_sum") + F.col("row_gap") * gaps).drop("_sum", "_min")


def cue_offsets(df: DataFrame, keys: list[str], order: list[str], layout: str = "digits", separator: int = 12, width: str = "width", height: str = "height") -> DataFrame:
    """x and y of each cue on its sheet: centred, below the cues and gaps before it."""
    whole = W.partitionBy(*keys)
    before = whole.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    gap = row_gap(F.min(height).over(whole), layout, separator)
    y = F.coalesce(F.sum(height).over(before), F.lit(0)) + gap * F.coalesce(F.count(F.lit(1)).over(before), F.lit(0))
    return df.withColumn("x", F.floor((F.max(width).over(whole) - F.col(width)) / 2).cast("int")).withColumn("y", y.cast("bigint"))


def lookup(left: DataFrame, right: DataFrame, keys: list[str], need: str, strict: bool = True) -> DataFrame:
    """Join to a table that is unique by keys; a miss is an error where strict."""
    out = left.join(right, keys, "left")
    return out.where(F.assert_true(F.col(need).isNotNull(), F.concat(F.lit("missing placement for "), F.concat_ws("/", *keys))).isNull()) if strict else out


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_anti")


def latest(df: DataFrame, keys: list[str], order: Column | list[str], values: list[str]) -> DataFrame:
    """Last write wins: of each key the values of the row that comes last. One partial aggregate, no sort."""
    by = F.struct(*order) if isinstance(order, list) else order
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), by).alias("_v")).select(*keys, "_v.*")


def as_of(df: DataFrame, stream: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last non-null value of strictly earlier rows of the stream."""
    w = W.partitionBy(*stream).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def generations(df: DataFrame, keys: list[str], order: list[str], first: Column, name: str = "generation") -> DataFrame:
    """Which run of parts a row belongs to; rows before the first `first` are in run 0."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(first, 1).otherwise(0)).over(w).cast("bigint"))


def early_stop(df: DataFrame, keys: list[str], order: list[str], size: Column, wanted: Column) -> DataFrame:
    """Rows of each key up to the one with which the sizes reach `wanted`; taken: how much of each counts."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = df.withColumn("_before", F.coalesce(F.sum(size).over(w), F.lit(0)))
    return out.where(F.col("_before") < wanted).withColumn("taken", F.least(size, wanted - F.col("_before"))).drop("_before")


def number_gaps(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """The first missing number of each key whose numbers aren't consecutive."""
    w = W.partitionBy(*keys).orderBy(number)
    steps = df.select(*keys, number).distinct().withColumn("_due", F.lag(number).over(w) + 1)
    return steps.where(F.col(number) != F.col("_due")).groupBy(*keys).agg(F.min("_due").alias("missing_number"))


def duplicate_numbers(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    return df.groupBy(*keys, number).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def single_suffix(df: DataFrame, keys: list[str], suffix: Column) -> DataFrame:
    """Keys with their number of different suffixes and whether it is one."""
    d = df.select(*keys, suffix.alias("_s")).distinct().groupBy(*keys).agg(F.count("_s").alias("n_suffixes"))
    return d.withColumn("single", F.col("n_suffixes") == 1)


def bounding_box(df: DataFrame, keys: list[str], x: str, y: str, on: Column) -> DataFrame:
    return df.where(on).groupBy(*keys).agg(F.min(x).alias("x0"), F.min(y).alias("y0"), (F.max(x) + 1).alias("x1"), (F.max(y) + 1).alias("y1"))


def srt_blocks(df: DataFrame, stream: list[str], order: list[str], text: Column) -> DataFrame:
    """n and block of each cue: ordinal, times, text and an empty line."""
    n = F.row_number().over(W.partitionBy(*stream).orderBy(*order))
    out = df.withColumn("n", n)
    return out.withColumn("block", F.concat_ws("\n", F.col("n").cast("string"), F.concat(E.srt_timestamp("start_ms"), F.lit(" --> "), E.srt_timestamp("end_ms")), text, F.lit("")))


def srt_documents(blocks: DataFrame, stream: list[str]) -> DataFrame:
    """One document for each stream; a film's cues are few, so a stream's text fits a row."""
    parts = F.sort_array(F.collect_list(F.struct("n", "block")))
    return blocks.groupBy(*stream).agg(F.array_join(F.transform(parts, lambda p: p["block"]), "\n").alias("srt"))


def sheet_items(df: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """Items of each sheet in the order of their position, and their number."""
    got = F.sort_array(F.collect_list(F.struct(position, value)))
    return df.groupBy(*keys).agg(F.transform(got, lambda p: p[value]).alias("items"), F.count(F.lit(1)).alias("expected"))


def zip_lines(items: DataFrame, lines: DataFrame, keys: list[str], position: str, array: str = "lines") -> DataFrame:
    """line: the k-th line of a sheet for its item of rank k; more lines are ignored, missing ones null."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(position))
    long = lines.select(*keys, F.posexplode(array).alias("_k", "line")).withColumn("_k", F.col("_k") + 1)
    return items.withColumn("_k", rank).join(long, [*keys, "_k"], "left").drop("_k")

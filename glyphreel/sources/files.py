"""Scans of caption files: packets, index and data pairs, numbered images, mapping files.

Files come through Spark's binaryFile reader, so any store that Spark reads will do. A file is one row; a row must stay
below 2 GB (spark.sql.sources.binaryFile.maxLength).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphreel import schemas
from glyphreel.operators import relational as R


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def binary_files(spark: SparkSession, path: str, pattern: str, recursive: bool = False) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)


def pgs_files(spark: SparkSession, path: str) -> DataFrame:
    """stream_id, content of a .sup file or of those in a folder."""
    return binary_files(spark, path, "*.[sS][uU][pP]").select(F.col("path").alias("stream_id"), "content")


def vobsub_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """idx (stream_id, text), sub (stream_id, content) of files whose stems agree, and the idx files without a .sub."""
    idx = binary_files(spark, path, "*.[iI][dD][xX]").select(F.col("path").alias("stream_id"), stem(F.col("path")).alias("stem"), F.decode("content", "UTF-8").alias("text"))
    folder = os.path.dirname(path) if path.lower().endswith(".idx") else path
    sub = binary_files(spark, folder, "*.sub").select(stem(F.col("path")).alias("stem"), "content")
    both = idx.join(sub, "stem")
    return both.select("stream_id", "text"), both.select("stream_id", "content"), idx.join(sub.select("stem"), "stem", "left_anti").select("stream_id")


#: Names of images in any case.
IMAGES = "*.{[pP][nN][gG],[jJ][pP][gG],[jJ][pP][eE][gG]}"


def numbered_images(spark: SparkSession, path: str) -> DataFrame:
    """stream_id (the folder), cue_index, suffix, path of png, jpg and jpeg files directly in a folder.

    Content is left out; numbers are checked by check_numbers.
    """
    files = binary_files(spark, path, IMAGES).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    number = F.regexp_extract(name, r"^([+-]?[0-9]+)\.[^.]*$", 1)
    return files.select(
        F.regexp_replace("path", "/[^/]*$", "").alias("stream_id"),
        F.expr("try_cast(nullif(%s, '') as int)" % "regexp_extract(element_at(split(path, '/'), -1), '^([+-]?[0-9]+)[.][^.]*$', 1)").alias("cue_index"),
        F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("suffix"),
        "path",
    ).withColumn("named", F.length(number) > 0)


class InputError(ValueError):
    pass


def check_numbers(images: DataFrame) -> None:
    """One suffix, whole numbers, none twice, none missing. Each check is an aggregate; only its first failure is fetched."""
    checks = [
        (images.where("cue_index is null").select("path"), lambda r: f"image file name is not a number: {r['path']}"),
        (R.single_suffix(images, ["stream_id"], F.col("suffix")).where("not single"), lambda r: "image directory mixes file suffixes"),
        (R.duplicate_numbers(images, ["stream_id"], "cue_index"), lambda r: f"duplicate image number {r['cue_index']}"),
        (R.number_gaps(images, ["stream_id"], "cue_index"), lambda r: f"image numbers are not consecutive: missing {r['missing_number']}"),
    ]
    for bad, text in checks:
        for row in bad.take(1):
            raise InputError(text(row))


def image_cues(images: DataFrame) -> DataFrame:
    """The k-th image lasts from second k - 1 to second k."""
    n = R.number_cues(images.select("stream_id", "cue_index"), ["stream_id"], ["cue_index"], "k")
    return n.select("stream_id", "cue_index", ((F.col("k") - 1) * 1000).cast("bigint").alias("start_ms"), (F.col("k") * 1000).cast("bigint").alias("end_ms"))


def image_contents(spark: SparkSession, path: str, images: DataFrame) -> DataFrame:
    files = binary_files(spark, path, IMAGES).select("path", "content")
    return files.join(images.select("path", "stream_id", "cue_index"), "path").select("stream_id", "cue_index", "content")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Items of mapping.json files: cue_index, start_ms, end_ms, sheet, position_in_sheet, and the order they stand in."""
    raw = spark.read.schema(schemas.MAPPING).option("multiLine", True).json(path)
    return raw.select(F.posexplode("items").alias("item_no", "i")).select("item_no", "i.*")

"""Shared plumbing of the text operators: table access, Arrow maps, train/held-out split, checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves no remainder by 5; those rows never train a model."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def map_text(df: DataFrame, keys: list[str], text: str, make: Callable[[], Callable], out: str, many: bool = False) -> DataFrame:
    """keys of every row followed by the columns of `out` (a DDL string) that make()(text) gives; with `many`, the
    function gets a list of texts and gives a list of rows.

    make runs once in each task, so that models and caches are built there. Only keys and text are read,
    so other columns, whatever their names, do no harm. Null texts reach the function as None.
    """
    extra = T._parse_datatype_string(out)
    schema = T.StructType([*(df.schema[k] for k in keys), *extra.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            # a bounded number of rows at once: long texts must not pile up as Python strings
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(len(keys))
                rows = f(texts.to_pylist()) if many else [f(x.as_py()) for x in texts]
                cols = [part.column(i).cast(arrow.field(i).type) for i in range(len(keys))]
                cols += [pa.array([r[i] for r in rows], arrow.field(len(keys) + i).type) for i in range(len(extra))]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return df.select(*keys, text).mapInArrow(run, schema)


def keep_rows(df: DataFrame, text: str, make: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows whose text the function keeps, all columns unchanged."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            yield batch.filter(pa.array([keep(x.as_py()) for x in batch.column(at)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def replace_text(df: DataFrame, text: str, make: Callable[[], Callable[[str | None], Any]], kind: T.DataType | None = None, name: str | None = None) -> DataFrame:
    """All columns, with `text` replaced by the function's result (or `name` added, of type `kind`)."""
    at = df.columns.index(text)
    kind = kind or df.schema[text].dataType
    kept = [f for f in df.schema.fields if not (name and f.name.lower() == name.lower())]
    fields = [*kept, T.StructField(name, kind)] if name else [T.StructField(f.name, kind) if f.name == text else f for f in kept]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)
    order = [df.columns.index(f.name) for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                cols = {i: part.column(i) for i in order}
                made = [f(x.as_py()) for x in part.column(at)]
                arrays = [cols[i].cast(arrow.field(j).type) if name or i != at else pa.array(made, arrow.field(j).type) for j, i in enumerate(order)]
                if name:
                    arrays.append(pa.array(made, arrow.field(len(order)).type))
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, as in tests, one of this machine in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "/tmp/glyphreel-checkpoints"


def checkpointed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage through Parquet files in the shared folder, which take less room than a checkpoint's rows."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int]) -> list[tuple[str, int]]:
    """Texts and labels of at most per_class[c] training documents of each class c, chosen by a hash of the id.

    Held-out ids never appear. The bound makes the fit's cost independent of the corpus; scoring covers every row.
    Null labels, null ids and null texts are left out; a document labelled twice counts by its largest label.
    """
    chosen = None
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).alias("_label"))
    for c, n in per_class.items():
        part = known.where(F.col("_label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    picked = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    return sorted((r["text"], int(r["_label"])) for r in picked.select("text", "_label").toLocalIterator())

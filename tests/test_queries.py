"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from glyphreel.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def rows(cols, found, have):
    at = [have.index(c) for c in cols]
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[i] for i in at)) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert rows(cols, map(tuple, got.collect()), got.columns) == rows(cols, want.fetchall(), want.columns)


def test_whole_texts_in_units(spark):
    from glyphreel import fixtures as X

    texts = ["", "é" * 2000, "a" * 65533, "b" * 65534, "long é " * 40_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [len(r.starts) for r in X.spu_rows(docs).orderBy("doc_id").collect()] == [1, 1, 1, 2, 5]
    assert [r.n_bytes for r in registry.unit_bytes(docs).orderBy("doc_id").collect()] == [len(t.encode()) for t in texts]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["stream_id", "cue_index", "start_ms", "end_ms"]
    assert set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["compose_pixels", "compose_sheets"])
def test_frames_are_not_broadcast(spark, name):
    # by file sizes the planner takes them for a few KB
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_data_files_are_read_once_and_not_broadcast(spark):
    plan = registry.QUERIES["vobsub_cues"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    # made, decoded, summed
    assert plan.count("MapInArrow") == 3 and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["preprocess_geometry", "force_white_pixels", "crop_pad_pixels", "solid_crop_pixels", "shrink_pixels"])
def test_frames_are_made_by_many_tasks(spark, name):
    # the table is one small file
    assert registry.QUERIES[name](spark, DATA).rdd.getNumPartitions() > 1


def decodings(df):
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


def test_streams_are_decoded_once(spark):
    # made, decoded, summed
    assert decodings(registry.QUERIES["pgs_pixels"](spark, DATA)) == 3


def test_pixels_travel_as_bytes(spark):
    from glyphreel import fixtures as X

    assert X.pixel_rows(spark.read.parquet(f"{DATA}/lineitem.parquet")).schema["row"].dataType.simpleString() == "array<tinyint>"


@pytest.mark.parametrize("rows", [1, 3000])
def test_colours_are_counted_by_key(spark, rows):
    df = spark.range(rows).selectExpr("id as key", "transform(sequence(0, cast(id % 3 as int)), x -> cast(x * 50 as tinyint)) as row").coalesce(1)
    got = registry.decoded_counts(df, lambda row: row.repeat(2))
    assert sorted(map(tuple, got.collect())) == [(k, c * 50, 2) for k in range(rows) for c in range(k % 3 + 1)]


class Batches:
    """Stands in for a DataFrame: gives the function that would run in a task."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_rows_are_made_piece_by_piece(spark):
    import pyarrow as pa

    from glyphreel import fixtures as X

    made = []

    def make(r):
        made.append(r["id"])
        return [(r["id"], bytes(1 << 17))]

    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(500), pa.int64()), "text": ["x" * 100_000] * 500})
    out = X.map_rows(Batches(), make, "id bigint, content binary")(iter([batch]))
    first = next(out)
    assert len(made) < 100 and first.nbytes < 6 << 20
    assert first.num_rows + sum(b.num_rows for b in out) == 500 and made == [*range(500)]


def test_streams_are_split_piece_by_piece(spark):
    import tracemalloc

    import pyarrow as pa

    from glyphreel.codecs import pgs
    from glyphreel.operators import frames

    content = pgs.segment(1, pgs.END, b"") + pgs.segment(2, pgs.PDS, bytes(60_000))
    batch = pa.RecordBatch.from_pydict({"stream_id": [f"s{i}" for i in range(500)], "content": [content] * 500})
    tracemalloc.start()
    n = sum(b.num_rows for b in frames.pgs_segments(Batches())(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1000 and peak < 15 << 20  # of a batch of 30 MB


def test_pieces_hold_few_bytes():
    import pyarrow as pa

    from glyphreel.operators.frames import pieces

    batch = pa.RecordBatch.from_pydict({"text": ["x" * 500_000] * 60})
    parts = [*pieces(batch)]
    assert max(p.num_rows for p in parts) <= 2 and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert [p.num_rows for p in pieces(pa.RecordBatch.from_pydict({"n": range(3000)}))] == [1024, 1024, 952]
    assert [*pieces(pa.RecordBatch.from_pydict({"n": pa.array([], pa.int64())}))] == []

"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows.

The tables stand in for caption data: events are cues in time, documents and conversations are recognised text and
sheet items, part holds frame sizes, lineitem pixels and colours, pages the markdown of a service. A query whose SQL is
a table of constants (`golden`) is checked against vectors, not recomputed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphreel import fixtures as X
from glyphreel import schemas
from glyphreel.codecs import pgs, pixels, vobsub
from glyphreel.functions import exprs as E
from glyphreel.operators import frames, text
from glyphreel.operators import relational as R
from glyphreel.sources import idx

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "pgs_cues"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cues: stream_id, event_id, start_ms."""
    return t(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), "event_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("start_ms"))


MS = "epoch_us(ts) // 1000"
#: DuckDB text of a time of day in milliseconds.
CLOCK = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, ({0} // 60000) % 60, ({0} // 1000) % 60, {0} % 1000)"
STREAMS = """s as (select cast(user_id as varchar) || '-' || cast(epoch_us(ts) // 43200000000 as varchar) as stream_id, event_id, epoch_us(ts) % 43200000000 as us from events)"""


# Time

ENDS = """select stream_id, event_id, start_ms, case when e <= start_ms then start_ms + 500 else e end as end_ms from
(select user_id as stream_id, event_id, {ms} as start_ms, coalesce(lead({ms}) over (partition by user_id order by ts, event_id), {ms} + 2000) as e from events)""".format(ms=MS)


@query(ENDS)
def cue_end_ms(spark, sf_dir):
    """Ends from the next start."""
    e = t(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), "event_id", "ts", F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("start_ms"))
    return R.infer_ends(e, ["stream_id"], ["ts", "event_id"]).select("stream_id", "event_id", "start_ms", "end_ms")


@query(f"select event_id, {CLOCK.format(f'({MS} % 500000000)')} as srt_time from events")
def srt_timestamp(spark, sf_dir):
    """The clock of the time line, past 99 hours too."""
    return timed(spark, sf_dir).select("event_id", E.srt_timestamp(F.col("start_ms") % 500_000_000).alias("srt_time"))


@query("select event_id, (e + 45) // 90 as ms from (select event_id, epoch_us(ts) % 43200000000 * 9 // 100 as e from events)")
def ticks_to_ms(spark, sf_dir):
    """90 kHz ticks to milliseconds."""
    return X.caption_events(t(spark, sf_dir, "events")).select("event_id", E.ticks_to_ms("pts90k").alias("ms"))


BLOCKS = f"""select stream_id, n, cast(n as varchar) || chr(10) || {CLOCK.format('b')} || ' --> ' || {CLOCK.format('f')} || chr(10) || '[img:' || printf('sheet_%04d.png', (n - 1) // 6 + 1) || '#' || printf('%02d', (n - 1) % 6 + 1) || ']' || chr(10) as block
from (select stream_id, start_ms as b, end_ms as f, row_number() over (partition by stream_id order by start_ms, event_id) as n from ({ENDS}))"""


def marked_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = cue_end_ms(spark, sf_dir)
    placed = R.place_on_sheets(cues, ["stream_id"], ["start_ms", "event_id"])
    return R.srt_blocks(placed, ["stream_id"], ["start_ms", "event_id"], E.marker("sheet", "position_in_sheet")).select("stream_id", F.col("n").cast("bigint").alias("n"), "block")


@query(BLOCKS)
def srt_blocks(spark, sf_dir):
    """Numbered blocks with markers."""
    return marked_blocks(spark, sf_dir)


@query(f"select stream_id, string_agg(block, chr(10) order by n) as srt from ({BLOCKS}) group by stream_id")
def srt_document(spark, sf_dir):
    """A stream's time line."""
    return R.srt_documents(marked_blocks(spark, sf_dir), ["stream_id"])


# Sheets


@query("select lang, doc_id, printf('sheet_%04d.png', (n - 1) // 6 + 1) as sheet, cast((n - 1) % 6 + 1 as integer) as position_in_sheet from (select lang, doc_id, row_number() over (partition by lang order by doc_id) as n from documents)")
def sheet_placement(spark, sf_dir):
    """Six cues a sheet."""
    return R.place_on_sheets(t(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], ["doc_id"]).select("lang", "doc_id", "sheet", "position_in_sheet")


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_partkey") % 300 + 20).cast("int").alias("width"), F.col("p_size").alias("height"))
    return R.place_on_sheets(p, ["p_brand"], ["p_partkey"])


SIZED = "z as (select p_brand, p_partkey, cast(p_partkey % 300 + 20 as integer) as width, p_size as height, cast((row_number() over (partition by p_brand order by p_partkey) - 1) // 6 + 1 as integer) as sheet_no from part)"


def geometry_sql(layout: str) -> str:
    gap, gaps = ("greatest(12, min(height))", "count(*)") if layout == "digits" else ("12", "(count(*) - 1)")
    return f"with {SIZED} select p_brand, sheet_no, count(*) as n, max(width) as sheet_width, cast({gap} as bigint) as row_gap, cast(sum(height) + {gap} * {gaps} as bigint) as sheet_height from z group by all"


@query(geometry_sql("digits"))
def sheet_geometry(spark, sf_dir):
    """Sizes of sheets with a digit row below every cue."""
    return R.sheet_geometry(sized(spark, sf_dir), ["p_brand", "sheet_no"]).select("p_brand", "sheet_no", "n", "sheet_width", "row_gap", "sheet_height")


@query(geometry_sql("no-row-index"))
def sheet_geometry_plain(spark, sf_dir):
    """C2, C3 with gaps between cues only."""
    return R.sheet_geometry(sized(spark, sf_dir), ["p_brand", "sheet_no"], "no-row-index").select("p_brand", "sheet_no", "n", "sheet_width", "row_gap", "sheet_height")


@query(f"with {SIZED} select p_partkey, cast((max(width) over s - width) // 2 as integer) as x, cast(coalesce(sum(height) over b, 0) + greatest(12, min(height) over s) * coalesce(count(*) over b, 0) as bigint) as y from z window s as (partition by p_brand, sheet_no), b as (partition by p_brand, sheet_no order by p_partkey rows between unbounded preceding and 1 preceding)")
def cue_offsets(spark, sf_dir):
    """Places on the sheet by a running sum."""
    return R.cue_offsets(sized(spark, sf_dir), ["p_brand", "sheet_no"], ["p_partkey"]).select("p_partkey", "x", "y")


@query("select p_partkey, width, height, least(width, 160) as new_width, case when width <= 160 then height else cast(greatest(1, floor(height * (160.0::double / width) + 0.5)) as integer) end as new_height from (select p_partkey, cast(p_partkey % 300 + 20 as integer) as width, p_size as height from part)")
def resize_dims(spark, sf_dir):
    """The size that fits a width."""
    return sized(spark, sf_dir).select("p_partkey", "width", "height", E.fitted_width("width", 160).alias("new_width"), E.fitted_height("width", "height", 160).alias("new_height"))


@query("select p_partkey, cast(floor(greatest(0, least(255, a + (b - a) * wx + ((c + (d - c) * wx) - (a + (b - a) * wx)) * wy)) + 0.5) as integer) as v from (select p_partkey, (p_partkey % 256)::double as a, (p_size * 5 % 256)::double as b, (p_partkey * 7 % 256)::double as c, (p_partkey * 13 % 256)::double as d, (p_partkey % 16)::double / 16 as wx, (p_size % 8)::double / 8 as wy from part)")
def bilinear_channel(spark, sf_dir):
    """A channel between four pixels."""
    k, s = F.col("p_partkey"), F.col("p_size")
    d = lambda c: c.cast("double")
    return t(spark, sf_dir, "part").select("p_partkey", E.bilinear_channel(d(k % 256), d(s * 5 % 256), d(k * 7 % 256), d(k * 13 % 256), d(k % 16) / 16, d(s % 8) / 8).alias("v"))


# Lookups and checks


def placed_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = t(spark, sf_dir, "labels").select("doc_id", F.format_string("sheet_%04d.png", F.col("quality")).alias("sheet"), F.col("toxic").alias("position_in_sheet"))
    return docs, labels


@query("select d.doc_id, lang, printf('sheet_%04d.png', quality) as sheet, toxic as position_in_sheet from documents d left join labels l using (doc_id)")
def placement_join(spark, sf_dir):
    """Cue to place."""
    docs, labels = placed_documents(spark, sf_dir)
    return R.lookup(docs, labels, ["doc_id"], "sheet", strict=False).select("doc_id", "lang", "sheet", "position_in_sheet")


@query("select doc_id, lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def missing_placement(spark, sf_dir):
    """Cues without a place."""
    docs, labels = placed_documents(spark, sf_dir)
    return R.missing(docs, labels, ["doc_id"]).select("doc_id", "lang")


@query("select d.doc_id, coalesce(nullif(case when n_chars % 3 = 0 then '' else d.lang end, ''), '[img:' || printf('sheet_%04d.png', coalesce(quality, 0)) || '#' || printf('%02d', coalesce(toxic, 0)) || ']') as line from documents d left join labels l using (doc_id)")
def marker_fallback(spark, sf_dir):
    """A marker where the text is blank."""
    docs = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    shown = F.when(F.col("n_chars") % 3 == 0, " 　\t").otherwise(F.col("lang"))
    return docs.select("doc_id", E.marker_fallback(shown, E.sheet_name(F.coalesce("quality", F.lit(0))), F.coalesce("toxic", F.lit(0))).alias("line"))


@query("select event_type, min(due) as missing_number from (select event_type, n, lag(n) over (partition by event_type order by n) + 1 as due from (select distinct event_type, event_id as n from events)) where n <> due group by event_type")
def number_gaps(spark, sf_dir):
    """The first missing number."""
    return R.number_gaps(t(spark, sf_dir, "events"), ["event_type"], "event_id")


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def duplicate_numbers(spark, sf_dir):
    """Numbers that occur twice."""
    return R.duplicate_numbers(t(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("select host, count(distinct suffix) as n_suffixes, count(distinct suffix) = 1 as single from (select regexp_extract(url, '://([^/?#]*)', 1) as host, regexp_extract(url, '[.]([a-z]+)$', 1) as suffix from pages) group by host")
def single_suffix(spark, sf_dir):
    """One suffix in a folder."""
    p = t(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", "://([^/?#]*)", 1))
    return R.single_suffix(p, ["host"], F.regexp_extract("url", "[.]([a-z]+)$", 1))


@query("select label, vec_id, min(i % 8) as x0, min(i // 8) as y0, max(i % 8) + 1 as x1, max(i // 8) + 1 as y1 from (select label, vec_id, cast(g - 1 as integer) as i, embedding[g] as v from (select label, vec_id, embedding, unnest(range(1, len(embedding) + 1)) as g from embeddings)) where v > 0.1 group by label, vec_id")
def bounding_box(spark, sf_dir):
    """The box around cells above a value."""
    cells = t(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("i", "v"))
    cells = cells.withColumn("x", F.col("i") % 8).withColumn("y", F.expr("cast(i div 8 as int)"))
    return R.bounding_box(cells, ["label", "vec_id"], "x", "y", F.col("v") > F.lit(0.1).cast("double"))


@query("select l_orderkey, l_linenumber, l_partkey, coalesce(r, 0) as r, coalesce(g, 0) as g, coalesce(b, 0) as b from lineitem left join (values (0, 255, 255, 255), (1, 0, 0, 0), (2, 255, 0, 0)) p(i, r, g, b) on l_partkey % 4 = i")
def palette_lookup(spark, sf_dir):
    """Index to colour; a missing index is transparent."""
    palette = spark.createDataFrame([(0, 255, 255, 255), (1, 0, 0, 0), (2, 255, 0, 0)], "i bigint, r int, g int, b int")
    px = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 4).alias("i"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return px.join(F.broadcast(palette), "i", "left").select("l_orderkey", "l_linenumber", "l_partkey", zero("r"), zero("g"), zero("b"))


RGB = "greatest(0, least(255, ({}) >> 8))"
YUV = "select l_orderkey, l_linenumber, l_partkey, cast(l_partkey % 256 as integer) - 16 as c, cast(l_suppkey % 256 as integer) - 128 as d, cast(l_orderkey % 256 as integer) - 128 as e from lineitem"


@query(f"select l_orderkey, l_linenumber, l_partkey, {RGB.format('298*c + 409*e + 128')} as r, {RGB.format('298*c - 100*d - 208*e + 128')} as g, {RGB.format('298*c + 516*d + 128')} as b from ({YUV})")
def ycbcr_rgb(spark, sf_dir):
    """Broadcast colours to screen colours in integers."""
    r, g, b = E.ycbcr_to_rgb(F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_orderkey") % 256)
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r.alias("r"), g.alias("g"), b.alias("b"))


@query("select event_id, user_id, last_value(case when event_type = 'signup' then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as in_force from events")
def asof_palette(spark, sf_dir):
    """The last definition before."""
    return R.as_of(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("value")), "in_force").select("event_id", "user_id", "in_force")


@query("select event_id, user_id, cast(sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as generation from events")
def object_generations(spark, sf_dir):
    """Runs of parts that begin with a first one."""
    return R.generations(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup").select("event_id", "user_id", "generation")


@query("select user_id, event_type, arg_max(event_id, (epoch_us(ts), event_id)) as event_id, arg_max(value, (epoch_us(ts), event_id)) as value from events group by all")
def upsert_latest(spark, sf_dir):
    """Last write wins."""
    return R.latest(t(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"])


ORDERED = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"


@query(f"select l_orderkey, count(*) as parts, cast(sum(least(q, 40 - before)) as bigint) as size from (select l_orderkey, cast(l_quantity as bigint) as q, coalesce(sum(cast(l_quantity as bigint)) over (partition by l_orderkey order by {ORDERED} rows between unbounded preceding and 1 preceding), 0) as before from lineitem) where before < 40 group by l_orderkey")
def early_stop_concat(spark, sf_dir):
    """Parts until the declared size is reached."""
    li = t(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("bigint"))
    got = R.early_stop(li, ["l_orderkey"], ORDERED.split(", "), F.col("q"), F.lit(40))
    return got.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("parts"), F.sum("taken").alias("size"))


# Recognised text


@query("select conv_id as sheet, count(*) as expected from conversations group by conv_id")
def expected_count(spark, sf_dir):
    """Items of a sheet."""
    return t(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("sheet")).agg(F.count(F.lit(1)).alias("expected"))


@query("select conv_id as sheet, string_agg(text, '|' order by turn) as items, count(*) as expected from conversations group by conv_id")
def sheet_items_sorted(spark, sf_dir):
    """Items by position."""
    got = R.sheet_items(t(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "sheet"), ["sheet"], "turn", "text")
    return got.select("sheet", F.array_join("items", "|").alias("items"), "expected")


def joined_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = R.sheet_items(t(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")
    return got.select("conv_id", F.array_join("items", "\n 0123456789\t\n").alias("text"), "expected")


@query(r"select conv_id, n, regexp_replace(text, '^[\s]+|[\s]+$', '', 'g') as line from (select conv_id, text, cast(row_number() over (partition by conv_id order by turn) as integer) as n from conversations)")
def separator_split(spark, sf_dir):
    """Lines between separators."""
    return joined_turns(spark, sf_dir).select("conv_id", F.posexplode(E.split_lines("text")).alias("n", "line")).select("conv_id", (F.col("n") + 1).alias("n"), "line")


@query("select conv_id, n, line from (select conv_id, unnest([1, 2, 3]) as n, unnest(case when len(ls) <= 3 then list_concat(ls, list_transform(range(3 - len(ls)), lambda x: '')) else list_concat(ls[1:2], [array_to_string(ls[3:], ' ')]) end) as line from (select conv_id, list(trim(text) order by turn) as ls from conversations group by conv_id))")
def align_lines(spark, sf_dir):
    """Exactly three lines."""
    got = joined_turns(spark, sf_dir).select("conv_id", F.posexplode(E.align_lines(E.split_lines("text"), 3)).alias("n", "line"))
    return got.select("conv_id", (F.col("n") + 1).alias("n"), "line")


@query("select conv_id, 4 as expected, count(*) as got from conversations group by conv_id having count(*) <> 4")
def strict_mismatch(spark, sf_dir):
    """Sheets whose lines aren't as many as their cues."""
    return joined_turns(spark, sf_dir).select("conv_id", F.lit(4).alias("expected"), F.size(E.split_lines("text")).cast("bigint").alias("got")).where("expected <> got")


@query("select conv_id, turn, case when rn <= 3 then trim(text) else '[img:' || printf('sheet_%04d.png', conv_id) || '#' || printf('%02d', turn) || ']' end as text from (select *, row_number() over (partition by conv_id order by turn) as rn from conversations)")
def backfill(spark, sf_dir):
    """The first three lines of each sheet go to its cues, markers to the others."""
    c = t(spark, sf_dir, "conversations")
    lines = joined_turns(spark, sf_dir).select("conv_id", F.slice(E.split_lines("text"), 1, 3).alias("lines"))
    return R.zip_lines(c.select("conv_id", "turn"), lines, ["conv_id"], "turn").select("conv_id", "turn", E.marker_fallback("line", E.sheet_name("conv_id"), "turn").alias("text"))


@query(r"""select conv_id, turn, case turn % 5 when 1 then trim(text) when 2 then trim(text) || ' 0123456789 ' || role when 3 then '' when 4 then '{"text": 5}' else trim(text) end as text from conversations""")
def envelope_text(spark, sf_dir):
    """Fenced and wrapped answers."""
    c = t(spark, sf_dir, "conversations")
    wrapped = F.to_json(F.struct(F.trim("text").alias("text")))
    listed = F.to_json(F.struct(F.lit("").alias("text"), F.array(F.trim("text"), F.col("role")).alias("lines")))
    k = F.col("turn") % 5
    content = F.when(k == 1, F.concat(F.lit("```json\n"), wrapped, F.lit("\n```"))).when(k == 2, listed).when(k == 3, F.lit(" {} ")).when(k == 4, F.lit('{"text": 5}')).otherwise(F.concat(F.lit("\n"), F.trim("text")))
    return c.select("conv_id", "turn", text.envelope_udf(content).alias("text"))


@query(r"""select page_id, regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?i)</(?:td|th|tr|p|div|li)>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '^\s+|\s+$', '', 'g') as text from pages""")
def markdown_strip(spark, sf_dir):
    """Text of markup."""
    return t(spark, sf_dir, "pages").select("page_id", text.markdown_text("html").alias("text"))


@query("select * from (values ('a', 1, 'AB'), ('a', 2, '0123456789'), ('a', 3, 'C'), ('b', 1, 'x y'), ('b', 2, 'z')) v(page, line_no, line)")
def box_lines(spark, sf_dir):
    """Boxes to lines (golden vectors)."""
    rows = [
        ("a", ["A", "B", "0123456789", "C"], [[10.0, 10.0, 30.0, 20.0], [35.0, 11.0, 55.0, 21.0], [10.0, 40.0, 100.0, 52.0], [10.0, 70.0, 80.0, 82.0]], None),
        ("b", [" x", "", "y ", "z"], [[], [], [51.0, 9.0, 60.0, 21.0], []], [[[0.0, 10.0], [40.0, 10.0], [40.0, 20.0]], [[0.0, 0.0]], [], [[0.0, 90.0], [9.0, 99.0]]]),
    ]
    pages = spark.createDataFrame(rows, "page string, rec_texts array<string>, rec_boxes array<array<double>>, dt_polys array<array<array<double>>>")
    return text.page_lines(pages, ["page"])


@query("select doc_id as cue_index, doc_id * 1000 as start_ms, doc_id * 1000 + n_chars as end_ms, printf('sheet_%04d.png', doc_id // 6 + 1) as sheet, cast(doc_id % 6 + 1 as integer) as position_in_sheet from documents")
def mapping_roundtrip(spark, sf_dir):
    """Items to JSON and back."""
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").cast("int").alias("cue_index"), (F.col("doc_id") * 1000).alias("start_ms"), (F.col("doc_id") * 1000 + F.col("n_chars")).alias("end_ms"), E.sheet_name(F.expr("doc_id div 6 + 1")).alias("sheet"), (F.col("doc_id") % 6 + 1).cast("int").alias("position_in_sheet"))
    files_ = d.groupBy((F.col("cue_index") % 16).alias("file")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("*"))).alias("items"))).alias("json"))
    back = files_.select(F.explode(F.from_json("json", schemas.struct(schemas.MAPPING))["items"]).alias("i")).select("i.*")
    return back.withColumn("cue_index", F.col("cue_index").cast("bigint"))


# Streams


@query(f"""with {STREAMS}, c as (select stream_id, row_number() over w as cue_index, (us * 9 // 100 + 45) // 90 as start_ms, lead((us * 9 // 100 + 45) // 90) over w as nxt from s window w as (partition by stream_id order by us, event_id))
select stream_id, cast(cue_index as integer) as cue_index, start_ms, case when coalesce(nxt, start_ms + 2000) <= start_ms then start_ms + 500 else coalesce(nxt, start_ms + 2000) end as end_ms from c""")
def pgs_cues(spark, sf_dir):
    """Bytes made from events, split, folded, drawn and timed."""
    return frames.shown_cues(frames.pgs_frames(X.pgs_files_of(t(spark, sf_dir, "events"))))


@query(f"with {STREAMS} select stream_id, 2 * count(*) + 2 as segments, 1::bigint as palettes, 1::bigint as objects from s group by stream_id")
def pgs_segments(spark, sf_dir):
    """Packets of each stream by kind."""
    s = frames.pgs_segments(X.pgs_files_of(t(spark, sf_dir, "events")))
    n = lambda k: F.sum((F.col("seg_type") == k).cast("int"))
    return s.groupBy("stream_id").agg(F.count(F.lit(1)).alias("segments"), n(pgs.PDS).alias("palettes"), n(pgs.ODS).alias("objects"))


@query(f"with {STREAMS} select stream_id, cast(2 * row_number() over (partition by stream_id order by us, event_id) + 1 as integer) as seg_no, 0 as palette_seg_no from s")
def pgs_palette_in_force(spark, sf_dir):
    """The palette packet that each display set is drawn with, without a fold."""
    return frames.palettes_in_force(frames.pgs_segments(X.pgs_files_of(t(spark, sf_dir, "events"))))


@query(f"with {STREAMS} select stream_id, count(*) as n_frames, 255 * 4 * count(*) as byte_sum from s group by stream_id")
def pgs_fold(spark, sf_dir):
    """D2 as a fold over a sorted table of segments; pixels of the frames."""
    shown = frames.fold_segments(frames.pgs_segments(X.pgs_files_of(t(spark, sf_dir, "events"))))
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.conv(F.hex(F.substring("rgba", i, 1)), 16, 10).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return shown.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_frames"), F.sum(total).alias("byte_sum"))


def colour_counts(key: str = "key") -> str:
    return f"select l_orderkey as {key}, cast(l_partkey % 4 as integer) as colour, cast(sum(cast(l_quantity as integer)) as bigint) as n from lineitem group by all"


def decoded_counts(df: DataFrame, decode: Callable[..., np.ndarray]) -> DataFrame:
    """Pixels of each key by colour; decode(columns behind the key) gives a key's colours. Array columns come as numpy arrays."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = schemas.struct("key bigint, colour int, n bigint")
    arrow = to_arrow_schema(schema)

    def values(column: pa.Array) -> list:
        if not pa.types.is_list(column.type):
            return column.to_pylist()
        ends = np.cumsum(column.value_lengths().to_numpy())
        return np.split(column.flatten().to_numpy().view(np.uint8), ends[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in frames.pieces(batch):
                got = [decode(*row) for row in zip(*map(values, part.columns[1:]), strict=True)]
                place = np.repeat(np.arange(len(got)), [len(g) for g in got]) * 256 + np.concatenate(got)
                counts = np.bincount(place)
                seen = counts.nonzero()[0]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(seen // 256)), pa.array(seen % 256, pa.int32()), pa.array(counts[seen])], schema=arrow)

    return df.mapInArrow(run, schema)


@query(colour_counts())
def pgs_rle_pixels(spark, sf_dir):
    """Run codes written by expressions, read by the codec."""
    return decoded_counts(X.run_codes(t(spark, sf_dir, "lineitem")).select("key", "pgs", "width"), lambda codes, width: pgs.decode_runs(bytes.fromhex(codes), width, 1).ravel())


@query(colour_counts())
def pgs_rle_round_trip(spark, sf_dir):
    """Run codes of the codec's own writer."""
    return decoded_counts(X.pixel_rows(t(spark, sf_dir, "lineitem")), lambda row: pgs.decode_runs(pgs.encode_runs(row[None]), len(row), 1).ravel())


@query(colour_counts())
def vobsub_rle_pixels(spark, sf_dir):
    """Units put together from codes that expressions wrote, read by the codec, by colour."""
    palette = [0x010000, 0x020000, 0x030000, 0x040000]
    return decoded_counts(X.run_codes(t(spark, sf_dir, "lineitem")).select("key", "nibbles", "width"), lambda nibbles, width: vobsub.decode_unit(X.unit_of_codes(nibbles, width), palette)[..., 0].ravel() - 1)


@query(colour_counts())
def vobsub_rle_round_trip(spark, sf_dir):
    """Units of the codec's own writer."""
    palette = [0x010000, 0x020000, 0x030000, 0x040000]
    return decoded_counts(X.pixel_rows(t(spark, sf_dir, "lineitem")), lambda row: vobsub.decode_unit(vobsub.encode_unit(row[None]), palette)[..., 0].ravel() - 1)


GREY = "((298 * (luma - 16) + 128) >> 8)"


@query(f"""with p as (select cast(p_partkey as varchar) as stream_id, p_partkey, p_size as w, p_partkey % 200 + 16 as luma from part)
select stream_id, 1 as cue_index, p_partkey as start_ms, p_partkey + 10 as end_ms, 2 * w + 5 as width, 7 as height, cast({GREY} * 6 * w + 255 * 4 * w as bigint) as red, cast(255 * 10 * w as bigint) as alpha, cast({GREY} * 6 * w * (w - 1) // 2 + 255 * 4 * (w * (w + 5) + w * (w - 1) // 2) as bigint) as red_by_x, cast({GREY} * w * 15 + 255 * w * 18 as bigint) as red_by_y from p
union all select stream_id, 2, p_partkey + 10, p_partkey + 2010, 5, 3, 255 * 15, 255 * 15, 255 * 30, 255 * 15 from p""")
def pgs_pixels(spark, sf_dir):
    """Several parts, a crop, two objects, a replaced object and palette, an unknown object; sums of pixels, plain and by place."""
    # times go with the frames, so that streams are decoded once
    sums = pixel_sums(frames.timed_frames(frames.pgs_frames(X.rich_files_of(t(spark, sf_dir, "part")))), ("red", "alpha", "red_by_x", "red_by_y"))
    return R.infer_ends(sums, ["stream_id"], ["cue_index"]).select("stream_id", "cue_index", "start_ms", "end_ms", "width", "height", "red", "alpha", "red_by_x", "red_by_y")


def pixel_sums(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """stream_id, cue_index, width, height of frames (start_ms, if they have it) and sums of their red and alpha values, plain and times the column or row."""
    import numpy as np

    keys = [c for c in ("stream_id", "cue_index", "start_ms", "width", "height") if c in df.columns]
    sums = {
        "red": lambda px: px[..., 0].sum(dtype=np.int64),
        "alpha": lambda px: px[..., 3].sum(dtype=np.int64),
        "red_by_x": lambda px: px[..., 0].sum(axis=0, dtype=np.int64) @ np.arange(px.shape[1]),
        "red_by_y": lambda px: px[..., 0].sum(axis=1, dtype=np.int64) @ np.arange(px.shape[0]),
    }

    def make(r: dict) -> list[tuple]:
        px = np.frombuffer(r["rgba"], np.uint8).reshape(r["height"], r["width"], 4)
        return [(*(r[k] for k in keys), *(int(sums[n](px)) for n in names))]

    return X.map_rows(df.select(*keys, "rgba"), make, ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), *(f"{n} bigint" for n in names)]))


def unit_bytes(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, digest: of the units read back from each text's packets, end to end."""
    import hashlib

    def make(r: dict) -> list[tuple]:
        ends = [*r["starts"][1:], len(r["content"])]
        body = b"".join(vobsub.find_unit(r["content"], a, b, 0x20)[2:] for a, b in zip(r["starts"], ends, strict=True))
        return [(r["doc_id"], len(body), hashlib.sha256(body).hexdigest())]

    return X.map_rows(X.spu_rows(documents), make, "doc_id bigint, n_bytes bigint, digest string")


@query("select doc_id, octet_length(encode(coalesce(text, ''))) as n_bytes, sha256(coalesce(text, '')) as digest from documents")
def spu_merge(spark, sf_dir):
    """Whole texts as units from packets of two header forms, beside another stream's; sizes and bytes."""
    return unit_bytes(t(spark, sf_dir, "documents"))


@query(f"""with {STREAMS}, c as (select stream_id, event_id, row_number() over w as cue_index, us // 1000 as start_ms, lead(us // 1000) over w as nxt from s window w as (partition by stream_id order by us, event_id))
select stream_id, cast(cue_index as integer) as cue_index, start_ms, case when coalesce(nxt, start_ms + 2000) <= start_ms then start_ms + 500 else coalesce(nxt, start_ms + 2000) end as end_ms, cast(1 + event_id % 7 as integer) as width, 3 as height, 255 * (1 + event_id % 7) as red, 765 * (1 + event_id % 7) as alpha, 255 * (1 + event_id % 7) as red_by_y from c""")
def vobsub_cues(spark, sf_dir):
    """Index texts joined with data files, byte spans, units, fields, colours and times."""
    events = t(spark, sf_dir, "events")
    texts = X.idx_texts_of(events)
    got = frames.vobsub_frames(X.sub_files_of(events), idx.entries(idx.lines(texts)), idx.header(texts))
    sums = pixel_sums(got, ("red", "alpha", "red_by_y"))
    return R.infer_ends(sums, ["stream_id"], ["cue_index"]).select("stream_id", "cue_index", "start_ms", "end_ms", "width", "height", "red", "alpha", "red_by_y")


@query(f"with {STREAMS} select stream_id, cast(row_number() over (partition by stream_id order by us, event_id) as integer) as entry_no, us // 1000 as start_ms, (row_number() over (partition by stream_id order by us, event_id) - 1) * 2048 as file_pos from s")
def idx_entries(spark, sf_dir):
    """Entries of index texts."""
    return idx.entries(idx.lines(X.idx_texts_of(t(spark, sf_dir, "events"))))


GOLDEN_IDX = [
    ("a", "palette: 000001, xyz, 0000FF, , FFFFFF\nlangidx: 4"),
    ("b", "PALETTE: 1,2,3\n# palette: 9\npalette: ,ff\nlangidx: 1\nlangidx: x\nlangidx: -3"),
    ("c", "langidx: 99\n\ntimestamp: 00:00:01:000, filepos: 0"),
    ("d", "palette:"),
]


@query("select * from (values ('a', '1,0,255,0,16777215,0,0,0,0,0,0,0,0,0,0,0'), ('b', '1,255,3,0,0,0,0,0,0,0,0,0,0,0,0,0'), ('c', '0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0'), ('d', '0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0')) v(stream_id, palette)")
def idx_palette(spark, sf_dir):
    """V2, M14, R26 (golden vectors)."""
    h = idx.header(spark.createDataFrame(GOLDEN_IDX, "stream_id string, text string"))
    return h.select("stream_id", F.array_join(F.transform("palette", lambda x: x.cast("string")), ",").alias("palette"))


@query("select * from (values ('a', 4), ('b', 0), ('c', 31), ('d', 0)) v(stream_id, lang_idx)")
def idx_langidx(spark, sf_dir):
    """V3, V12 (golden vectors)."""
    return idx.header(spark.createDataFrame(GOLDEN_IDX, "stream_id string, text string")).select("stream_id", "lang_idx")


# Frames


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What frames are made of: a row each, dealt over the tasks."""
    return X.dealt(t(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").cast("int").alias("p_partkey"), "p_size"), "p_partkey")


def made_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each part: a white box at (2, 3) of p_size x (p_size // 2 + 1) pixels with a border of 4 to the right and below."""
    import numpy as np

    def make(r: dict) -> list[tuple]:
        w, h = r["p_size"], r["p_size"] // 2 + 1
        img = np.zeros((h + 7, w + 6, 4), np.uint8)
        img[3 : 3 + h, 2 : 2 + w] = 255
        return [(r["p_brand"], r["p_partkey"], w + 6, h + 7, img.tobytes())]

    return X.map_rows(parts(spark, sf_dir), make, "stream_id string, cue_index int, width int, height int, rgba binary")


@query("select p_partkey, least(w, 40) as width, case when w <= 40 then h else cast(greatest(1, floor(h * (40.0::double / w) + 0.5)) as integer) end as height from (select cast(p_partkey as integer) as p_partkey, p_size + 20 as w, p_size // 2 + 21 as h from part)")
def preprocess_geometry(spark, sf_dir):
    """Crop, pad and shrink frames."""
    done = frames.preprocess(made_frames(spark, sf_dir), max_width=40, padding=10, force_white=True)
    return done.select(F.col("cue_index").alias("p_partkey"), "width", "height")


@query(f"with z as (select p_brand, p_partkey, p_size + 6 as width, p_size // 2 + 8 as height, cast((row_number() over (partition by p_brand order by p_partkey) - 1) // 6 + 1 as integer) as sheet_no from part) select p_brand as stream_id, printf('sheet_%04d.png', sheet_no) as sheet, max(width) as width, cast(sum(height) + greatest(12, min(height)) * count(*) as integer) as height, cast(count(*) as integer) as n_cues from z group by p_brand, sheet_no")
def compose_sheets(spark, sf_dir):
    """Sheets drawn, with their sizes read back from the images."""
    from glyphreel.operators import compose

    sheets = compose.compose(made_frames(spark, sf_dir))
    return sheets.select("stream_id", "sheet", E.be_uint("png", 16, 4).cast("int").alias("width"), E.be_uint("png", 20, 4).cast("int").alias("height"), F.size("cue_indexes").alias("n_cues"))


def drawn(spark: SparkSession, sf_dir: str, shade, right: int = 4, low: int = 3) -> DataFrame:
    """made_frames with a box of other values: shade(h, w) gives its (h, w, 4) pixels; borders as wide as told."""
    import numpy as np

    def make(r: dict) -> list[tuple]:
        w, h = r["p_size"], r["p_size"] // 2 + 1
        img = np.zeros((h + low + 3, w + right + 2, 4), np.uint8)
        img[3 : 3 + h, 2 : 2 + w] = shade(h, w)
        return [(r["p_brand"], r["p_partkey"], img.shape[1], img.shape[0], img.tobytes())]

    return X.map_rows(parts(spark, sf_dir), make, "stream_id string, cue_index int, width int, height int, rgba binary")


def flat(colour: tuple[int, int, int, int]):
    import numpy as np

    return lambda h, w: np.full((h, w, 4), colour, np.uint8)


BOXES = "(select p_brand as stream_id, cast(p_partkey as integer) as cue_index, p_size as w, p_size // 2 + 1 as h from part)"


def padded_sql(red: int) -> str:
    return f"select stream_id, cue_index, cast(w + 20 as integer) as width, cast(h + 20 as integer) as height, {red} * w * h as red, 255 * w * h as alpha, {red} * h * (10 * w + w * (w - 1) // 2) as red_by_x, {red} * w * (10 * h + h * (h - 1) // 2) as red_by_y from {BOXES}"


@query(padded_sql(40))
def crop_pad_pixels(spark, sf_dir):
    """Pixels of frames cropped to their alpha and padded, by value and place."""
    done = frames.preprocess(drawn(spark, sf_dir, flat((40, 90, 7, 255))), max_width=1080, padding=10)
    return pixel_sums(done, ("red", "alpha", "red_by_x", "red_by_y"))


@query(padded_sql(255))
def force_white_pixels(spark, sf_dir):
    """The same, whitened."""
    done = frames.preprocess(drawn(spark, sf_dir, flat((40, 90, 7, 255))), max_width=1080, padding=10, force_white=True)
    return pixel_sums(done, ("red", "alpha", "red_by_x", "red_by_y"))


def on_ground(h: int, w: int):
    import numpy as np

    img = np.full((h + 6, w + 6, 4), (9, 9, 9, 255), np.uint8)
    img[3 : 3 + h, 2 : 2 + w] = (200, 1, 2, 255)
    return img


@query(f"select stream_id, cue_index, cast(w as integer) as width, cast(h as integer) as height, 200 * w * h as red, 255 * w * h as alpha from {BOXES}")
def solid_crop_pixels(spark, sf_dir):
    """Opaque frames cropped to what differs from the colour of their corners."""

    def make(r: dict) -> list[tuple]:
        img = on_ground(r["p_size"] // 2 + 1, r["p_size"])
        return [(r["p_brand"], r["p_partkey"], img.shape[1], img.shape[0], img.tobytes())]

    made = X.map_rows(parts(spark, sf_dir), make, "stream_id string, cue_index int, width int, height int, rgba binary")
    return pixel_sums(frames.preprocess(made, max_width=1080, padding=0, solid_fallback=True), ("red", "alpha"))


def slope(h: int, w: int):
    import numpy as np

    img = np.full((h, w, 4), 255, np.uint8)
    img[..., 0] = (np.arange(w) * 7 + np.arange(h)[:, None] * 13) % 256
    return img


@query(f"""with b as (select *, cast(greatest(1, floor(h * (16.0::double / w) + 0.5)) as integer) as nh from {BOXES} where w > 16),
ax as (select stream_id, cue_index, w, h, nh, i, (i + 0.5) * (w / 16.0::double) - 0.5 as pos from b, range(16) r(i)),
ay as (select stream_id, cue_index, i as j, (i + 0.5) * (h / nh::double) - 0.5 as pos, h from b, range(60) r(i) where i < nh),
tx as (select stream_id, cue_index, w, h, nh, i, cast(greatest(floor(pos), 0) as bigint) as x0, cast(least(floor(pos) + 1, w - 1) as bigint) as x1, pos - floor(pos) as wx from ax),
ty as (select stream_id, cue_index, j, cast(greatest(floor(pos), 0) as bigint) as y0, cast(least(floor(pos) + 1, h - 1) as bigint) as y1, pos - floor(pos) as wy from ay),
px as (select stream_id, cue_index, nh, i, wx, wy, ((x0 * 7 + y0 * 13) % 256)::double as a, ((x1 * 7 + y0 * 13) % 256)::double as b, ((x0 * 7 + y1 * 13) % 256)::double as c, ((x1 * 7 + y1 * 13) % 256)::double as d from tx join ty using (stream_id, cue_index)),
v as (select stream_id, cue_index, nh, i, cast(floor(greatest(0, least(255, (a + (b - a) * wx) + ((c + (d - c) * wx) - (a + (b - a) * wx)) * wy)) + 0.5) as bigint) as v from px)
select stream_id, cue_index, 16 as width, nh as height, cast(sum(v) as bigint) as red, cast(sum(v * i) as bigint) as red_by_x from v group by stream_id, cue_index, nh""")
def shrink_pixels(spark, sf_dir):
    """Every pixel of frames shrunk to 16 columns."""
    made = drawn(spark, sf_dir, slope).where("width > 22")
    return pixel_sums(frames.preprocess(made, max_width=16, padding=0), ("red", "red_by_x"))


@query(f"""with z as (select stream_id, cue_index, w, h, cast((row_number() over (partition by stream_id order by cue_index) - 1) // 6 + 1 as integer) as sheet_no from {BOXES}),
s as (select stream_id, sheet_no, max(w + 6) as width, sum(h + 6) + 12 * (count(*) - 1) as height, count(*) as n, sum(40 * w * h) as boxes from z group by all)
select stream_id, printf('sheet_%04d.png', sheet_no) as sheet, cast(width as integer) as width, cast(height as integer) as height, cast(boxes + 255 * 12 * width * (n - 1) as bigint) as red, cast(255 * width * height as bigint) as alpha from s""")
def compose_pixels(spark, sf_dir):
    """Pixels of sheets, read back from their images."""
    from glyphreel.codecs import png
    from glyphreel.operators import compose

    def make(r: dict) -> list[tuple]:
        px = png.decode(r["png"]).astype(int)
        return [(r["stream_id"], r["sheet"], px.shape[1], px.shape[0], int(px[..., 0].sum()), int(px[..., 3].sum()))]

    sheets = compose.compose(drawn(spark, sf_dir, flat((40, 90, 7, 255))), layout="no-row-index")
    return X.map_rows(sheets.select("stream_id", "sheet", "png"), make, "stream_id string, sheet string, width int, height int, red bigint, alpha bigint")


@query("select p_brand as stream_id, cast(p_partkey as integer) as cue_index, cast(p_size as integer) as width, 3 as height, 3 * p_size * (p_partkey % 256) as red, 255 * 3 * p_size as alpha from part")
def image_decode(spark, sf_dir):
    """PNG files that the codec did not write."""
    import numpy as np

    def make(r: dict) -> list[tuple]:
        return [(r["p_brand"], r["p_partkey"], X.plain_png(np.full((3, r["p_size"], 4), (r["p_partkey"] % 256, 5, 6, 255), np.uint8)))]

    made = X.map_rows(parts(spark, sf_dir), make, "stream_id string, cue_index int, content binary")
    return pixel_sums(frames.image_frames(made), ("red", "alpha"))


def recognised(spark: SparkSession, sf_dir: str, expected: int, strict: bool) -> DataFrame:
    """Conversations as sheets, recognised by a stand-in for the service that reads the image's bytes as text."""
    from glyphreel.ocr import runner

    def make():
        return lambda sheet, png, expected, dump: png.decode()

    sheets = joined_turns(spark, sf_dir).select(F.col("conv_id").cast("string").alias("sheet"), F.encode("text", "UTF-8").alias("png"), F.lit(expected).alias("expected"))
    return runner.recognise(sheets, make, 4, strict)


@query("select cast(conv_id as varchar) as sheet, n, line from (select conv_id, unnest([1, 2, 3]) as n, unnest(case when len(ls) <= 3 then list_concat(ls, list_transform(range(3 - len(ls)), lambda x: '')) else list_concat(ls[1:2], [array_to_string(ls[3:], ' ')]) end) as line from (select conv_id, list(trim(text) order by turn) as ls from conversations group by conv_id))")
def ocr_lines(spark, sf_dir):
    """Sheets through the runner with a stand-in for the service, lines aligned with the cues."""
    got = recognised(spark, sf_dir, 3, False)
    return got.select("sheet", F.posexplode("lines").alias("n", "line")).select("sheet", (F.col("n") + 1).alias("n"), "line")


@query("select cast(conv_id as varchar) as sheet, case when count(*) = 4 then 1 else 5 end as attempts, case when count(*) <> 4 then 'strict' end as error_kind, case when count(*) <> 4 then cast(conv_id as varchar) || ': ' || cast(count(*) as varchar) || ' lines instead of 4 in the last of 5 attempts' end as error from conversations group by conv_id")
def ocr_strict(spark, sf_dir):
    """Sheets asked again until their lines fit, five times at most."""
    return recognised(spark, sf_dir, 4, True).select("sheet", "attempts", "error_kind", "error")


@query("select a, c, case when a = 0 then 0 when a = 255 then c else ((c * 65535 // a) >> 8) % 256 end as straight from (select a, c from range(256) x(a), range(256) y(c))")
def straight_alpha(spark, sf_dir):
    """Every pair of alpha and colour out of the premultiplied container, wrap included."""
    import numpy as np

    def make(r: dict) -> list[tuple]:
        px = np.zeros((1, 257, 4), np.uint8)
        px[0, :256, 0], px[0, :256, 3] = np.arange(256), r["id"]
        return [(r["id"], c, int(v)) for c, v in enumerate(pixels.unpremultiply(px)[0, :256, 0])]

    return X.map_rows(spark.range(256), make, "a bigint, c bigint, straight bigint")


@query("select doc_id, 'data:image/png;base64,' || base64(encode(text)) as uri from documents")
def sheet_data_uri(spark, sf_dir):
    """Bytes as a data address."""
    return t(spark, sf_dir, "documents").select("doc_id", E.data_uri(F.encode("text", "UTF-8")).alias("uri"))


@query("select doc_id, 'Give ' || cast(n_chars as varchar) || ' {lines}' as prompt from documents")
def prompt_template(spark, sf_dir):
    """Templates with a count and doubled braces."""
    return t(spark, sf_dir, "documents").select("doc_id", E.render_template(F.lit("Give {expected_count} {{lines}}"), F.col("n_chars")).alias("prompt"))

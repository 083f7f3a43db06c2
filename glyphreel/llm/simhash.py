"""SimHash near-duplicates: fingerprints linked at a small Hamming distance through sharded BK-trees.

A fingerprint comes from XXH64 of the word shingles of the whole text. Only distinct fingerprints are compared, each
carrying its smallest document. Two fingerprints at distance r or less agree in at least one of r + 1 blocks of bits,
so each is dealt to r + 1 shards, one for each block's value; a shard with too many fingerprints is split by blocks of
its remaining bits in the same way, which loses no link. In a shard's task a BK-tree (children keyed by the integer
distance to their parent) grows fingerprint by fingerprint; a newcomer follows only the edges within the radius of its
distance. The task returns a spanning forest of its links, never all pairs of a group. Components then come from
alternating large-star and small-star rounds on the links, each written to the shared checkpoint folder.

A tree is not broadcast: no bound on its size could be proven, as the number of fingerprints follows the corpus. The
shards' rows are brought to their tree instead.

Cases: null, empty or blank texts have no words and get fingerprint zero, linked like any other. Repeated doc_ids
each give a row. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphreel.llm.common import checkpointed, map_text, table

SEED = 42
SHINGLE = 3
RADIUS = 2
#: A shard with more fingerprints is split by further blocks.
MAX_SHARD = 2048


def words_of(text: str | None) -> list[bytes]:
    """On bytes only A-Z fall and only ASCII white space parts words."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of all shingles, repeats included; fewer words than a shingle make one, no words none."""
    from xxhash import xxh64_intdigest as h

    line = b" ".join(words)
    if len(words) <= size:
        return np.array([h(line, SEED)] if words else [], np.dtype("<u8"))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first, last = [0, *(ends[:-size] + 1).tolist()], ends[size - 1 :].tolist()
    return np.fromiter((h(line[a:b], SEED) for a, b in zip(first, last, strict=True)), np.dtype("<u8"), len(first))


def majority(hashes: np.ndarray) -> int:
    """Each bit that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned 64 bits."""
    return majority(shingle_hashes(words_of(text), size))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, keys: list[str], size: int = SHINGLE) -> DataFrame:
    """keys and fp, a long of the same bits."""
    return map_text(docs, keys, "text", lambda: lambda text: (signed(fingerprint(text, size)),), "fp long")


class BKTree:
    """add(x) gives the nodes within the radius of x, then adds x."""

    def __init__(self, radius: int):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> list[int]:
        near, r = [], self.radius
        if self.values:
            # the path to x's place is among the edges that the search would follow or beside them: walked at the end
            stack = [0]
            while stack:
                node = stack.pop()
                d = (self.values[node] ^ x).bit_count()
                if d <= r:
                    near.append(node)
                kids = self.children[node]
                if len(kids) <= 2 * r + 1:
                    stack += [k for e, k in kids.items() if d - r <= e <= d + r]
                else:
                    stack += [kids[e] for e in range(d - r, d + r + 1) if e in kids]
            node = 0
            while True:
                d = (self.values[node] ^ x).bit_count()
                if d == 0:
                    return near
                nxt = self.children[node].get(d)
                if nxt is None:
                    self.children[node][d] = len(self.values)
                    break
                node = nxt
        self.values.append(x)
        self.children.append({})
        return near


def blocks(bits: int, parts: int, start: int = 0) -> list[tuple[int, int]]:
    """(shift, width) of `parts` blocks of a run of bits."""
    edges = [start + bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def bits_of(fp, shift: int, width: int):
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def forest(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, root = None, BKTree(radius), []
        out: tuple[list[int], list[int]] = ([], [])

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for batch in batches:
            for *k, fp in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if k != key:
                    key, tree, root = k, BKTree(radius), []
                before = len(tree.values)
                near = tree.add(fp & 0xFFFFFFFFFFFFFFFF)
                if len(tree.values) == before:
                    continue
                root.append(before)
                for j in near:
                    a, b = top(before), top(j)
                    if a != b:
                        root[a] = b
                        out[0].append(fp)
                        out[1].append(signed(tree.values[j]))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])
                out = ([], [])

    return run


def links(fps: DataFrame, radius: int = RADIUS, max_shard: int = MAX_SHARD) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) within the radius, enough to connect what is connected."""
    first = blocks(64, radius + 1)
    dealt = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("blk"), bits_of(F.col("fp"), s, w).alias("val")) for i, (s, w) in enumerate(first)))).alias("s")).select("fp", "s.blk", "s.val")
    sizes = dealt.groupBy("blk", "val").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    shared = dealt.join(sizes, ["blk", "val"])
    # a large shard's members agree in their block, so the r + 1 parts of the other bits are enough
    rest = F.when(F.lit(False), F.array(F.struct(F.lit(0).alias("sub"), F.lit(0).cast("long").alias("subval"))))
    for i in range(radius + 1):
        others = [x for j, b in enumerate(first) if j != i for x in blocks(b[1], radius + 1, b[0])]
        subs = [F.struct(F.lit(k + 1).alias("sub"), sum((bits_of(F.col("fp"), s, w) * (1 << (22 * n)) for n, (s, w) in enumerate(others[k :: radius + 1])), F.lit(0).cast("long")).alias("subval")) for k in range(radius + 1)]
        rest = rest.when((F.col("blk") == i) & (F.col("n") > max_shard), F.array(*subs))
    rest = rest.otherwise(F.array(F.struct(F.lit(0).alias("sub"), F.lit(0).cast("long").alias("subval"))))
    shards = shared.select("blk", "val", F.explode(rest).alias("s"), "fp").select("blk", "val", "s.sub", "s.subval", "fp")
    keys = ["blk", "val", "sub", "subval"]
    return shards.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(forest(radius), "a long, b long")


def components(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of the links u, v (longs): root is the smallest node that it reaches.

    Alternating large-star and small-star rounds (Kiveris et al., 2014); ends when the links stay the same,
    fails where they still change after `rounds`.
    """
    e = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = checkpointed(spark, e)
    mark = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = checkpointed(spark, e)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"links of components have not settled in {rounds} rounds")
    stars = e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct().join(stars.select("node"), "node", "left_anti"))


def grouped(spark: SparkSession, docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id for every row of docs."""
    fps = checkpointed(spark, fingerprints(docs, ["doc_id"], size))
    classes = checkpointed(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = checkpointed(spark, links(classes, radius).distinct())
    edges = found.join(classes.select(F.col("fp").alias("a"), F.col("rep").alias("u")), "a").join(classes.select(F.col("fp").alias("b"), F.col("rep").alias("v")), "b").select("u", "v")
    roots = components(spark, edges)
    member = classes.join(roots, classes["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(member, "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouped(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# The pipeline's stage: five-word shingles, of which near copies share 0.8 or more.
WIDE_SHINGLE = 5
#: Distance of fingerprints of texts that share 0.8 of their shingles: 64 * acos(0.89) / pi is 9.7; chance adds to it.
WIDE_RADIUS = 18
#: Shared part of the distinct shingles of two texts, counted on the whole sets.
SIMILAR = 0.8
#: Parts of the range of hashes (2 ** 7); the least shingle in each stands in the sketch, which only proposes pairs.
SKETCH = 128
#: Pairs whose sketches agree in less are not counted: at 0.8 about 1 of 700,000 pairs of long texts (binomial).
LOOSE = 0.62
SHARDS = 8
#: Rows of a shard that meet in one task.
PIECE = 1024
_MIX = [np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF | 1) for k in range(1, SHARDS + 1)]
_EDGES = np.arange(SKETCH, dtype="<u8") << np.uint64(57)


def digest_of(words: list[bytes]) -> bytes:
    from xxhash import xxh128_digest

    return xxh128_digest(b" ".join(words), SEED)


def signature(text: str | None) -> tuple[bytes, int, int, list[int], bytes]:
    """Digest of the words; of the distinct shingles fingerprint, number, least values in SHARDS orders, sketch."""
    words = words_of(text)
    hashes = np.unique(shingle_hashes(words, WIDE_SHINGLE))
    digest, fp, sketch = digest_of(words), signed(majority(hashes)), np.zeros(SKETCH, np.uint8)
    if not len(hashes):
        return digest, fp, 0, [0] * SHARDS, sketch.tobytes()
    least = []
    for m in _MIX:
        x = hashes * m
        x ^= x >> np.uint64(29)
        least.append(signed(int((x * np.uint64(0xD6E8FEB86659FD93)).min())))
    at = np.searchsorted(hashes, _EDGES)
    full = np.append(at[1:], len(hashes)) > at
    sketch[full] = 1 + hashes[at[full]] % np.uint64(255)  # 0 is an empty part
    return digest, fp, len(hashes), least, sketch.tobytes()


def shingle_set(text: str | None) -> tuple[bytes, bytes]:
    """Digest of the words, all distinct shingles in order."""
    words = words_of(text)
    return digest_of(words), np.unique(shingle_hashes(words, WIDE_SHINGLE)).tobytes()


def estimates(sketches: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Estimates of |A and B| / |A or B| of the rows of sketches and x, over the parts that either has."""
    same = np.count_nonzero(sketches == x, axis=1)
    none = 0 if x.all() else np.count_nonzero(sketches | x == 0, axis=1)
    return (same - none) / np.maximum(SKETCH - none, 1)


def share(a: np.ndarray, b: np.ndarray) -> float:
    """|A and B| / |A or B| of two sets in order."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return float(len(b) == 0)
    both = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
    return both / (len(a) + len(b) - both)


class Shard:
    """Rows of a shard by number of shingles; candidates(i): earlier rows that may share SIMILAR of i's shingles.

    Either will do: sketches that agree in LOOSE, or fingerprints within WIDE_RADIUS, so a pair is lost if both fail.
    """

    def __init__(self, sizes: list[int], fps: list[int], sketches: list[bytes]):
        self.sizes, self.fps = np.array(sizes, np.int64), np.array(fps, np.int64).view(np.uint64)
        self.sketches = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, SKETCH)

    def candidates(self, i: int) -> np.ndarray:
        # a set of less than 0.8 of another's size can't share 0.8 with it
        first = int(np.searchsorted(5 * self.sizes[:i], 4 * self.sizes[i]))
        near = np.bitwise_count(self.fps[first:i] ^ self.fps[i]) <= WIDE_RADIUS
        return first + np.flatnonzero(near | (estimates(self.sketches[first:i], self.sketches[i]) >= LOOSE))


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list, list[list]]]:
    """Key and columns of each run of rows that are equal in the first `keys` columns."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if row[:keys] != key:
                if held:
                    yield key, list(zip(*held, strict=True))
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield key, list(zip(*held, strict=True))


def proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (i, least, lo, hi, n, doc_id, digest, fp, sketch, orders) sorted by shard and n: those with a candidate.

    A pair counts in the first shard that it shares (orders: all least values), where it is decided; not in later ones.
    """
    for (i, least, *_), (sizes, docs, digests, fps, sketches, orders) in runs(batches, 4):
        shard, earlier = Shard(sizes, fps, sketches), np.array(orders, np.int64)[:, :i]
        hit = np.zeros(len(docs), bool)
        for k in range(1, len(docs)):
            near = shard.candidates(k)
            near = near[~(earlier[near] == earlier[k]).any(axis=1)]
            hit[near] = True
            hit[k] |= len(near) > 0
        at = np.flatnonzero(hit).tolist()
        if at:
            columns = [[i] * len(at), [least] * len(at), *([c[k] for k in at] for c in (sizes, docs, digests, fps, sketches))]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["i", "least", "n", "doc_id", "digest", "fp", "sketch"])


def wide_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (i, least, lo, hi, n, doc_id, fp, sketch, shingles) sorted by shard and n: links between documents that
    share SIMILAR of their shingles, a spanning forest of each shard. The tree's pairs are tried first, then those of
    the sketches; the sets decide.
    """
    for _, (sizes, docs, fps, sketches, sets) in runs(batches, 4):
        shard, tree, owner, place = Shard(sizes, fps, sketches), BKTree(WIDE_RADIUS), [], {}
        held = [np.frombuffer(x, "<u8") for x in sets]
        root = list(range(len(docs)))
        out: tuple[list[int], list[int]] = ([], [])

        def top(i: int, root: list[int] = root) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for me, fp in enumerate(fps):
            near = tree.add(fp & 0xFFFFFFFFFFFFFFFF)
            if fp not in place:
                place[fp] = len(owner)
                owner.append([])
            for j in chain((j for node in near for j in owner[node]), shard.candidates(me).tolist()):
                a, b = top(me), top(j)
                if a != b and share(held[me], held[j]) >= SIMILAR:
                    root[a] = b
                    out[0].append(docs[me])
                    out[1].append(docs[j])
            owner[place[fp]].append(me)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["u", "v"])


def by_shard(rows: DataFrame, columns: list[str]) -> DataFrame:
    """i, least, lo, hi, n, columns of the rows that meet others, sorted by shard and n; many are dealt in pieces."""
    sizes = rows.groupBy("i", "least").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > 1)
    pieces = F.ceil(F.col("_rows") / PIECE).cast("int")
    placed = rows.join(sizes, ["i", "least"]).withColumn("own", F.pmod(F.xxhash64("doc_id"), pieces).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), pieces - 1)))
    placed = placed.select("i", "least", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "n", *columns)
    keys = ["i", "least", "lo", "hi"]
    return placed.repartition(*keys).sortWithinPartitions(*keys, "n", "doc_id")


def near_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """node, root: documents (by doc_id) of a group of near copies of more than one text or row, and the smallest of each.

    Texts of equal words are brought together first; one of each goes on. Two texts can meet in SHARDS shards, each named
    by a least shingle, which near copies have in common with a chance of 0.8 or more: of pairs at 0.8, 0.2 ** 8 or
    one in 390,000 never meet, of closer ones fewer. A shard of many texts is dealt in pieces to tasks for each pair of
    pieces. Sketches say which texts have a candidate in a shard; only these are read again and bring all their shingles
    to it, on which every link is decided.
    """
    base = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed_docs = checkpointed(spark, map_text(base, ["doc_id"], "text", lambda: signature, "digest binary, fp long, n int, least array<long>, sketch binary"))
    reps = checkpointed(spark, signed_docs.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    texts = signed_docs.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    dealt = texts.select(F.posexplode("least").alias("i", "least"), "n", "doc_id", "digest", "fp", "sketch", F.col("least").alias("orders"))
    met = by_shard(dealt, ["doc_id", "digest", "fp", "sketch", "orders"]).mapInArrow(proposed, "i int, least long, n int, doc_id long, digest binary, fp long, sketch binary")
    met = checkpointed(spark, met.dropDuplicates(["i", "least", "doc_id"]))
    again = base.join(met.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = map_text(again, ["doc_id"], "text", lambda: shingle_set, "digest binary, shingles binary").dropDuplicates(["doc_id", "digest"])
    found = by_shard(met.join(sets, ["doc_id", "digest"]), ["doc_id", "fp", "sketch", "shingles"]).mapInArrow(wide_forest, "u long, v long")
    roots = checkpointed(spark, components(spark, found))
    # every row of the copies of a text follows the text's first
    copies = signed_docs.select("doc_id", "digest").join(reps, "digest").join(roots, F.col("rep") == F.col("node"), "left")
    return copies.select(F.col("doc_id").alias("node"), F.coalesce("root", "rep").alias("root")).where("node <> root").distinct()


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of copies and near copies (five-word shingles, 0.8).

    Rows without doc_id stay; rows that repeat a doc_id stay or go together. Null, empty and blank texts are copies of
    each other. Columns of any name pass unchanged; an empty table gives an empty table.
    """
    gone = near_copies(spark, docs).select("node")
    return docs.join(gone, docs["doc_id"] == gone["node"], "left_anti")

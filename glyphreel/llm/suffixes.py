"""Repeated passages: bytes covered by a string of WIDTH bytes that also starts in a document with a smaller id.

A suffix array of the whole corpus would hold a suffix for each byte. Here it is a sparse one, which loses no match: each
string of WIDTH bytes is filed under its anchor, the K-gram of least hash in it (the leftmost of equals). Equal strings
have equal anchors at equal places, so they are found from the suffixes that start at anchors, about two of every
SPAN + 1, each kept with the bytes before it that its strings need. No hash decides anything: the sorted bytes do.

1. A task gathers some megabytes of text, makes the suffixes of their anchors, sorts them by multikey quicksort and
   brings equal ones together: those of greater documents are repeats and end here, so what a third of all documents
   hold leaves a task once, not once for each document.
2. Splitters sampled from the corpus part the sorted suffixes into ranges (by leading bytes, then by the bytes before
   the anchor, so that a frequent suffix is parted as well). Packed runs travel to their range's bucket.
3. A bucket sorts its suffixes by multikey quicksort. Common prefixes of neighbours show which strings can have an equal;
   of strings with i bytes before the anchor, those of equal prefix and equal i bytes before are one string, of which all
   but the smallest document's are repeats.
4. Strings whose prefix reaches over a splitter may have equals in the next buckets. A bucket gives these out (the
   smallest document's only) and they are compared across the boundaries by grouping.
5. Covered spans are gathered by document, joined with the texts, and cut out.

Cases: null is the empty text; texts shorter than WIDTH lose nothing; rows of equal id don't remove each other (they may
have different texts and are told apart by a hash of it); a row without id counts as the last and is no source; an empty
table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphreel.llm.common import table, written

WIDTH = 50
K = 6
#: K-grams in a string, and the most bytes that a string has before its anchor.
SPAN = WIDTH - K + 1
BEFORE = SPAN - 1
#: A suffix as a row: WIDTH bytes from the anchor on, BEFORE bytes before it backwards, the fewest and the most bytes
#: that its strings have before the anchor; zeros where no string reaches, and to whole words.
ROW = 96
FEWEST, MOST = WIDTH + BEFORE, WIDTH + BEFORE + 1
#: Text that a bucket's suffixes stand for; a bucket has about 5 times as many bytes.
BUCKET_TEXT = 8 << 20
#: Text that a task gathers, the windows looked at at once, and the suffixes that are sorted at once.
GATHERED, SLICE, SORTED = 4 << 20, 1 << 17, 150_000
#: Suffixes sampled for each bucket.
SAMPLED = 32
LAST = (1 << 63) - 1

U = np.uint64
_LOW = U((1 << 20) - 1)


def minimizers(data: np.ndarray) -> np.ndarray:
    """Of each string of WIDTH bytes the place of its anchor; len(data) is at most 2 ** 20."""
    n = len(data) - K + 1
    h = np.ndarray((n,), "<u8", np.append(data, np.zeros(8 - K, np.uint8)), strides=(1,)) & U((1 << 8 * K) - 1)
    h *= U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    h &= ~_LOW
    h |= np.arange(n, dtype=U)
    wide = 1
    while 2 * wide <= SPAN:
        h = np.minimum(h[:-wide], h[wide:])
        wide *= 2
    if wide < SPAN:
        h = np.minimum(h[: wide - SPAN], h[SPAN - wide :])
    return (h & _LOW).astype(np.int64)


def anchored(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last) of runs of strings with one anchor; valid: strings that lie in one text."""
    place = minimizers(data)
    place[~valid] = -1
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], len(place)) - 1
    held = place[first] >= 0
    return place[first[held]], first[held], last[held]


def suffix_rows(padded: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Rows of the suffixes at place; padded has BEFORE bytes in front and WIDTH behind."""
    around = np.lib.stride_tricks.sliding_window_view(padded, BEFORE + WIDTH)[place]
    fewest, most = place - last, place - first
    out = np.zeros((len(place), ROW), np.uint8)
    out[:, :WIDTH] = around[:, BEFORE:] * (np.arange(WIDTH) < (WIDTH - fewest)[:, None])
    out[:, WIDTH:FEWEST] = around[:, BEFORE - 1 :: -1] * (np.arange(BEFORE) < most[:, None])
    out[:, FEWEST], out[:, MOST] = fewest, most
    return out


def words_of_rows(rows: np.ndarray) -> np.ndarray:
    """Big-endian words of eight bytes, a line for each place in the row."""
    wide = -(-rows.shape[1] // 8) * 8
    if wide != rows.shape[1]:
        rows = np.pad(rows, ((0, 0), (0, wide - rows.shape[1])))
    return np.array(np.ascontiguousarray(rows).view(">u8").T, U, order="C")


def multikey_sort(words: np.ndarray) -> np.ndarray:
    """Order of the columns of words by multikey quicksort; stable.

    Every open group is parted by the word at its depth into less, equal and greater than its pivot, all groups in one
    sweep; the equal go on at the next word.
    """
    depths, n = words.shape
    order = np.arange(n)
    begin, size, depth = (np.array([x] if n > 1 and depths else [], np.int64) for x in (0, n, 0))
    flat = words.ravel()
    while len(begin):
        group = np.repeat(np.arange(len(size)), size)
        first = np.cumsum(size) - size
        inside = np.arange(len(group)) - first[group]
        rows = order[inside + begin[group]]
        key = flat[(depth * n)[group] + rows]
        a, b, c = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[group]
        less, equal = key < pivot, key == pivot
        cl, ce = np.cumsum(less), np.cumsum(equal)
        nl, ne = np.diff(cl[first + size - 1], prepend=0), np.diff(ce[first + size - 1], prepend=0)
        cl -= (np.cumsum(nl) - nl)[group]
        ce -= (np.cumsum(ne) - ne)[group]
        to = np.where(less, cl - 1, np.where(equal, nl[group] + ce - 1, (nl + ne)[group] + inside - cl - ce))
        order[begin[group] + to] = rows
        ng = size - nl - ne
        begin, size, depth = np.concatenate([begin, begin + nl, begin + nl + ne]), np.concatenate([nl, ne, ng]), np.concatenate([depth, depth + 1, depth])
        open_ = (size > 1) & (depth < depths)
        begin, size, depth = begin[open_], size[open_], depth[open_]
    return order


def new_runs(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """True where a column differs from the one before it in the order."""
    out = np.zeros(len(order), bool)
    out[:1] = True
    for line in words:
        held = line[order]
        out[1:] |= held[1:] != held[:-1]
    return out


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans by document and place, those that touch made one."""
    if not len(doc):
        return doc, start, stop
    at = np.lexsort((start, doc))
    doc, start, stop = doc[at], start[at], stop[at]
    # all spans of a document lie beyond those of the documents before
    far = int(stop.max()) + 2
    reach = np.maximum.accumulate(stop + doc * far)
    new = np.append(True, (start + doc * far)[1:] > reach[:-1])
    edge = np.flatnonzero(new)
    return doc[edge], start[edge], (reach - doc * far)[np.append(edge[1:], len(doc)) - 1]


_COLUMN = np.arange(FEWEST)
#: Of a message, after the rows: the bytes of rows of different suffixes (of each those that its strings hold, those
#: before the anchor forwards), how many places each has, document and place of each place, ids and hashes of the
#: documents, and settled spans (document, start, stop).
KINDS = (np.uint8, np.uint8, np.uint8, np.uint32, np.uint32, np.uint32, np.int64, np.int64, np.uint32, np.uint32, np.uint32)


def held_bytes(fewest: np.ndarray, most: np.ndarray) -> np.ndarray:
    return (_COLUMN < (WIDTH - fewest.astype(np.int64))[:, None]) | (_COLUMN >= (FEWEST - most.astype(np.int64))[:, None])


def pack(rows: np.ndarray, *others: np.ndarray) -> bytes:
    import zstandard

    fewest, most = rows[:, FEWEST], rows[:, MOST]
    forward = np.concatenate([rows[:, :WIDTH], rows[:, FEWEST - 1 : WIDTH - 1 : -1]], axis=1)
    arrays = (fewest, most, forward[held_bytes(fewest, most)], *others)
    sizes = np.array([len(a) for a in arrays], "<i8")
    return zstandard.ZstdCompressor(level=5).compress(sizes.tobytes() + b"".join(np.ascontiguousarray(a, k).tobytes() for a, k in zip(arrays, KINDS, strict=True)))


def unpack(data: bytes) -> list[np.ndarray]:
    """rows and the others."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes, at, out = np.frombuffer(raw, "<i8", len(KINDS)), 8 * len(KINDS), []
    for n, kind in zip(sizes.tolist(), KINDS, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    fewest, most, text = out[:3]
    forward = np.zeros((len(fewest), FEWEST), np.uint8)
    forward[held_bytes(fewest, most)] = text
    rows = np.zeros((len(fewest), ROW), np.uint8)
    rows[:, :WIDTH], rows[:, WIDTH:FEWEST] = forward[:, :WIDTH], forward[:, : WIDTH - 1 : -1]
    rows[:, FEWEST], rows[:, MOST] = fewest, most
    return [rows, *out[3:]]


class Gathered:
    """Texts of a task end to end: parts of texts, so that a long one is looked at in pieces that overlap."""

    def __init__(self, parts: list[tuple[int, int, int, bytes]]):
        """parts: (ord, hash, offset in its text, bytes), each of WIDTH bytes or more."""
        self.ords, self.hashes, self.offsets = (np.array([p[i] for p in parts], np.int64) for i in range(3))
        sizes = np.array([len(p[3]) for p in parts], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        self.padded = np.frombuffer(b"".join([bytes(BEFORE), *(p[3] for p in parts), bytes(WIDTH)]), np.uint8)
        self.data = self.padded[BEFORE:-WIDTH]
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[self.begin] += 1
        edge[self.begin + sizes - WIDTH + 1] -= 1
        self.valid = np.cumsum(edge[: len(self.data) - WIDTH + 1], dtype=np.int8) > 0

    def suffixes(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, first, last) of all anchored runs, at most about SORTED at once."""
        held, many = [], 0
        for at in range(0, len(self.valid), SLICE):
            valid = self.valid[at : at + SLICE]
            found = [x + at for x in anchored(self.data[at : at + len(valid) + WIDTH - 1], valid)]
            held.append(found)
            many += len(found[0])
            if many >= SORTED:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, many = [], 0
        if many:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def rows(self, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        return suffix_rows(self.padded, *found)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[Gathered]:
    """Of rows (ord, hash, text as binary)."""
    parts, size = [], 0
    for batch in batches:
        for ord_, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if not text.is_valid:
                continue
            raw = text.as_buffer()
            for at in range(0, len(raw) - WIDTH + 1, GATHERED):
                part = raw[at : at + GATHERED + WIDTH - 1].to_pybytes()
                parts.append((ord_, h, at, part))
                size += len(part)
                if size >= GATHERED:
                    yield Gathered(parts)
                    parts, size = [], 0
    if parts:
        yield Gathered(parts)


MESSAGE = "bucket int, data binary"


def send(splitters: list[bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (ord, hash, text) to messages for the buckets."""
    cuts = np.array(splitters, f"S{ROW}")

    def messages(g: Gathered, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[int, bytes]]:
        rows = g.rows(found)
        words = words_of_rows(rows)
        order = multikey_sort(words)
        new = new_runs(words, order)
        del words
        rows = rows[order]
        place, first, last = (x[order] for x in found)
        doc = np.searchsorted(g.begin, place, side="right") - 1
        ords, run, edge = g.ords[doc], np.cumsum(new) - 1, np.flatnonzero(new)
        shift = g.offsets[doc] - g.begin[doc]
        keep = ords == np.minimum.reduceat(ords, edge)[run]
        none, spans = np.zeros((0, ROW), np.uint8), merged(doc[~keep], (first + shift)[~keep], (last + shift)[~keep] + WIDTH)
        if len(spans[0]):
            known, at = np.unique(spans[0], return_inverse=True)
            yield int(g.ords[known[0]] % (len(cuts) + 1)), pack(none, *[none[:, 0]] * 3, g.ords[known], g.hashes[known], at, *spans[1:])
        texts = np.ascontiguousarray(rows[edge]).view(f"S{ROW}").ravel()
        ends = [0, *np.searchsorted(texts, cuts, side="left").tolist(), len(texts)]
        doc, run, at = doc[keep], run[keep], (place + shift)[keep]
        many = np.bincount(run, minlength=len(edge))
        upto = np.append(0, np.cumsum(many))
        for b, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if hi > lo:
                mine = slice(upto[lo], upto[hi])
                known, index = np.unique(doc[mine], return_inverse=True)
                yield b, pack(rows[edge[lo:hi]], many[lo:hi], index, at[mine], g.ords[known], g.hashes[known], *[none[:, 0]] * 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in gathered(batches):
            for found in g.suffixes():
                got = list(messages(g, found))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in got], pa.int32()), pa.array([d for _, d in got], pa.binary())], names=["bucket", "data"])

    return run


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that the first WIDTH bytes of rows have in common."""
    differ = a[:, :WIDTH] != b[..., :WIDTH]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)


class Bucket:
    """The sorted different suffixes of a range, and their places (row, ord, hash, pos)."""

    def __init__(self, messages: list[list[np.ndarray]]):
        rows, at = np.empty((sum(len(m[0]) for m in messages), ROW), np.uint8), 0
        for m in messages:  # each goes as soon as it is copied
            rows[at : at + len(m[0])] = m[0]
            at, m[0] = at + len(m[0]), None
        words = words_of_rows(rows)
        order = multikey_sort(words)
        new = new_runs(words, order)
        del words
        edge, kind = np.flatnonzero(new), np.empty(len(rows), np.int64)
        kind[order] = np.cumsum(new) - 1
        self.rows = rows[order[edge]]
        self.row = np.repeat(kind, np.concatenate([m[1] for m in messages]))
        self.ord = np.concatenate([m[4][m[2]] for m in messages])
        self.hash = np.concatenate([m[5][m[2]] for m in messages])
        self.pos = np.concatenate([m[3] for m in messages]).astype(np.int64)
        self.least = np.full(len(self.rows), LAST, np.int64)
        np.minimum.at(self.least, self.row, self.ord)
        self.fewest, self.most = self.rows[:, FEWEST].astype(np.int64), self.rows[:, MOST].astype(np.int64)

    def compare(self, low: bytes | None, high: bytes | None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, int]]]:
        """(bits, over): bit i of a row where its string with i bytes before the anchor is a smaller document's too;
        over: (rows, strings, i) that may have equals beyond the splitters low and high.
        """
        n, bits, over = len(self.rows), np.zeros(len(self.rows), U), []
        next_ = common_prefix(self.rows[1:], self.rows[:-1])
        best = np.maximum(np.append(next_, 0), np.append(0, next_))
        beyond = np.zeros(n, np.int64)
        for s in (low, high):
            if s is not None:
                beyond = np.maximum(beyond, common_prefix(self.rows, np.frombuffer(s.ljust(ROW, b"\0"), np.uint8)))
        able = np.flatnonzero(np.maximum(best, beyond) >= WIDTH - self.most)
        for i in range(BEFORE + 1):
            after = WIDTH - i
            mine = able[(self.fewest[able] <= i) & (i <= self.most[able])]
            at = mine[best[mine] >= after]
            if len(at) > 1:
                group = np.append(0, np.cumsum(next_ < after))[at]
                twin = group[1:] == group[:-1]
                more = np.append(twin, False) | np.append(False, twin)
                at, group = at[more], group[more]
            if len(at) > 1:
                keys = np.concatenate([group.astype(">u8")[:, None].view(np.uint8), self.rows[at, WIDTH : WIDTH + i]], axis=1)
                words = words_of_rows(keys)
                order = multikey_sort(words)
                new = new_runs(words, order)
                at = at[order]
                least = np.minimum.reduceat(self.least[at], np.flatnonzero(new))[np.cumsum(new) - 1]
                bits[at[self.least[at] > least]] |= U(1 << i)
            out = mine[(beyond[mine] >= after) & (bits[mine] >> U(i) & U(1) == 0)]
            if len(out):
                over.append((out, np.concatenate([self.rows[out, WIDTH : WIDTH + i][:, ::-1], self.rows[out, :after]], axis=1), i))
        return bits, over

    def spans(self, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place's index, start, stop) of what is covered."""
        whole = np.flatnonzero(self.ord > self.least[self.row])
        row, pos = self.row[whole], self.pos[whole]
        yield whole, pos - self.most[row], pos - self.fewest[row] + WIDTH
        part = np.flatnonzero((self.ord == self.least[self.row]) & (bits[self.row] != 0))
        for at in range(0, len(part), 1 << 16):
            some = part[at : at + (1 << 16)]
            on = np.zeros((len(some), SPAN + 2), np.int8)
            on[:, 1:-1] = bits[self.row[some]][:, None] >> np.arange(SPAN, dtype=U) & U(1)
            edge = np.diff(on, axis=1)
            which, least = np.nonzero(edge == 1)
            most = np.nonzero(edge == -1)[1] - 1
            yield some[which], self.pos[some[which]] - most, self.pos[some[which]] - least + WIDTH


FOUND = "ord long, hash long, start long, stop long, string binary"
_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def settle(splitters: list[bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Messages of a bucket to covered spans, and to strings that other buckets may hold."""

    def table_of(ords: np.ndarray, hashes: np.ndarray, start: np.ndarray, stop: np.ndarray, strings: np.ndarray | None = None) -> pa.RecordBatch:
        text = pa.nulls(len(ords), pa.binary())
        if strings is not None:
            text = pa.array(np.ascontiguousarray(strings).view(f"V{WIDTH}").ravel().tolist(), pa.binary())
        return pa.RecordBatch.from_arrays([*(pa.array(np.asarray(x), pa.int64()) for x in (ords, hashes, start, stop)), text], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(b, []).append(data)
        while held:
            b, packed = held.popitem()
            messages = [unpack(x) for x in packed]
            for m in messages:
                if len(m[6]):
                    yield table_of(m[4][m[6]], m[5][m[6]], m[7], m[8])
            messages = [m for m in messages if len(m[0])]
            if not messages:
                continue
            bucket = Bucket(messages)
            del messages
            bits, over = bucket.compare(splitters[b - 1] if b else None, splitters[b] if b < len(splitters) else None)
            for at, start, stop in bucket.spans(bits):
                yield table_of(bucket.ord[at], bucket.hash[at], start, stop)
            if over:
                # places of a row: those of its smallest document
                source = np.flatnonzero(bucket.ord == bucket.least[bucket.row])
                source = source[np.argsort(bucket.row[source], kind="stable")]
                begin = np.searchsorted(bucket.row[source], np.arange(len(bucket.rows) + 1))
                for rows, strings, i in over:
                    many = begin[rows + 1] - begin[rows]
                    which = np.repeat(np.arange(len(rows)), many)
                    at = source[begin[rows][which] + np.arange(len(which)) - (np.cumsum(many) - many)[which]]
                    yield table_of(bucket.ord[at], bucket.hash[at], bucket.pos[at] - i, bucket.pos[at] - i + WIDTH, strings[which])

    return run


def sampled_splitters(rows: DataFrame, total: int, bucket_text: int) -> list[bytes]:
    """At most about total / bucket_text suffix rows, from SAMPLED suffixes for each bucket (all that the driver gets).

    Texts are drawn for the sample at random until they hold some 16 kB for each bucket.
    """
    n = -(-total // bucket_text)
    if n < 2:
        return []
    share = min(1.0, (1 << 14) / bucket_text)
    part = min(1.0, SAMPLED * n * (SPAN + 1) / 2 / (share * total))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        for g in gathered(batches):
            for found in g.suffixes():
                some = rng.random(len(found[0])) < part
                chosen = g.rows(tuple(x[some] for x in found))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in chosen], pa.binary())], names=["row"])

    some = rows.where(F.rand(11) < share) if share < 1 else rows
    found = sorted(r["row"] for r in some.mapInArrow(pick, "row binary").collect())
    return sorted({found[len(found) * i // n] for i in range(1, n)}) if found else []


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def outcome(raw: bytes, spans: np.ndarray) -> tuple[int, int, int, str]:
    """spans: start and stop of each."""
    start, stop = spans[:, 0], spans[:, 1]
    _, start, stop = merged(np.zeros(len(start), np.int64), start, stop)
    kept, at = hashlib.sha256(), 0
    for a, b in zip(start.tolist(), stop.tolist(), strict=True):
        kept.update(raw[at:a])
        at = b
    kept.update(raw[at:])
    return len(raw), int((stop - start).sum()), len(start), kept.hexdigest()


PACKED = "ord long, hash long, doc_id long, packed binary"


def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ord, hash, doc_id, text as binary), the text packed for its way to its spans."""
    import zstandard

    c = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = pa.array([c.compress(x.as_buffer()) if x.is_valid else None for x in batch.column(3)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], names=[x.split()[0] for x in PACKED.split(", ")])


def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, packed text, list of spans) to doc_id and RESULT."""
    import zstandard

    none, d = np.zeros((0, 2), np.int64), zstandard.ZstdDecompressor()
    for batch in batches:
        made = []
        for packed, spans in zip(batch.column(1), batch.column(2), strict=True):
            raw = d.decompress(packed.as_buffer()) if packed.is_valid else b""
            made.append(outcome(raw, np.stack([spans.values.field(i).to_numpy() for i in range(2)], axis=1) if spans.is_valid else none))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in made], t) for i, t in enumerate([pa.int64()] * 3 + [pa.string()]))], names=["doc_id", *(x.split()[0] for x in RESULT.split(", "))])


def remove_repeats(spark: SparkSession, docs: DataFrame, bucket_text: int = BUCKET_TEXT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text).

    The driver and every task hold the splitters: ROW bytes for each bucket_text bytes of text, 12 MB for a terabyte
    at the default. On executors with more memory a larger bucket_text keeps them (and the partitions) fewer.
    """
    doc_id = F.col("doc_id").cast("long")
    raw = F.col("text").cast("string").cast("binary")
    rows = docs.select(F.coalesce(doc_id, F.lit(LAST)).alias("ord"), F.xxhash64(raw).alias("hash"), raw.alias("text"), doc_id.alias("doc_id"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = rows.select("ord", "hash", "text")
    splitters = sampled_splitters(texts, total, bucket_text)
    sent = texts.mapInArrow(send(splitters), MESSAGE)
    found = written(spark, sent.repartitionById(len(splitters) + 1, "bucket").mapInArrow(settle(splitters), FOUND), "repeats")
    across = found.where("string is not null").withColumn("least", F.min("ord").over(Window.partitionBy("string"))).where("ord > least")
    spans = found.where("string is null").drop("string").unionByName(across.drop("string", "least"))
    spans = spans.groupBy("ord", "hash").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    packed = rows.select("ord", "hash", "doc_id", "text").mapInArrow(squeeze, PACKED)
    return packed.join(spans, ["ord", "hash"], "left").select("doc_id", "packed", "spans").mapInArrow(strip, "doc_id long, " + RESULT)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, table(spark, sf_dir, "documents"))


#: For tables that fit one machine: all strings of WIDTH bytes, grouped.
SQL = f"""with d as (select doc_id, encode(coalesce(text, '')) as x, hex(x) as y from documents),
w as (select doc_id, unnest(range(0, octet_length(x) - {WIDTH - 1})) as i, unnest(list_transform(range(0, octet_length(x) - {WIDTH - 1}), lambda i: x[i + 1 : i + {WIDTH}])) as s from d),
f as (select s, min(doc_id) as least from w group by s),
hit as (select w.doc_id, i from w join f using (s) where least < w.doc_id),
run as (select doc_id, i, sum(new) over (partition by doc_id order by i) as k from (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + {WIDTH} then 0 else 1 end as new from hit)),
span as (select doc_id, k, min(i) as a, max(i) + {WIDTH} as b from run group by doc_id, k),
piece as (select doc_id, k, a, b, coalesce(lag(b) over (partition by doc_id order by k), 0) as z from span),
cut as (select doc_id, cast(sum(b - a) as bigint) as n_removed, count(*) as n_spans, max(b) as far, string_agg(substring(y, 2 * z + 1, 2 * (a - z)), '' order by k) as head from piece join d using (doc_id) group by doc_id)
select doc_id, octet_length(x) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(head, '') || substring(y, 2 * coalesce(far, 0) + 1))) as kept_sha256 from d left join cut using (doc_id)"""

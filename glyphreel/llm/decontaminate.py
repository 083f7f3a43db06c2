"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lower-cased. Windows of five words that a document shares with a test item, found
by their Karp-Rabin hashes and compared word by word, are the seeds that join documents to items. For each joined pair
the longest matches of words that no tile holds yet are marked again and again (running Karp-Rabin greedy tiling, from
long search lengths down to five words), so a passage is also found when its parts come in another order. An item is
leaked by a document when its tiles cover a share of 0.8 or more of the item's words.

The items travel to the documents in blocks of bounded size (BLOCK_BYTES of text each), one pass over the documents
for each block, so a large benchmark needs more passes, not more memory.

Cases: null or empty texts match nothing; items of fewer than five words cannot hold a match and are left out; equal
items each report; repeated documents each report; a row without id reports with a null id; a longest match that occurs
more than once takes its first place. Empty tables of documents or items give no rows. Extra columns aren't read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphreel.llm.common import table

MIN_MATCH = 5
COVERAGE = 0.8
#: Text of the benchmark that is sent to the executors at once.
BLOCK_BYTES = 8 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of n ids."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        out = out * _BASE + ids[i : len(ids) - n + 1 + i]
    return out


def tile(doc: list[int], item: list[int], least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, length), none overlapping in either, the longest marked first.

    Negative ids in doc match nothing.
    """
    used_doc, used_item = [x < 0 for x in doc], [False] * len(item)
    tiles: list[tuple[int, int, int]] = []
    mod, base = (1 << 61) - 1, 1_000_003

    def running(ids: list[int], used: list[bool], n: int) -> Iterator[tuple[int, int]]:
        """(place, hash) of each window of n unused ids; the hash rolls on within a run."""
        high, h, run = pow(base, n - 1, mod), 0, 0
        for i, x in enumerate(ids):
            if used[i]:
                h = run = 0
                continue
            if run >= n:
                h = (h - (ids[i - n] + 1) * high) % mod
            h = (h * base + x + 1) % mod
            run += 1
            if run >= n:
                yield i - n + 1, h

    n = max(least, min(len(item), 32))
    while n >= least:
        at: dict[int, list[int]] = defaultdict(list)
        for t, h in running(item, used_item, n):
            at[h].append(t)
        found, longest = [], 0
        for p, h in running(doc, used_doc, n) if at else ():
            for t in at.get(h, ()):
                k = 0
                while p + k < len(doc) and t + k < len(item) and doc[p + k] == item[t + k] and not used_doc[p + k] and not used_item[t + k]:
                    k += 1
                if k >= n:
                    found.append((k, p, t))
                    longest = max(longest, k)
        if longest > 2 * n:
            n = longest
            continue
        # longest first; a match that a new tile cuts is tried again with what is left of it
        found.sort(key=lambda m: (-m[0], m[1], m[2]))
        again = False
        for k, p, t in found:
            if any(used_doc[p : p + k]) or any(used_item[t : t + k]):
                again = again or not (all(used_doc[p : p + k]) or all(used_item[t : t + k]))
                continue
            used_doc[p : p + k] = [True] * k
            used_item[t : t + k] = [True] * k
            tiles.append((p, t, k))
        if not (again and found):
            n = n // 2 if n >= 2 * least else least if n > least else 0
    return sorted(tiles)


class Items:
    """A block of test items, ready to be matched."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        hashes, owners, places = [], [], []
        for item_id, text in rows:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            if len(ids) < MIN_MATCH:
                continue
            h = window_hashes(np.array(ids, np.uint64), MIN_MATCH)
            hashes.append(h)
            owners.append(np.full(len(h), len(self.items)))
            places.append(np.arange(len(h)))
            self.items.append((item_id, ids))
        if hashes:
            h = np.concatenate(hashes)
            order = np.argsort(h, kind="stable")
            self.hashes, self.owners, self.places = h[order], np.concatenate(owners)[order], np.concatenate(places)[order]
        else:
            self.hashes = self.owners = self.places = np.zeros(0, np.uint64)

    def match(self, text: str | None, coverage: float) -> list[tuple[int, float, int, int]]:
        """(item_id, coverage, tiles, words matched) of the items that the text leaks."""
        if not len(self.hashes):
            return []
        ws = words(text)
        if len(ws) < MIN_MATCH:
            return []
        ids = np.fromiter(map(self.vocabulary.get, ws, repeat(-1)), np.int64, len(ws))
        known = np.cumsum(np.concatenate(([0], ids >= 0)))
        whole = np.flatnonzero(known[MIN_MATCH:] - known[:-MIN_MATCH] == MIN_MATCH)
        if not len(whole):
            return []
        h = np.zeros(len(whole), np.uint64)
        for i in range(MIN_MATCH):
            h = h * _BASE + ids[whole + i].astype(np.uint64)
        first = np.searchsorted(self.hashes, h)
        hit = self.hashes[np.minimum(first, len(self.hashes) - 1)] == h
        if not hit.any():
            return []
        spots: dict[int, list[int]] = defaultdict(list)
        held: dict[int, set[int]] = defaultdict(set)
        last = np.searchsorted(self.hashes, h[hit], side="right")
        for p, a, b in zip(whole[hit].tolist(), first[hit].tolist(), last.tolist(), strict=True):
            for o, t in zip(self.owners[a:b].tolist(), self.places[a:b].tolist(), strict=True):
                spots[o].append(p)
                held[o].update(range(t, t + MIN_MATCH))
        out = []
        listed = ids.tolist()
        for o, places in spots.items():
            item_id, item = self.items[o]
            # seeds bound what tiles can cover, so most pairs end here
            if len(held[o]) < coverage * len(item):
                continue
            # only the words that seeds cover can be in a match; a gap of any length becomes one word that matches nothing
            short, end = [], -1
            for p in sorted(set(places)):
                if p > end and short:
                    short.append(-1)
                short += listed[max(p, end) : p + MIN_MATCH]
                end = p + MIN_MATCH
            tiles = tile(short, item)
            n = sum(k for _, _, k in tiles)
            if n >= coverage * len(item):
                out.append((item_id, n / len(item), len(tiles), n))
        return sorted(out)


def item_blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


LEAK = "item_id long, coverage double, n_tiles int, n_words int"


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, n_words: a row for each document and each item that it leaks."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(LEAK).fields])
    arrow = to_arrow_schema(schema)

    def matcher(rows: list[tuple[int, str]]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(rows)
            for batch in batches:
                found = [(i, *m) for i, t in zip(batch.column(0), batch.column(1), strict=True) for m in items.match(t.as_py(), coverage)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[0].as_py() for f in found], arrow.field(0).type), *(pa.array([f[k] for f in found], arrow.field(k).type) for k in range(1, 5))], schema=arrow)

        return run

    out = None
    for rows in item_blocks(benchmark):
        part = docs.select("doc_id", "text").mapInArrow(matcher(rows), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that leak an item.

    Null and empty texts stay, repeated rows stay or go together, other columns of any name pass unchanged; without items
    everything stays; an empty table gives an empty table.
    """
    from glyphreel.llm.common import keep_rows

    for rows in item_blocks(table(spark, sf_dir, "benchmark")):

        def make(rows=rows):
            items = Items(rows)
            return lambda text: not items.match(text, COVERAGE)

        docs = keep_rows(docs, "text", make)
    return docs

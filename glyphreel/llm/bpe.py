"""Byte-level BPE by rank files: encoding with a segment tree over byte positions, and decoding.

A text is cut by the pattern; each match is merged on its own. The tree's leaf i holds the rank of the pair that
begins at byte i together with i, so the root is the leftmost pair of minimum rank. A merge changes three leaves (the
pair itself, the pair before it and the one swallowed) in logarithmic time, so a match of a million bytes is no
special case. Merged matches are remembered in a table of bounded size in each worker.

Cases: null is read as the empty text, which has no tokens; its digests are those of no bytes. Texts of any length
are encoded whole. Lone surrogates become U+FFFD, as in the library this follows. Pairs of equal rank are merged from the left. Repeated rows
give equal rows; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame, SparkSession

from glyphreel.llm.common import map_text, replace_text, table

FILE = "byte_bpe_multi_50k.tiktoken"
#: Matches remembered by a worker at most.
REMEMBERED = 600_000
NONE = 1 << 62
#: Pieces of at most so many bytes are merged by a list of ranks; its search is quadratic but shorter than the tree's there.
SHORT = 128


@lru_cache(maxsize=4)
def load_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """As merge: the leftmost pair of minimum rank first."""
    get = ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) != NONE:
        i = pairs.index(least)
        joined = parts[i] = parts[i] + parts[i + 1]
        del parts[i + 1], pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + joined, NONE)
        if i < len(pairs):
            pairs[i] = get(joined + parts[i + 1], NONE)
    return tuple(map(ranks.__getitem__, parts))


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one match."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    if n <= SHORT:
        return merge_short(piece, ranks)
    size, bits = 1, max(1, n.bit_length())
    while size < n:
        size *= 2
    low = (1 << bits) - 1
    tree = [NONE] * (2 * size)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << bits | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    while (root := tree[1]) != NONE:
        i = root & low
        j = after[i]
        k = after[j]
        after[i] = k
        tree[size + j] = NONE
        if k < n:
            before[k] = i
            r = get(piece[i : after[k]])
            tree[size + i] = NONE if r is None else r << bits | i
        else:
            tree[size + i] = NONE
        h = before[i]
        if h >= 0:
            r = get(piece[h:k])
            tree[size + h] = NONE if r is None else r << bits | h
            first = size + h
        else:
            first = size + i
        # the changed leaves lie within two tokens, so few nodes of a level stand above them
        last = size + j
        while first > 1:
            first >>= 1
            last >>= 1
            for node in range(first, last + 1):
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return tuple(ids)


class Known(dict[str, tuple[int, ...]]):
    """Matches with their ids, merged when they are first asked for; emptied where they would be too many."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, p: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = merge(p.encode("utf-8", "replace") if p.isascii() else p.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode(), self.ranks)
        if len(p) <= 64:
            self[p] = ids
        return ids


class Codec:
    """encode(text) -> ids; decode(ids) -> bytes."""

    def __init__(self, file: str, pattern: str):
        import regex

        self.ranks = load_ranks(file)
        self.cut = regex.compile(pattern)
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        self.known = Known(self.ranks)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.known.__getitem__, self.cut.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(file: str | None = None, pattern: str | None = None) -> Codec:
    """file: a rank file that every executor can open; by default the installed public one. Kept by a worker from task to task."""
    import public_tokenizers

    return Codec(file or public_tokenizers.path(FILE), pattern or public_tokenizers.PATTERN)


def encode_documents(docs: DataFrame, keys: list[str], file: str | None = None) -> DataFrame:
    """keys and ids (array of int) of every text."""

    def make():
        c = codec(file)
        return lambda text: (c.encode(text),)

    return map_text(docs, keys, "text", make, "ids array<int>")


def decode_ids(rows: DataFrame, keys: list[str], file: str | None = None) -> DataFrame:
    """keys and text of every row of ids; bytes that aren't UTF-8 become U+FFFD. Null ids give an empty text."""

    def make():
        c = codec(file)
        return lambda ids: (c.decode(ids or []).decode("utf-8", "replace"),)

    return map_text(rows, keys, "ids", make, "text string")


def digests(docs: DataFrame, file: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to."""

    def make() -> Callable:
        c = codec(file)
        number = [str(i) for i in range(len(c.bytes_of))]

        def one(text):
            ids = c.encode(text)
            return len(ids), hashlib.sha256(",".join(map(number.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

        return one

    return map_text(docs, ["doc_id"], "text", make, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str, file: str | None = None) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), file)


def round_trip(c: Codec) -> Callable[[str | None], list[int]]:
    """encode, with the ids decoded again: fails where they do not give the text back."""

    def one(text: str | None) -> list[int]:
        ids = c.encode(text)
        if c.decode(ids) != (text or "").encode():
            raise ValueError("token ids do not decode to their text")
        return ids

    return one


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids to the columns of the documents; text is what they decode to, which is tested for every row.

    A null text stays null and has no ids. A column that is already named token_ids, in any case, is replaced; others
    pass unchanged. Repeated rows stay; an empty table gives an empty table.
    """
    from pyspark.sql import types as T

    return replace_text(docs, "text", lambda: round_trip(codec()), T.ArrayType(T.IntegerType()), "token_ids")

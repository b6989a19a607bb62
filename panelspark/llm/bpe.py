"""Byte-level BPE: encoding with offsets, and decoding.

Pre-tokenisation uses no regular expression.  Every code point is mapped to a symbol by its class
and its neighbours; an automaton over these symbols says where a piece begins.  The automaton runs
as an associative scan: blocks of the text are reduced to transition functions (a state for each
possible entry state), the functions are composed block by block, and a second pass replays every
block from its then known entry state.  The resulting slices go through a bounded cache of merged
pieces.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import chunks, hash_spans, same_spans, utf8

# Code points of Unicode's White_Space property.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]

# Code points that became letters and numbers in Unicode 16.0.  The pattern's library
# follows that version, while Python 3.13 knows Unicode 15.1.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

LETTER, NUMBER, OTHER, SPACE, END = range(5)
#: Symbols: a letter, number or other character; an apostrophe before a one- or two-letter
#: contraction; white space that is followed by white space or the end; a blank before a
#: character; other white space before a character.
A, D, O, ONE, TWO, RUN, BLANK, LONE = range(8)
SYMBOLS = 8
#: States: in letters, numbers, others, white space; after a leading blank; one or two letters of
#: a contraction to come; the next character begins a piece anyhow.
IN_A, IN_D, IN_O, IN_S, LED, LAST, LAST2, FREE = range(8)
#: No token results from a pair.
NONE = 1 << 30


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece begins, for every symbol and state.

    The upper half of the symbols are those of a text's first character: they forget the state.
    """
    to, begins = np.zeros((2 * SYMBOLS, 8), np.uint8), np.ones((2 * SYMBOLS, 8), bool)
    for symbol, own in ((A, IN_A), (D, IN_D), (O, IN_O)):
        to[symbol] = own
        begins[symbol, [own, LED]] = False
    to[A, [LAST, LAST2]] = FREE, LAST
    begins[A, [LAST, LAST2]] = False
    for symbol, own in ((ONE, LAST), (TWO, LAST2)):
        to[symbol] = own
        to[symbol, [IN_O, LED]] = IN_O
        begins[symbol, [IN_O, LED]] = False
    to[RUN], to[BLANK], to[LONE] = IN_S, LED, FREE
    begins[RUN, IN_S] = False
    to[SYMBOLS:] = to[:SYMBOLS, FREE, None]
    return to, begins


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point, as of Unicode 16.0; a worker's Python must know 15.1 at least."""
    if tuple(map(int, unicodedata.unidata_version.split("."))) < (15, 1):
        raise RuntimeError(f"Unicode {unicodedata.unidata_version} is too old: code point classes need 15.1")
    out = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LN":
            out[code] = LETTER if kind == "L" else NUMBER
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for low, high in ranges:
            out[low : high + 1] = kind
    out[WHITE_SPACE] = SPACE
    return out


def piece_starts(points: np.ndarray, firsts: np.ndarray, block: int = 128) -> np.ndarray:
    """Where pieces begin; ``firsts`` are the positions of the texts' first characters."""
    n = len(points)
    kind = classes()[points]
    following = np.append(kind[1:], END)
    following[firsts[firsts > 0] - 1] = END
    symbol = np.array([A, D, O, RUN], np.uint8)[kind]
    last = (kind == SPACE) & (following != SPACE) & (following != END)
    symbol[last] = LONE
    symbol[last & (points == 32)] = BLANK
    quote = np.flatnonzero((points == 39) & (following == LETTER))
    if len(quote):
        one = points[quote + 1]
        two = np.where(following[quote + 1] == LETTER, np.append(points, 0)[np.minimum(quote + 2, n)], 0)
        symbol[quote[np.isin(one, [ord(x) for x in "stmd"])]] = ONE
        pair = np.zeros(len(quote), bool)
        for x in ("re", "ve", "ll"):
            pair |= (one == ord(x[0])) & (two == ord(x[1]))
        symbol[quote[pair]] = TWO
    symbol[firsts] += SYMBOLS
    to, begins = _automaton()
    rows = -(-n // block)
    table = np.full(rows * block, SYMBOLS + LONE, np.uint8)
    table[:n] = symbol
    offsets = np.ascontiguousarray(table.reshape(rows, block).T) * np.uint8(8)
    flat = to.ravel()
    ahead = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8)).copy()
    for step in offsets:  # each block becomes a function from entry state to exit state
        ahead = flat[step[:, None] + ahead]
    state, entry = FREE, np.empty(rows, np.uint8)
    for k, function in enumerate(ahead.tolist()):  # composition along the blocks
        entry[k] = state
        state = function[state]
    starts = np.empty((block, rows), bool)
    flags = begins.ravel()
    for k, step in enumerate(offsets):
        at = step + entry
        starts[k] = flags[at]
        entry = flat[at]
    return starts.T.ravel()[:n]


class Slots:
    """A bounded open-addressing table from 64-bit keys to places, all operations vectorised."""

    def __init__(self, bits: int):
        self.bits, self.mask = bits, (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.places = np.full(1 << bits, -1, np.int32)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 for unknown ones."""
        at = self._first(keys)
        out = np.where(self.keys[at] == keys, self.places[at], -1)
        waiting = np.flatnonzero((out < 0) & (self.places[at] >= 0))
        at = at[waiting]
        while len(waiting):
            at = (at + 1) & self.mask
            place = self.places[at]
            hit = self.keys[at] == keys[waiting]
            out[waiting[hit]] = place[hit]
            on = ~hit & (place >= 0)
            waiting, at = waiting[on], at[on]
        return out

    def add(self, keys: np.ndarray, places: np.ndarray) -> None:
        """Insert distinct keys that the table doesn't hold."""
        waiting, at = np.arange(len(keys)), self._first(keys)
        while len(waiting):
            free = self.places[at] < 0
            self.places[at[free]] = places[waiting[free]]
            won = free & (self.places[at] == places[waiting])
            self.keys[at[won]] = keys[waiting[won]]
            waiting, at = waiting[~won], (at[~won] + 1) & self.mask


class Merger:
    """Merges of one rank table, with a bounded cache of pieces.

    The cache is found by a 64-bit hash of the piece and keeps the piece's bytes: every hit is compared
    with them, and a batch in which two pieces share a hash is merged without the cache.  It starts
    anew when it is full.
    """

    def __init__(self, ranks: dict[bytes, int], cached: int = 400_000):
        self.ranks, self.cached = ranks, cached
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.array([ranks.get(bytes([k]), -1) for k in range(256)], np.int32)
        pairs = np.fromiter(chain.from_iterable((ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks), np.int64).reshape(-1, 2)
        self.pairs = Slots(max(4, int(3 * len(pairs)).bit_length()))
        self.pair_rank = pairs[:, 1].astype(np.int32)
        self.pairs.add(pairs[:, 0].astype(np.uint64), np.arange(len(pairs), dtype=np.int32))
        self._forget()

    def _forget(self) -> None:
        self.slots = Slots(max(10, int(2 * self.cached).bit_length()))
        self.known, self.used = 0, 0
        self.at, self.count = np.zeros(self.cached, np.int32), np.zeros(self.cached, np.int16)
        self.pool = np.zeros(4 * self.cached, np.int32)
        self.held, self.held_bytes = np.zeros(8 * self.cached + 8, np.uint8), 0
        self.held_at, self.held_size = np.zeros(self.cached, np.int64), np.zeros(self.cached, np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two adjacent tokens make, else NONE."""
        out = np.full(left.shape, NONE, np.int32)
        real = right >= 0
        place = self.pairs.find(left[real].astype(np.uint64) << np.uint64(32) | right[real].astype(np.uint64))
        out[real] = np.where(place >= 0, self.pair_rank[np.maximum(place, 0)], NONE)
        return out

    def merge_many(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Merge short pieces side by side: in each round every piece makes its best merge."""
        none = np.zeros(0, np.int32)
        out: list[np.ndarray] = [none] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for low, width in ((0, 8), (8, 16), (16, 64)):
            rows = np.flatnonzero((size > low) & (size <= width))
            if not len(rows):
                continue
            raw = np.frombuffer(b"".join([pieces[k].ljust(width, b"\0") for k in rows.tolist()]), np.uint8).reshape(-1, width)
            ids = np.where(np.arange(width) < size[rows, None], self.single[raw], -1)
            ids = np.concatenate([ids, np.full((len(rows), 1), -1, np.int32)], 1)
            active, columns, own = np.arange(len(rows)), np.arange(width), ids.copy()
            while len(active):
                ranks = self.pair_ranks(own[:, :-1], own[:, 1:])
                at = ranks.argmin(1)
                best = ranks[np.arange(len(at)), at]
                merged = best < NONE
                if not merged.all():
                    ids[active[~merged]] = own[~merged]
                    own, at, best, active = own[merged], at[merged], best[merged], active[merged]
                own[:, :-1] = np.take_along_axis(own, columns + (columns > at[:, None]), 1)
                own[np.arange(len(at)), at] = best
            count = (ids >= 0).sum(1).tolist()
            for k, row, n in zip(rows.tolist(), ids, count, strict=True):
                out[k] = row[:n]
        for k in np.flatnonzero(size > 64).tolist():
            out[k] = np.array(self._merge_long(pieces[k]), np.int32)
        return out

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges with a heap over a linked list: n log n for long pieces."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(ranks[piece[k : k + 2]], k, k + 2) for k in range(n - 1) if piece[k : k + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, k, stop = heapq.heappop(heap)
            if not alive[k] or after[k] >= n or end[after[k]] != stop:
                continue
            gone = after[k]
            alive[gone], end[k], after[k] = False, stop, after[gone]
            if after[k] < n:
                before[after[k]] = k
                if (pair := piece[k : end[after[k]]]) in ranks:
                    heapq.heappush(heap, (ranks[pair], k, end[after[k]]))
            if (left := before[k]) >= 0 and (pair := piece[left:stop]) in ranks:
                heapq.heappush(heap, (ranks[pair], left, stop))
        return tuple(ranks[piece[k : end[k]]] for k in range(n) if alive[k])

    def pieces(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, end to end, and their number in each piece."""
        keys = hash_spans(raw, begins, ends)
        place = self.slots.find(keys)
        lost = np.flatnonzero(place < 0)
        if len(lost):
            fresh, first = np.unique(keys[lost], return_index=True)
            if self.known + len(fresh) > self.cached:
                self._forget()
                lost = np.arange(len(keys))
                fresh, first = np.unique(keys, return_index=True)
            text, where = raw.tobytes(), lost[first]
            words = [text[a:b] for a, b in zip(begins[where].tolist(), ends[where].tolist(), strict=True)]
            ids = self.merge_many(words)
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            if len(fresh) > self.cached or count.max() > 32767:  # a batch of more pieces than the cache holds, or a very long one
                return self._without_cache(raw, begins, ends)
            total = int(count.sum())
            if self.used + total > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(self.used + total, np.int32)])
            places = np.arange(self.known, self.known + len(fresh), dtype=np.int32)
            self.pool[self.used : self.used + total] = np.concatenate(ids)
            self.at[places] = self.used + np.cumsum(count) - count
            self.count[places] = count
            self.slots.add(fresh, places)
            self._hold(places, b"".join(words), np.fromiter(map(len, words), np.int64, len(words)))
            self.known, self.used = self.known + len(fresh), self.used + total
            place[lost] = places[np.searchsorted(fresh, keys[lost])]
        if not same_spans(raw, begins, ends - begins, self.held, self.held_at[place], self.held_size[place]):
            return self._without_cache(raw, begins, ends)
        count = self.count[place].astype(np.int64)
        return self.pool[spread(self.at[place], count)], count

    def _hold(self, places: np.ndarray, words: bytes, size: np.ndarray) -> None:
        """Keep the bytes of new pieces."""
        end = self.held_bytes + len(words)
        if end + 8 > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(end + 8, np.uint8)])
        self.held[self.held_bytes : end] = np.frombuffer(words, np.uint8)
        self.held_at[places], self.held_size[places] = self.held_bytes + np.cumsum(size) - size, size
        self.held_bytes = end

    def _without_cache(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = raw.tobytes()
        ids = self.merge_many([text[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)])
        return np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[spread(self.starts[ids], self.sizes[ids])]


def spread(begins: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All positions of the ranges that start at ``begins``."""
    ends = np.cumsum(count)
    return np.repeat(begins - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line has a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(2)
def _merger(name: str) -> Merger:
    return Merger(read_ranks(SparkFiles.get(name)))


@dataclass
class Encoded:
    """Ids of texts end to end, the byte offset of each in its text, and len + 1 cuts between texts."""

    ids: np.ndarray
    offsets: np.ndarray
    cuts: np.ndarray


def encode_texts(merger: Merger, column: pa.Array) -> Encoded:
    raw, at = utf8(column)
    if not len(raw):
        return Encoded(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(len(at), np.int64))
    if raw.max() < 128:
        points, char_at = raw, at
        byte_at = None
    else:
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        byte_at = np.flatnonzero((raw & 0xC0) != 0x80)
        char_at = np.searchsorted(byte_at, at)
    starts = np.flatnonzero(piece_starts(points, np.unique(char_at[:-1][np.diff(at) > 0])))
    begins = starts if byte_at is None else byte_at[starts]
    ids, count = merger.pieces(raw, begins, np.append(begins[1:], len(raw)))
    before = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=before[1:])
    cuts = before[np.searchsorted(begins, at)]
    size = merger.sizes[ids]
    offsets = np.cumsum(size) - size - np.repeat(at[:-1], np.diff(cuts))
    return Encoded(ids, offsets, cuts)


def _lists(cuts: np.ndarray, flat: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


def _binaries(merger: Merger, cuts: np.ndarray, ids: np.ndarray) -> pa.Array:
    ends = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(merger.sizes[ids], out=ends[1:])
    offsets = pa.py_buffer(ends[cuts].astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets, pa.py_buffer(merger.decoded(ids))])


def _ship(df: DataFrame, path: str) -> str:
    """Give the rank file to every executor; the name under which tasks find it."""
    df.sparkSession.sparkContext.addFile(path)
    return path.replace("\\", "/").rsplit("/", 1)[-1]


def encode(df: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``(id, ids array<int>, offsets array<long>)`` for each row of ``df``.

    ``ranks`` is the path of a rank file on the driver.  Offsets are byte positions in the UTF-8
    text.  Null and empty text give empty arrays; rows with a null or repeated id are encoded like
    any other; other columns of ``df`` are ignored.  ``decoded`` adds a binary column of that name
    with the bytes that the ids decode to, in the same pass.
    """
    name = _ship(df, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(name)
        for batch in chunks(batches, "text", 1 << 20):
            out = encode_texts(merger, batch.column("text"))
            columns = {"id": batch.column("id"), "ids": _lists(out.cuts, out.ids, pa.int32()), "offsets": _lists(out.cuts, out.offsets, pa.int64())}
            if decoded:
                columns["decoded"] = _binaries(merger, out.cuts, out.ids)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    fields = [T.StructField("id", df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("offsets", T.ArrayType(T.LongType()))]
    schema = T.StructType(fields + [T.StructField("decoded", T.BinaryType())] * decoded)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(df: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, decoded binary)``: the bytes that each row's ids stand for.

    Null or empty ids give empty bytes; an id outside the vocabulary is an error.
    """
    name = _ship(df, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(name)
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                rows = batch.column("ids").to_pylist()
                cuts = np.zeros(len(rows) + 1, np.int64)
                np.cumsum([len(x or ()) for x in rows], out=cuts[1:])
                ids = np.fromiter(chain.from_iterable(x or () for x in rows), np.int64, int(cuts[-1]))
                yield pa.RecordBatch.from_arrays([batch.column("id"), _binaries(merger, cuts, ids)], ["id", "decoded"])

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("decoded", T.BinaryType())])
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, schema).withColumnRenamed("id", id_col)

"""SentencePiece models of the merge type: exact encoding by backtracking, and decoding.

Merging always takes the best-scored pair of neighbours, the leftmost among equals.  Its result is
the only sequence of tokens in which every two neighbours, merged again on their own, stay as they
are.  So a text is read from the left: the longest token that an Aho-Corasick automaton finds at a
place is taken if it is compatible with the token before, else its next shorter prefix; where no
token is left, the place is marked in a bitfield as failed and the last token gives way.  As the
tokens before a place are unique, a failed place never has to be tried again.

No piece of the vocabulary holds two given neighbouring characters: there a text can be cut before
it is encoded.  The slices go through the bounded cache that byte-level BPE uses too.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Merger, _lists, _ship, spread
from .text import chunks

# Fixed values of the model format: the mark of a blank, the kinds of pieces, the type of a merge model.
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2


@dataclass
class Model:
    """Pieces with scores and kinds, and the rules for blanks."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    prefix: bool
    unknown: str
    begin: int
    end: int


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def read_model(path: str) -> Model:
    """The model in the file at ``path``.

    Other models than merges with byte fallback, and normalisation other than a blank in front, are errors.
    """
    with open(path, "rb") as f:
        raw = f.read()
    pieces, scores, kinds, trainer, rules = [], [], [], {}, {}
    for field, value in _fields(raw):
        if field == 1:
            own = dict(_fields(value))
            pieces.append(own[1].decode())
            scores.append(struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0])
            kinds.append(own.get(3, NORMAL))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            rules = dict(_fields(value))
    if trainer.get(3, 1) != MERGES or trainer.get(24, 0) or not trainer.get(35, 0) or kinds.count(BYTE) != 256:
        raise ValueError(f"{path} isn't a merge model with byte fallback and blanks in front of words")
    if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
        raise ValueError(f"{path} normalises texts, which isn't supported")
    if USER in kinds or UNUSED in kinds:
        raise ValueError(f"{path} has user-defined or unused pieces, which aren't supported")
    names = [trainer.get(46, b"<s>").decode(), trainer.get(47, b"</s>").decode()]
    return Model(pieces, scores, kinds, bool(rules.get(3, 1)), trainer.get(44, " ⁇ ".encode()).decode(), *[pieces.index(x) for x in names])


class Encoder(Merger):
    """Tokens of one model; ``merge_many`` is the only thing that byte-level merging does otherwise."""

    def __init__(self, model: Model, cached: int = 1_000_000, pairs: int = 1_000_000):
        self.model, self.cached, self.most_pairs = model, cached, pairs
        own = {p: k for k, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)) if kind == NORMAL}
        self.score = {p: model.scores[k] for p, k in own.items()}
        # Only pieces that merging makes of themselves are tokens; a character of a piece that is
        # none itself is one here, and becomes bytes in the end.
        single = sorted({c for p in own for c in p} - own.keys())
        self.tokens = {p: k for p, k in own.items() if self._merged(p) == [p]} | {c: len(model.pieces) + k for k, c in enumerate(single)}
        self.names = [*model.pieces, *single]
        self.length = [len(p) for p in self.names]
        self.shorter = [-1] * len(self.names)
        self.automaton = ahocorasick.Automaton()
        for piece, k in self.tokens.items():
            self.automaton.add_word(piece, k)
            self.shorter[k] = next((self.tokens[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.tokens), -1)
        if self.tokens:
            self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.byte_ids = np.zeros(256, np.int32)
        surface = []
        for k, (piece, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)):
            byte = bytes([int(piece[3:5], 16)]) if kind == BYTE else b""
            if kind == BYTE:
                self.byte_ids[byte[0]] = k
            surface.append(byte if kind == BYTE else b"" if kind == CONTROL else model.unknown.encode() if kind == UNKNOWN else piece.replace(BLANK, " ").encode())
        self.kinds = np.array(model.kinds, np.int8)
        self.blank_first = np.array([kind == NORMAL and p.startswith(BLANK) for p, kind in zip(model.pieces, model.kinds, strict=True)])
        self.sizes = np.fromiter(map(len, surface), np.int64, len(surface))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(surface), np.uint8)
        self._neighbours(own)
        self._forget()

    def _neighbours(self, own: dict[str, int]) -> None:
        """Which two characters stand side by side in some piece, as bits over numbers of characters."""
        known = sorted({c for p in own for c in p})
        self.separator = next(chr(c) for c in range(0xE000, 0xF900) if chr(c) not in known)
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        self.width = len(known) + 1
        place = {c: k for k, c in enumerate(known, 1)}
        at = np.array(sorted({place[a] * self.width + place[b] for p in own for a, b in zip(p, p[1:], strict=False)}), np.int64)
        self.beside = np.zeros(self.width * self.width // 8 + 1, np.uint8)
        np.bitwise_or.at(self.beside, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))

    def joined(self, points: np.ndarray) -> np.ndarray:
        """Whether a token can reach from each character into the next one."""
        kind = self.number[points].astype(np.int64)
        at = kind[:-1] * self.width + kind[1:]
        return (self.beside[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def _merged(self, text: str) -> list[str]:
        """Merging by the definition, for short texts."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                value = score.get(parts[k] + parts[k + 1])
                if value is not None and (best is None or value > best):
                    best, at = value, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging the texts of both tokens gives them back; kept for the next time."""
        if len(self.compatible) >= self.most_pairs:
            self.compatible.clear()
        a, b = self.names[left], self.names[right]
        found = self.compatible[left << 32 | right] = self._merged(a + b) == [a, b]
        return found

    def _slice(self, longest: list[int], low: int, high: int) -> list[int]:
        """Tokens of the characters from ``low`` to ``high``."""
        length, shorter, known, fits = self.length, self.shorter, self.compatible.get, self._fits
        token = longest[low]
        if low + length[token] == high:
            return [token]
        failed = bytearray((high - low >> 3) + 1)
        out: list[int] = []
        at = low
        while True:
            while token >= 0:
                to = at + length[token]
                bit = to - low
                if not failed[bit >> 3] >> (bit & 7) & 1:
                    if not out:
                        break
                    fit = known(out[-1] << 32 | token)
                    if fit if fit is not None else fits(out[-1], token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if to == high:
                    return out
                at, token = to, longest[to]
            else:
                bit = at - low
                failed[bit >> 3] |= 1 << (bit & 7)
                last = out.pop()
                at -= length[last]
                token = shorter[last]

    def merge_many(self, pieces: list[bytes]) -> list[np.ndarray]:
        words = [p.decode() for p in pieces]
        text = self.separator.join(words)
        longest, length = [-1] * len(text), self.length
        if self.tokens:
            for end, token in self.automaton.iter(text):
                longest[end - length[token] + 1] = token  # ends come in order: the last is the longest
        out, low, plain = [], 0, len(self.model.pieces)
        for word, raw in zip(words, pieces, strict=True):
            high = low + len(word)
            if longest[low] < 0:  # a character of no piece stands alone
                ids = self.byte_ids[np.frombuffer(raw, np.uint8)]
            else:
                found = self._slice(longest, low, high)
                if max(found) >= plain:
                    found = list(chain.from_iterable([t] if t < plain else self.byte_ids[list(self.names[t].encode())].tolist() for t in found))
                ids = np.array(found, np.int32)
            out.append(ids)
            low = high + 1
        return out


@lru_cache(2)
def _encoder(name: str) -> Encoder:
    return Encoder(read_model(SparkFiles.get(name)))


def encode_texts(encoder: Encoder, texts: list[str | None], begin: bool = True, end: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts end to end, and len + 1 cuts between them."""
    front = BLANK if encoder.model.prefix else ""
    marked = [front + x.replace(" ", BLANK) if x else "" for x in texts]
    whole = "".join(marked)
    raw = np.frombuffer(whole.encode(), np.uint8)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    first = np.cumsum(size) - size
    ids, chunk_cuts = np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    if len(raw):
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        starts = np.ones(len(points), bool)
        starts[1:] = ~encoder.joined(points)
        starts[first[size > 0]] = True
        chars = np.flatnonzero(starts)
        begins = np.flatnonzero((raw & 0xC0) != 0x80)[chars]
        ids, count = encoder.pieces(raw, begins, np.append(begins[1:], len(raw)))
        before = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=before[1:])
        chunk_cuts = before[np.searchsorted(chars, np.append(first, len(points)))]
    cuts = chunk_cuts + (begin + end) * np.arange(len(texts) + 1)
    own = np.ones(cuts[-1], bool)
    out = np.empty(cuts[-1], np.int32)
    if begin:
        own[cuts[:-1]], out[cuts[:-1]] = False, encoder.model.begin
    if end:
        own[cuts[1:] - 1], out[cuts[1:] - 1] = False, encoder.model.end
    out[own] = ids
    return out, cuts


def _repaired(encoder: Encoder, ids: np.ndarray, drop: int) -> bytes:
    """Text of ids whose byte tokens don't all make characters: each byte that doesn't begin one
    becomes U+FFFD; ``drop`` is the place of the token whose leading blank goes, or -1."""
    out, run = [], b""

    def flush() -> None:
        at = 0
        while at < len(run):
            for n in range(1, 5):
                try:
                    out.append(run[at : at + n].decode().encode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                n = 1
                out.append("�".encode())
            at += n

    for k, token in enumerate(ids.tolist()):
        surface = encoder.bytes[encoder.starts[token] : encoder.starts[token] + encoder.sizes[token]].tobytes()
        if encoder.kinds[token] == BYTE:
            run += surface
            continue
        flush()
        run = b""
        out.append(surface[1:] if k == drop else surface)
    flush()
    return b"".join(out)


def decode_ids(encoder: Encoder, ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Texts of the ids: control tokens are silent, and the blank in front is taken away."""
    sizes, starts = encoder.sizes[ids], encoder.starts[ids].copy()
    kinds = encoder.kinds[ids]
    heard = np.flatnonzero(kinds != CONTROL)
    drop = np.full(len(cuts) - 1, -1)
    if len(heard) and encoder.model.prefix:
        place = np.searchsorted(heard, cuts[:-1])
        first = heard[np.minimum(place, len(heard) - 1)]
        ok = (place < len(heard)) & (first >= cuts[:-1]) & (first < cuts[1:])
        ok[ok] = encoder.blank_first[ids[first[ok]]]
        drop[ok] = first[ok]
        starts[first[ok]] += 1
        sizes[first[ok]] -= 1
    raw = encoder.bytes[spread(starts, sizes)]
    ends = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    at = ends[cuts]
    try:
        raw.tobytes().decode()
        inner = np.concatenate([at, ends[:-1][kinds == CONTROL]])  # no character goes on behind these
        inner = inner[inner < len(raw)]
        whole = not len(inner) or bool(((raw[inner] & 0xC0) != 0x80).all())
    except UnicodeDecodeError:
        whole = False
    if whole:
        return pa.Array.from_buffers(pa.string(), len(cuts) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw.tobytes())])
    return pa.array([_repaired(encoder, ids[a:b], d - a if d >= 0 else -1).decode() for a, b, d in zip(cuts[:-1].tolist(), cuts[1:].tolist(), drop.tolist(), strict=True)], pa.string())


def _packed(ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((4 * cuts).astype(np.int32)), pa.py_buffer(ids.astype("<u4").tobytes())])


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", begin: bool = True, end: bool = True, packed: bool = False, decoded: bool = False) -> DataFrame:
    """``(id, ids array<int>)`` for each row of ``df``, as the model's library encodes whole texts.

    ``model`` is the path of a model file on the driver.  Null and empty texts give the begin and
    end ids alone, or none.  Rows with a null or repeated id are encoded like any other; other
    columns of ``df`` are ignored; an empty table stays empty.  ``packed`` adds a column of that
    name with the ids as little-endian unsigned 32-bit integers, ``decoded`` one with the text that
    the ids decode to, in the same pass.
    """
    name = _ship(df, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name)
        for batch in chunks(batches, "text", 1 << 20):
            ids, cuts = encode_texts(encoder, batch.column("text").to_pylist(), begin, end)
            columns = {"id": batch.column("id"), "ids": _lists(cuts, ids, pa.int32())}
            if packed:
                columns["packed"] = _packed(ids, cuts)
            if decoded:
                columns["decoded"] = decode_ids(encoder, ids, cuts)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    fields = [T.StructField("id", df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType(fields + [T.StructField("packed", T.BinaryType())] * packed + [T.StructField("decoded", T.StringType())] * decoded)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, decoded string)``: the text that each row's ids stand for, as the model's library decodes.

    Null or empty ids give an empty text; an id outside the vocabulary is an error.  Bytes that make
    no character become U+FFFD.
    """
    name = _ship(df, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = batch.column("ids").to_pylist()
                cuts = np.zeros(len(rows) + 1, np.int64)
                np.cumsum([len(x or ()) for x in rows], out=cuts[1:])
                ids = np.fromiter(chain.from_iterable(x or () for x in rows), np.int64, int(cuts[-1]))
                if len(ids) and (ids.min() < 0 or ids.max() >= len(encoder.sizes)):
                    raise ValueError("an id is outside the vocabulary")
                yield pa.RecordBatch.from_arrays([batch.column("id"), decode_ids(encoder, ids, cuts)], ["id", "decoded"])

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("decoded", T.StringType())])
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, schema).withColumnRenamed("id", id_col)

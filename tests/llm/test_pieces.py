from __future__ import annotations

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from panelspark.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  ", "a", "▁x", " ▁ x", "\0a\0", "\n\n", "<s></s>", "<0x0A>", " " * 100, "é" * 50, "x" * 3000, "中文字" * 300, "😀a😀", "= " * 200, "=" * 500, "�", "b"]


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.read_model(PATH))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def _check(encoder, library, texts):
    ids, cuts = pieces.encode_texts(encoder, texts)
    wanted = library.encode([x or "" for x in texts], add_bos=True, add_eos=True)
    decoded = pieces.decode_ids(encoder, ids, cuts).to_pylist()
    for k, text in enumerate(texts):
        assert ids[cuts[k] : cuts[k + 1]].tolist() == wanted[k], repr(text)
        assert decoded[k] == library.decode(wanted[k]), repr(text)


def test_odd_texts(encoder, library):
    _check(encoder, library, ODD)
    for begin in (False, True):
        for end in (False, True):
            ids, cuts = pieces.encode_texts(encoder, ODD, begin, end)
            for k, text in enumerate(ODD):
                assert ids[cuts[k] : cuts[k + 1]].tolist() == library.encode(text or "", add_bos=begin, add_eos=end)


def test_texts_of_pieces(encoder, library):
    rng = random.Random(1)
    own = [p.replace(pieces.BLANK, " ") for p, kind in zip(encoder.model.pieces, encoder.model.kinds, strict=True) if kind == pieces.NORMAL]
    short = [p for p in own if len(p) < 4]
    for some in (own, short):
        _check(encoder, library, ["".join(rng.choice(some) for _ in range(rng.randint(0, 14))) for _ in range(4000)])


def test_any_code_point(encoder, library):
    rng = random.Random(2)
    kinds = [lambda: rng.randrange(32, 127), lambda: rng.randrange(0x3000), lambda: rng.randrange(0x110000)]
    _check(encoder, library, ["".join(chr(rng.choice(kinds)()) for _ in range(60)).encode("utf-8", "ignore").decode() for _ in range(1500)])


def test_decoding_of_any_ids(encoder, library):
    rng = random.Random(3)
    rows = [[rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3)]) for _ in range(rng.randint(0, 8))] for _ in range(6000)]
    for some in [*([r] for r in rows[:3000]), rows[3000:]]:  # one by one, and texts side by side
        cuts = np.cumsum([0, *map(len, some)])
        got = pieces.decode_ids(encoder, np.array([x for r in some for x in r], np.int64), cuts).to_pylist()
        assert got == [library.decode(r) for r in some]


def _model(path, normal):
    """A model file with these pieces, best first."""

    def field(number, kind, raw):
        size = bytes([len(raw)]) if kind == 2 and len(raw) < 128 else b""
        return bytes([number << 3 | kind]) + size + raw

    def piece(text, score, kind):
        body = field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind]))
        return field(1, 2, body)

    rows = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *[(f"<0x{k:02X}>", 0, 6) for k in range(256)], *[(p, -k, 1) for k, p in enumerate(normal)]]
    trainer = field(3, 0, b"\x02") + bytes([35 << 3 & 127 | 128, 35 << 3 >> 7]) + b"\x01"
    path.write_bytes(b"".join(piece(*r) for r in rows) + field(2, 2, trainer) + field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x00")))
    return str(path)


@pytest.mark.parametrize("seed", range(12))
def test_small_models_that_backtrack(tmp_path, seed):
    """Random merges over few letters: longest matches often fail, some pieces are never reached and
    some characters stand in pieces only."""
    rng = random.Random(seed)
    normal = list(dict.fromkeys("".join(rng.choice("ab▁c") for _ in range(rng.randint(1, 5))) for _ in range(40)))
    path = _model(tmp_path / "m.model", normal)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    encoder = pieces.Encoder(pieces.read_model(path), pairs=50)
    _check(encoder, library, ["".join(rng.choice("aabbc d") for _ in range(rng.randint(0, 40))) for _ in range(400)])


def test_other_models_are_errors(tmp_path):
    path = tmp_path / "plain.model"
    path.write_bytes(b"\x12\x02\x18\x01")
    with pytest.raises(ValueError, match="merge model"):
        pieces.read_model(str(path))


def test_query_rows_and_round_trip(spark, library, tmp_path):
    rows = [(1, "Hello  world's\n", "x"), (1, "Hello  world's\n", "x"), (2, None, None), (None, "", "y"), (3, "ein sehr langer Text " * 5000, "z")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(queries.op11_pieces(spark, str(tmp_path)).collect(), key=lambda r: (r["doc_id"] or 0))

    def digest(doc, text):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        return (doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())

    assert [tuple(r) for r in got] == sorted((digest(a, b) for a, b, _ in rows), key=lambda r: r[0] or 0)
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    back = pieces.decode(pieces.encode(df, PATH), PATH)
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in back.collect()) == sorted((a or 0, b or "") for a, b, _ in rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.decode(pieces.encode(df, PATH, begin=False, end=False), PATH).count() == 0

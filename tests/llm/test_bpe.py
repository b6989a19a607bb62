from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from panelspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "é", "ß", "1", "²", "!", "-", "　", "😀", "中", "'s", "'ll", "\r\n", "\x1c", "\x00", "x" * 70, "ab" * 60, "!" * 90, "́", "٣"]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _check(merger, reference, texts):
    out = bpe.encode_texts(merger, pa.array(texts, pa.string()))
    decoded = bpe._binaries(merger, out.cuts, out.ids).to_pylist()
    for k, text in enumerate(texts):
        ids = out.ids[out.cuts[k] : out.cuts[k + 1]].tolist()
        assert ids == reference.encode_ordinary(text), repr(text)
        assert decoded[k] == text.encode()
        begins = out.offsets[out.cuts[k] : out.cuts[k + 1]].tolist()
        assert begins == [len(reference.decode_bytes(ids[:i])) for i in range(min(len(ids), 40))] + begins[40:]


def test_pieces_and_merges_equal_the_regex(ranks, reference):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    _check(bpe.Merger(ranks), reference, texts + ["", "a" * 20_000, "'s's'll're", " 's"])


def test_any_code_point(ranks, reference):
    rng = random.Random(2)
    texts = ["".join(chr(c) for c in (rng.randrange(0x110000) for _ in range(200)) if not 0xD800 <= c < 0xE000) for _ in range(300)]
    _check(bpe.Merger(ranks), reference, texts)


def test_every_code_point_in_context(ranks, reference):
    """All below U+33000, then every 61st, and the special-purpose plane."""
    merger = bpe.Merger(ranks)
    codes = [c for c in (*range(0x33000), *range(0x33000, 0x110000, 61), *range(0xE0000, 0xE0200)) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b 1{chr(c)}2!{chr(c)}?" for c in codes[k : k + 64]) for k in range(0, len(codes), 64)]
    for k in range(0, len(texts), 500):
        out = bpe.encode_texts(merger, pa.array(texts[k : k + 500], pa.string()))
        for j, text in enumerate(texts[k : k + 500]):
            assert out.ids[out.cuts[j] : out.cuts[j + 1]].tolist() == reference.encode_ordinary(text), (hex(ord(text[1])), j)


def test_pieces_that_share_a_hash(ranks, reference, monkeypatch):
    weak = lambda raw, begins, ends, seed=0: (ends - begins).astype("uint64") % 5 + raw[begins] % 3
    monkeypatch.setattr(bpe, "hash_spans", weak)
    rng = random.Random(7)
    merger = bpe.Merger(ranks)
    for _ in range(4):
        _check(merger, reference, ["".join(rng.choice(PARTS) for _ in range(20)) for _ in range(20)] + ["same same", "mesa same"])


def test_a_full_cache_starts_anew(ranks, reference):
    rng = random.Random(3)
    merger = bpe.Merger(ranks, cached=50)
    for _ in range(5):
        _check(merger, reference, ["".join(rng.choice(PARTS) for _ in range(20)) for _ in range(30)])


def test_round_trip_with_nulls_repeats_and_other_columns(spark, reference):
    rows = [(1, "Hello  world's\n", "x", 5), (1, "Hello  world's\n", "x", 5), (2, None, None, 6), (None, "", "y", 7), (3, "ein sehr langer Text " * 5000, "z", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, offsets int")
    encoded = bpe.encode(df, PATH)
    assert encoded.columns == ["doc_id", "ids", "offsets"]
    got = bpe.decode(encoded, PATH).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"]).decode()) for r in got) == sorted((r[0] or 0, r[1] or "") for r in rows)
    digest = {r["doc_id"]: r["s"] for r in encoded.select("doc_id", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("s")).collect()}
    assert digest[1] == hashlib.sha256(" ".join(map(str, reference.encode_ordinary(rows[0][1]))).encode()).hexdigest()
    assert digest[2] == hashlib.sha256(b"").hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, PATH), PATH).count() == 0

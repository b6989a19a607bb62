from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from panelspark.llm import queries, variants
from panelspark.llm.storage import stored


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def _words(rows, least=7):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= 2}


def _grouped(words, ratio=10):
    out = {}
    for w, n in words.items():
        near = [x for x in words if _near(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        out[w] = [n, len(near), form, words[form] if form else None, form]
    for w, row in out.items():
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        row[4] = root
    return {w: tuple(row) for w, row in out.items()}


def _rows(df):
    return {r["word"]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("symbols", [2, 3, 8])
def test_neighbours_are_each_edit_once(symbols):
    rng = random.Random(symbols)
    words = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    whole = variants.Reduced(words, symbols)
    spelled = ["".join(map(str, whole.symbol[f : f + n])) for f, n in zip(whole.first, whole.size, strict=True)]
    got = [[] for _ in words]
    for keys, owner in whole.neighbours():
        for key, k in zip(keys.tolist(), owner.tolist(), strict=True):
            got[k].append(key)
    digit = {}
    for code in range(97, 123):  # a letter for each symbol, to hash spelled forms again
        digit.setdefault(int(variants.Reduced([chr(code)], symbols).symbol[0]), chr(code))
    for k, form in enumerate(spelled):
        alphabet = "".join(map(str, range(symbols)))
        edits = {form} | {form[:i] + form[i + 1 :] for i in range(len(form))}
        edits |= {form[:i] + x + form[i + 1 :] for i in range(len(form)) for x in alphabet} | {form[:i] + x + form[i:] for i in range(len(form) + 1) for x in alphabet}
        if len(digit) == symbols:
            wanted = variants.Reduced(["".join(digit[int(c)] for c in e) for e in sorted(edits)], symbols).own().tolist()
            assert sorted(got[k]) == sorted(wanted)
        assert len(got[k]) == len(set(got[k])) == len(edits)


def test_blocks_of_letters_give_the_same(monkeypatch):
    words = ["abcdefgh" * 5, "xyz", "aaaa" * 9]
    pairs = lambda: sorted((a, b) for keys, owner in variants.Reduced(words, 4).neighbours() for a, b in zip(keys.tolist(), owner.tolist(), strict=True))
    whole = pairs()
    monkeypatch.setattr(variants, "BLOCK", 7)
    assert pairs() == whole


def test_groups_equal_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(7, 11))) for _ in range(25)]
    words = {}
    for w in base:
        words[w] = rng.choice([2, 5, 200, 3000])
        for _ in range(12):
            at = rng.randrange(len(w))
            words.setdefault(rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abc") + w[at:], w[:at] + rng.choice("abcé") + w[at + 1 :]]), rng.choice([2, 2, 3, 20, 31]))
    long = "".join(rng.choice("ab") for _ in range(20_000))
    words |= {long: 100, long[:50] + long[51:]: 2, long[:-1] + "ç": 5, "gggggggg": 1000, "ggggggg": 10, "gggggg": 1}
    got = _rows(variants.group(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)))
    assert got == _grouped(words)
    assert got["gggggg"][2:] == ("ggggggg", 10, "gggggggg") and got[long[:50] + long[51:]][4] == long


def test_one_symbol_still_finds_all(spark):
    """If all letters share a symbol, every pair of like length is a candidate; verification decides."""
    words = {w: n for w, n in [("abcdefg", 50), ("abcdefh", 5), ("gfedcba", 500), ("abcdefgh", 7), ("zzzzzzzzz", 3)]}
    assert _rows(variants.group(spark.createDataFrame(list(words.items()), "word string, n long"), symbols=1)) == _grouped(words)


def test_query_on_edge_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, letters at the edges of the range, other columns."""
    text = "Wordlike Wordlike wordlikes WORDLIKE ÀÉÎÕÜÿ×÷ ÀÉÎÕÜÿ×÷ straßenbahn straßenbahn-Ωomegaomega Ωomegaomega abc" + " planted" * 40
    rows = [(k, text, k) for k in range(60)] + [(1, text, 1), (None, text, 2), (7, None, 3), (8, "", 4), (9, "x" * 30_000 + " " + "x" * 30_000 + "y", 5), (10, "x" * 30_000 + " " + "x" * 30_000 + "y", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, word int").write.parquet(str(tmp_path / "documents.parquet"))
    words = _words([r[:2] for r in rows])
    got = _rows(queries.op12_variants(spark, str(tmp_path)))
    assert got == _grouped(words)
    assert sum(r[2] is not None for r in got.values()) > 2


def test_empty_table_and_bad_ratio(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group(variants.occurrences(empty)).count() == 0
    with pytest.raises(ValueError, match="ratio"):
        variants.group(spark.createDataFrame([], "word string, n long"), ratio=1)


def test_ways_of_any_length_end(spark):
    links = [(str(k), str(k + 1)) for k in range(21)] + [("x", "20")]
    got = {r["from"]: r["root"] for r in variants.roots(spark.createDataFrame(links, "from string, to string")).collect()}
    assert set(got.values()) == {"21"} and len(got) == 22


def test_the_bitmap_lets_every_form_pass(spark):
    words = stored(spark.createDataFrame([(k, f"{chr(97 + k % 26)}{'abc' * (k % 5)}{k}") for k in range(500)], "id long, word string"), "test-words")
    keys = variants._keyed(words, 8)
    bitmap = variants._bitmap(keys)
    for at in variants._bits(keys.toPandas()["key"].to_numpy().view("uint64")):
        assert all(bitmap[at >> 3] >> (7 - (at & 7)).astype("uint8") & 1)

from __future__ import annotations

import random
import re

import pytest

from panelspark.llm import components, minhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k, percent):
    sets = {}
    for i, text in rows:
        words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("k", "crowd"), [(4, 200), (5, 3)])
def test_equals_brute_force(spark, monkeypatch, k, crowd):
    monkeypatch.setattr(minhash, "CROWD", crowd)
    rng = random.Random(k)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    texts = [text(rng.randint(1, 120)) for _ in range(60)]
    for size, edits in ((40, 2), (100, 5), (200, 12)):
        texts += near_copies(rng, text(size), 40, edits)
    passage = text(60)
    texts += [f"{passage} {text(rng.randint(5, 60))}" for _ in range(40)]
    chain = text(100).split()
    for step in range(25):  # each is near the one before only
        chain[step * 4] = f"c{step}"
        texts.append(" ".join(chain))
    texts += ["", None, "one", "One", "a b c", "A B  c", "a b\tc\n", "é É"] + [texts[0]] * 30 + [texts[0].upper()]
    rng.shuffle(texts)
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n int, rep string")
    got = {tuple(r) for r in minhash.near_duplicates(df, shingle=k).collect()}
    assert got == brute(rows, k, 80)


def test_a_bucket_of_boilerplate_texts_forms_few_pairs(spark, monkeypatch):
    """300 texts that share 60 % of their words, among them a few copies; all pairs would be 45,000."""
    rng = random.Random(9)
    shared = " ".join(f"s{k}" for k in range(60))
    texts = [f"{shared} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) for _ in range(300)]
    texts += [t.rsplit(" ", 3)[0] for t in texts[:5]]
    seen = []
    keep = minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda pairs, *rest: seen.append(pairs.count()) or keep(pairs, *rest))
    monkeypatch.setattr(minhash, "CROWD", 20)
    made = []
    across = minhash._across
    monkeypatch.setattr(minhash, "_across", lambda rows, key, percent: made.append((key, rows.count())) or across(rows, key, percent))
    rows = list(enumerate(texts))
    got = {tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 5, 80)
    assert sum(seen) < 100 and dict(made)["shingle"] < 5000


def test_null_and_repeated_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (7, "q r s t u v"), (7, "z r s t u v"), (8, "z r s t u v"), (None, "a b c d e f"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r[0] or 0, r[1], r[2] or 0, r[3]) for r in minhash.near_duplicates(df).collect())
    assert got == [(0, 0, 0, True), (0, 2, 0, True), (1, 2, 1, True), (2, 2, 1, False), (7, 2, 7, True), (8, 2, 7, False)]
    left = minhash.deduplicated(df).collect()
    assert sorted(r[0] or 0 for r in left) == [0, 0, 1, 7]


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (None, 3), (7000, 6000)]
    rng.shuffle(links)
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(links * 2, "a long, b long")).collect()}
    want = {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)} | {7000: 6000, 6000: 6000}
    assert got == want

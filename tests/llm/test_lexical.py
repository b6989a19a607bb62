from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelspark.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _best(docs, items, k=50):
    """``(item_id, rank, doc_id, score)`` by the definition."""
    counts = [(doc, Counter(_terms(text)), len(_terms(text))) for doc, text in docs]
    n_docs, n_terms = sum(n > 0 for _, _, n in counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c, n in counts:
            score = 0
            for t in set(_terms(text)) & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms))))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc, score))
        out += [(item, rank, x[3], x[4]) for rank, x in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_terms_of_texts():
    texts = ["Hello, World's 123", None, "", "été—naïve ÀB ab\tAB", "___", "a" * 5000, "x\x00y\x7fz中文"]
    n, terms, term, doc, tf = lexical.term_counts(pa.array(texts, pa.string()))
    assert n.tolist() == [len(_terms(x)) for x in texts]
    got = {(d, terms[t]): c for t, d, c in zip(term.tolist(), doc.tolist(), tf.tolist(), strict=True)}
    assert got == {(k, t): c for k, x in enumerate(texts) for t, c in Counter(_terms(x)).items()}


def test_terms_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(lexical, "hash_spans", lambda raw, begins, ends: (ends - begins).astype(np.uint64))
    _, terms, term, doc, tf = lexical.term_counts(pa.array(["one two two", "six"], pa.string()))
    assert {(d, terms[t]): c for t, d, c in zip(term.tolist(), doc.tolist(), tf.tolist(), strict=True)} == {(0, "one"): 1, (0, "two"): 2, (1, "six"): 1}


@pytest.mark.parametrize(("k", "block", "bundle"), [(5, 4096, 256), (5, 16, 3), (50, 40, 256)])
def test_ranks_equal_the_definition(spark, k, block, bundle):
    """Terms of all frequencies, so that every stage has some; many ties; several blocks and bundles."""
    rng = random.Random(k + block)
    words = [f"w{x}" for x in range(400)]
    pick = lambda n: " ".join(words[min(399, int(rng.expovariate(0.03)))] for _ in range(n))
    docs = [(x, pick(rng.randint(1, 60))) for x in range(300)] + [(300 + x, "w5 w5 w9") for x in range(20)]
    items = [(x, pick(rng.randint(1, 25))) for x in range(14)] + [(20, "nowhere"), (21, "w0 w0 w1"), (22, "w399 w398 w0")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").coalesce(2)
    assert _rows(lexical.search(df, asked, k=k, block=block, bundle=bundle)) == _best(docs, items, k)


def test_edge_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and long texts, repeated items, columns with clashing names."""
    docs = [(1, "alpha beta", 0), (1, "alpha beta", 0), (None, "alpha", 1), (2, None, 2), (3, "", 3), (4, "beta " * 40_000 + "Gamma", 4), (5, "ÉTÉ gamma", 5), (6, "delta", 6), (7, "delta", 6)]
    items = [(1, "ALPHA gamma", 0), (1, "ALPHA gamma", 0), (2, None, 0), (3, "", 1), (None, "beta ÉTÉ", 2), (5, "absent", 3)]
    spark.createDataFrame(docs, "doc_id long, text string, rank int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string, score int").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = queries.op13_lexical(spark, str(tmp_path))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert _rows(got) == _best([r[:2] for r in docs], [r[:2] for r in items])


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a c")], "item_id long, text string")
    for left, right in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0)), (docs.withColumn("text", docs.text.substr(1, 0)), items)):
        assert lexical.search(left, right).count() == 0
    assert lexical.search(docs, items).count() == 1

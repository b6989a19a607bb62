from __future__ import annotations

import random

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__
from panelspark.llm import bpe, mixing
from panelspark.llm.storage import stored

SF = "/root/testdata/sf0.01"


def test_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        counts.append(docs.count())
        assert docs.join(before, columns, "left_anti").count() == 0
    assert counts[0] >= counts[1] > counts[2] > counts[3]
    deduped = stored(corpus_pipeline.STAGES[2][1](spark, before, SF), "again")
    assert deduped.count() == before.count()
    sizes = mixing.mix(before).agg({"taken": "sum"}).first()[0]
    assert docs.select(mixing.word_count(docs["text"]).alias("n")).agg({"n": "sum"}).first()[0] == sizes
    ids = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in docs.limit(20).collect()}
    for r in ids.where(ids["doc_id"].isin(list(texts))).collect():
        assert r["ids"] == plain.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
    assert ids.count() == counts[-1]


def test_edge_rows(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: rng.choice(["der", "die", "und", "nicht", "ein", "Haus", "Baum", "geht", "schnell", "heute"]) + rng.choice("abcdefghij")
    text = lambda n=90: " ".join(word() for _ in range(n))
    same, long = text(), text(30_000)
    rows = [(i, text(), "de", "web", 1, "x") for i in range(60)]
    rows += [(None, text(), "de", "web", 1, "x"), (None, None, None, None, None, None), (500, None, "de", None, 1, "x"), (501, "", "de", "web", 1, "x"), (502, "12 34", "de", "web", 1, "x")]
    rows += [(503, same, "de", "web", 1, "x"), (503, same, "de", "web", 1, "x"), (504, same, "de", None, 1, "x"), (505, long, "de", "web", 1, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars int, `__row` string"
    docs = spark.createDataFrame(rows, schema)
    path = f"file://{tmp_path}"
    docs.write.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, path), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "__row"]
    ids = [r["doc_id"] for r in docs.collect()]
    assert not {500, 501, 502, 504} & set(ids) and {503, 505} <= set(ids) and ids.count(503) <= 2 and ids.count(None) <= 2
    out = stored(corpus_pipeline.STAGES[-1][1](spark, docs, path), "ids")
    assert out.count() == len(ids) and out.where("n_tokens != size(ids)").count() == 0


def test_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


@pytest.mark.parametrize("name", ["op1_warc", "op4_kdtree", "op5_minhash", "op6_mixing", "op10_sharding", "op12_variants", "op13_lexical"])
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    got = __spark_entry__.queries()[name](spark, sf)
    with duckdb.connect() as c:
        for t in ("documents", "embeddings", "pages", "benchmark"):
            c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        want = c.execute(f"select {', '.join(got.columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)

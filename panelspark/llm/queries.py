"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, crf, kdtree, langid, lexical, minhash, mixing, ordinal, outliers, pieces, sharding, variants, warc
from .storage import fresh_path, ship_package

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(parts: int, which: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == which


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = fresh_path(spark, "warc")
    warc.write(warc.with_revisits(pages, F.col("html").cast("binary"), "page_id"), path, "page_id", "url")
    responses = warc.read(spark, path).where("record_type = 'response'")
    revisits = warc.read(spark, path, payload=False).where("record_type = 'revisit'")
    return warc.resolved(responses).unionByName(warc.resolved(revisits)).withColumnRenamed("id", "page_id")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), RANKS, decoded=True)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _labelled(spark: SparkSession, sf_dir: str, labels: DataFrame, most: int) -> DataFrame:
    """Texts of the labelled training documents, about ``most`` of them: a bounded broadcast."""
    labels = labels.where(F.col("doc_id").isNotNull() & ~held_out(5, 0)).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in labels.columns if c != "doc_id"])
    share = min(1.0, most / max(1, labels.count()))
    some = labels.where(F.pmod(F.xxhash64(F.lit("label"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1))
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(some), "doc_id")


def op3_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded ratings: 0 poor, 1 good but toxic, 2 good; texts of grade 1 or more are kept."""
    labels = table(spark, sf_dir, "labels").where("quality in (0, 1)")
    labels = labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))
    model = ordinal.fit(_labelled(spark, sf_dir, labels, 5_000))
    scored = ordinal.predict(table(spark, sf_dir, "documents"), model, at_least=1)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "expected_grade", "tail_probability", F.coalesce(F.col("tail_probability") >= 0.5, F.lit(False)).alias("kept"))


def op4_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_position")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~held_out(4, 2)))
    scored = langid.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op8_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.rules(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where("toxic in (0, 1)").select("doc_id", "toxic")
    model = crf.fit(_labelled(spark, sf_dir, labels, 12_000))
    scored = crf.score(table(spark, sf_dir, "documents"), model)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents"), PIECES, packed=True, decoded=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.occurrences(table(spark, sf_dir, "documents"), min_length=7, min_count=2, drop_every=31)
    return variants.group(words, ratio=10)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc, op2_byte_bpe, op3_quality_grades, op4_kdtree, op5_minhash, op6_mixing, op7_language_id, op8_outliers, op9_toxicity, op10_sharding, op11_pieces, op12_variants, op13_lexical)}

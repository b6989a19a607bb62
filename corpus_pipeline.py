"""Corpus preparation: language ID, quality rules, near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs.  All stages but the last return the columns of documents, whatever
further ones there are and however they are named.  An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import bpe, langid, minhash, mixing, outliers
from panelspark.llm.queries import RANKS
from panelspark.llm.storage import discard, ship_package, stored

#: Texts whose language is less certain than this are rejected, as are those without a letter.
LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose text has a recognised language.

    Null, empty and letterless texts go.  Every row is judged by its own text: null and repeated ids
    and repeated rows are no matter.  If no row has both a text and a language, nothing is
    recognised and all go.
    """
    ship_package(spark)
    model = langid.fit(docs)
    tagged = langid.predict(docs, model, prefix="__lang_")
    return tagged.where((F.col("__lang_pred") != langid.UNKNOWN) & (F.col("__lang_score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass the base rules and are no outliers of their language and source.

    Null and short texts go.  Each row goes or stays by its own verdict, whatever its id; a null
    language or source is a group of its own.
    """
    return outliers.passing(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: five-word shingles, similarity 0.8.

    The one with the smallest id stays.  Rows that repeat an id stand for one document, with the
    greatest of their texts; rows with a null id are compared with nothing and all stay.
    """
    ship_package(spark)
    return minhash.deduplicated(docs, shingle=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers that the mix takes of them, none, one or two copies.

    Rows without words go.  Copies are counted by row, so that null and repeated ids get their own.
    """
    return mixing.mixed(docs, ordered=False)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their byte offsets, a row for each document that the mix delivers; null and
    empty texts, which earlier stages drop, would give empty arrays."""
    ship_package(spark)
    encoded = bpe.encode(docs, RANKS)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "offsets")


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: Language ID and robust estimates have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if name != STAGES[0][0]:
            discard(before)
    return docs

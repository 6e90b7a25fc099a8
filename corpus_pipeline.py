"""Pipeline over documents: language, near copies, secrets, mix, packing.

Every stage takes null, empty and very long texts, null keys and sources, repeated rows and
an empty table, and keeps columns of any name; what it does with them is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import language, mixing, near_duplicates, packing, secrets, shingle_sets
from flowlens.llm.common import prepare
from flowlens.session import materialize


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or in no learned language, go.

    Equal rows are judged alike. A table without a known language keeps nothing.
    """
    prepare(spark)
    return language.keep_identified(docs, language.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more.

    SimHash fingerprints and MinHash bands give the pairs, and the whole sets of shingles decide.
    Equal texts are near copies, and so are all texts without a word, null ones included. Of
    rows that tie, the one whose other columns come first as JSON stays.
    """
    prepare(spark)
    return near_duplicates.one_of_each(docs, found=shingle_sets.near_duplicates(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text give way to their kind. A null text stays null."""
    prepare(spark)
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take, once for each repeat.

    A text without a word has size 0 and goes; null sources are one source; equal rows are taken each.
    """
    prepare(spark)
    return mixing.mixed_rows(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2,048 words with the text of each piece; repeats of a document never share one.

    Longer texts are cut; null and empty texts are pieces of size 0.
    """
    prepare(spark)
    return packing.pack(docs, cluster=F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("string"))), with_text=True)


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_documents),
]

# Trained classifiers and fingerprints are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: documents through quality, rules, two kinds of de-duplication, and packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide.llm import minhash_dedup, packing, quality_classifier, quality_rules, substring_dedup
from lowtide.llm.storage import written

#: SQL cannot train the classifier or encode texts; the stages are tested one by one
ORACLE_SQL = None

#: documents of this similarity or more are near copies to the pipeline; op4 has a limit of its own
NEAR_COPY_PCT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text and site speak for quality; hosts are the sources, paths their languages."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.keep_good(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near-duplicates."""
    return minhash_dedup.keep_first(docs, pct=NEAR_COPY_PCT)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document, or an earlier part, has."""
    return substring_dedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("quality_rules", rules),
    ("minhash_dedup", near_duplicates),
    ("substring_dedup", passages),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

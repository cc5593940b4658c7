"""The corpus pipeline: stages over ``documents``, applied one after another.

Each stage takes (spark, docs, sf_dir) and works on every row that the one
before it kept. All but the last return the columns of ``documents``:

quality classifier   rejected documents go
SimHash near-dedup   one document of each group of near duplicates stays, the
                     one with the least doc_id (similarity of five-word
                     shingles of 0.8 or more); a row without doc_id stays
substring dedup      words of repeated passages are taken out of the texts;
                     n_chars follows a text that changes
best-fit packing     the pieces of all texts, with their sequences and offsets
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import near_copies, packing, quality, substring_dedup
from tracelake.llm.shared import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.without_near_copies(docs, similarity=0.8, shingle=5, distance=4, seed=42)


def substring_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeated(docs, width=35)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, "word_bpe_49k.json", 2048)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_removal),
    ("best_fit_packing", best_fit_packing),
]
#: SQL has neither the classifier nor the fingerprints' hash nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus from raw documents, in five stages.

1. quality: documents whose score by attention-based multiple-instance learning is below one half go.
2. near_dedup: of each group of documents that SimHash fingerprints or a likeness of 0.8 of their sets of five-word
   shingles link, the one with the smallest id stays.
3. suffix_dedup: every string of 200 bytes that occurs twice or more is taken out of the texts.
4. decontaminate: documents that hold a benchmark item go.
5. mix: the remaining documents are given copy numbers, so that sources come to their target weights; their rows keep
   all columns, so the corpus can be written from the result.

A stage works on all that its predecessor kept; between stages documents are Parquet tables in the shared folder, which
go when they have been used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, mixing, quality, simhash, suffix_dedup
from cairn.llm._sample import crc_mod
from cairn.llm._store import durable, read, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, read(spark, sf_dir, "labels"), ~(crc_mod("doc_id", 3) == 1))
    return quality.keep_good(docs, model, threshold=0.5)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, width=3, max_bits=3, jaccard=0.8, gram=5)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.remove_repeats(docs, length=200)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.with_copies(docs, cycle=(1, 2, 3), max_copies=3)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
]

#: SQL can express neither the learned scores nor the pivotal rounding; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of ``documents``: their rows and columns with size, source_size, target, copies and taken."""
    docs = read(spark, sf_dir, "documents")
    *early, (_, before_last), (_, last) = STAGES
    with scratch(spark):
        for _, stage in early:
            with scratch(spark):
                docs = durable(stage(spark, docs, sf_dir), keep=True)
        docs = durable(before_last(spark, docs, sf_dir), keep=True)
    return last(spark, docs, sf_dir)

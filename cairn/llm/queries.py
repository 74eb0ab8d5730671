"""Queries over the corpus tables, one for each operator of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, decontaminate, htmltext, langid, lexical, linkgraph, merkle, mixing, quality, simhash, spotsigs, suffix_dedup, warc
from ._sample import crc_mod
from ._store import read


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read(spark, sf_dir, "pages"))


def op3_hierarchical_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 5) == 0
    found = langid.predict(docs, langid.fit(docs, ~held_out))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


#: (host, path, verdict), as the SQL below and its tests have them: they block net/de/, which the contract allows.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "block"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

#: The rules of the contract, which the query goes by.
CONTRACT_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op4_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge(read(spark, sf_dir, "pages"), CONTRACT_RULES)


def op5_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(read(spark, sf_dir, "documents"), length=200)


def op6_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 3) == 1
    found = quality.scores(docs, quality.fit(docs, read(spark, sf_dir, "labels"), ~held_out))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), width=3, max_bits=3)


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(read(spark, sf_dir, "pages")))


def op9_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), cycle=(1, 2, 3), max_copies=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.with_edited(read(spark, sf_dir, "documents"))


def op11_nested_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(read(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    vocabulary = bytebpe.Vocabulary.of(bytebpe.read_ranks(public_tokenizers.path(ranks)), public_tokenizers.PATTERN)
    return bytebpe.digests(read(spark, sf_dir, "documents"), vocabulary)


def op13_term_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranking(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), top=50)


QUERIES = {
    "op1_spaced_seeds": op1_spaced_seeds,
    "op2_page_differencing": op2_page_differencing,
    "op3_hierarchical_langid": op3_hierarchical_langid,
    "op4_link_graph": op4_link_graph,
    "op5_bwt_merge": op5_bwt_merge,
    "op6_attention_mil": op6_attention_mil,
    "op7_simhash_pivots": op7_simhash_pivots,
    "op8_warc_derivatives": op8_warc_derivatives,
    "op9_pivotal_mixing": op9_pivotal_mixing,
    "op10_spotsigs": op10_spotsigs,
    "op11_nested_manifest": op11_nested_manifest,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_term_pipeline": op13_term_pipeline,
}

ORACLES: dict[str, str] = {
    "op4_link_graph": linkgraph.judge_sql(URL_RULES),
    "op11_nested_manifest": merkle.VERIFIED_SQL,
    "op13_term_pipeline": lexical.ranking_sql(50),
}

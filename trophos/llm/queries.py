"""Registered queries of the training-data operators, and their SQL twins.

Each reads its whole tables.  ``QUERIES``: (spark, folder) to a DataFrame.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trophos.llm import (
    collocations,
    fingerprints,
    licenses,
    line_quality,
    minhash_dedup,
    mixing,
    ngram_lm,
    packing,
    prefix_trie,
    quality_rff,
    token_counts,
    toxicity,
    vector_graph,
)
from trophos.llm.labelled import held_out
from trophos.llm.oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "table", "tokenizer"]


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_documents(table(spark, folder, "documents"))


def op3_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    fold = held_out(F.col("doc_id"), 7, 2)
    scored = ngram_lm.score_documents(table(spark, folder, "documents"), fold, order=3)
    return scored.withColumn("held_out", fold)


def op4_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    return line_quality.judge(table(spark, folder, "documents"))


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, folder, "documents"), size=2)


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.beside_next(table(spark, folder, "documents"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), tokenizer())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_quality_score(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rff.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Three edits of every document, counted by its tree."""
    edits = token_counts.with_edits(table(spark, folder, "documents"))
    return token_counts.recount(edits, tokenizer()).drop("leaf_chars", "leaf_tokens")


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    labelled = mixing.labelled_rows(documents, table(spark, folder, "labels"), "lang")
    return mixing.mix(documents, labelled)


def op11_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return vector_graph.nearest_neighbours(table(spark, folder, "embeddings"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.build(table(spark, folder, "conversations"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_licences": op2_licences,
    "op3_lm_score": op3_lm_score,
    "op4_line_quality": op4_line_quality,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_fingerprints": op6_fingerprints,
    "op7_packing": op7_packing,
    "op8_quality_score": op8_quality_score,
    "op9_token_counts": op9_token_counts,
    "op10_mixing": op10_mixing,
    "op11_neighbours": op11_neighbours,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_collocations": op13_collocations,
}

"""A training corpus from ``documents``: reject, deduplicate, mix, pack.

Each stage takes what the one before kept and returns documents with all their
columns; the last returns the packed pieces.  Between stages the documents are
written to the shared folder and read again.
"""

from pyspark.sql import DataFrame, SparkSession

from trophos.llm import minhash_dedup, mixing, packing, quality_rff, toxicity
from trophos.llm.queries import table, tokenizer
from trophos.plans.scratch import Scratch

#: Shares of the domains are proportional to their tokens to this power.
FLATTEN = 0.7


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rff.reject_poor(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.drop_near_duplicates(docs, size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages to flattened shares.  No rate is below 1, so every document stays."""
    labelled = mixing.labelled_rows(docs, table(spark, sf_dir, "labels"), "lang")
    rates = mixing.mix(docs, labelled, power=FLATTEN, floor=1.0, total=0)
    return mixing.repeat_by_rate(docs, rates)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer())


STAGES = [
    ("toxicity", reject_toxic),
    ("quality classifier", reject_poor),
    ("near duplicates", deduplicate),
    ("mixing", mix),
    ("packing", pack),
]

#: No stage can be stated in SQL; each is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs

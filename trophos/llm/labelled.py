"""A bounded set of labelled rows to fit a classifier on."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, at most.
MAX_LABELLED = 20_000


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column, modulus: int, fold: int) -> Column:
    """Whether the id is in the fold that is not learned from; a null id is not."""
    return F.coalesce(remainder(doc_id, modulus) == fold, F.lit(False))


def training_rows(
    documents: DataFrame,
    labels: DataFrame,
    target: str,
    modulus: int = 5,
    fold: int = 0,
    limit: int = MAX_LABELLED,
) -> DataFrame:
    """(text, label) of at most ``limit`` labelled documents outside the held-out fold.

    Rows with a null id or label are left out; an id labelled twice counts with
    its higher label.  The choice is by a hash of the id and so does not depend
    on the order of the rows.  The chosen ids are bounded by ``limit`` and small,
    so they are broadcast; the documents are not moved.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull())
        .where(~held_out(F.col("doc_id"), modulus, fold))
        .groupBy("doc_id")
        .agg(F.max(F.col(target).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")

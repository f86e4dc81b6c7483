"""Cleaning the component metadata and matching it with the model."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trophos.schemas import INFO
from trophos.sources.model import in_order

REQUIRED = ("ID", "FullName", "Colour")

# Colours given in turn to components without metadata.
PALETTE = (
    "#5050ff", "#ce3d32", "#749b58", "#f0e685", "#466983", "#ba6338", "#5db1dd",
    "#802268", "#6bd76b", "#d595a7", "#924822", "#837b8d", "#c75127", "#d58f5c",
)


def validate_metadata(df: DataFrame) -> DataFrame:
    """``ID, FullName, Colour`` as trimmed strings without NULL.

    A frame without these columns (``Color`` is accepted), or with nothing in
    them, gives an empty frame.  An ID that occurs twice is an error: it would
    multiply every row it labels.
    """
    if "Color" in df.columns and "Colour" not in df.columns:
        df = df.withColumnRenamed("Color", "Colour")
    empty = df.sparkSession.createDataFrame([], INFO)
    if not set(REQUIRED) <= set(df.columns):
        return empty
    texts = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) for c in REQUIRED]
    clean = df.select(*texts)
    key = F.when(F.col("ID") != "", F.col("ID"))
    found = clean.agg(
        F.max(F.concat(*REQUIRED) != "").alias("any"),
        (F.count(key) - F.count_distinct(key)).alias("repeated"),
    ).first()
    if not found["any"]:
        return empty
    if found["repeated"]:
        raise ValueError("a metadata ID occurs more than once")
    return clean


def reconcile_metadata(info: DataFrame, components: DataFrame) -> DataFrame:
    """Metadata of the model's components: unknown IDs dropped, components
    without metadata added under their own name with a palette colour."""
    names = components.select("Component")
    kept = info.select(*REQUIRED).join(names, info["ID"] == names["Component"], "left_semi")
    missing = in_order(components).join(
        info.select("ID"), F.col("Component") == F.col("ID"), "left_anti"
    )
    # One row per component of the model, so one task is enough to number them.
    turn = F.row_number().over(Window.orderBy("Ord")) - 1
    added = missing.select(
        F.col("Component").alias("ID"),
        F.col("Component").alias("FullName"),
        cycle_colour(PALETTE, turn).alias("Colour"),
    )
    return kept.unionByName(added)


def cycle_colour(palette, turn):
    """The ``turn``-th colour (from 0) of a palette that starts over."""
    colours = F.array(*map(F.lit, palette))
    return F.element_at(colours, (F.pmod(turn, F.lit(len(palette))) + 1).cast("int"))

"""The food web as a graph: eligibility, selection, nodes, edges, colours."""

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trophos.operators.metadata import cycle_colour
from trophos.operators.mortality import is_fleet
from trophos.sources.model import dimension, local_table

# Flux colours, used in turn.
FLUX_PALETTE = (
    "#5050ff", "#ce3d32", "#749b58", "#f0e685", "#466983", "#ba6338", "#5db1dd",
    "#802268", "#6bd76b", "#d595a7", "#924822", "#837b8d", "#c75127", "#d58f5c",
    "#7a65a5", "#e4af69", "#3b1b53", "#cddeb7", "#612a79", "#ae1f63", "#e7c76f",
    "#5a655e", "#cc9900", "#99cc00", "#a9a9a9", "#cc9900", "#99cc00", "#33cc00",
    "#00cc33", "#00cc99", "#0099cc", "#0a47ff", "#4775ff", "#ffc20a", "#ffd147",
    "#990033", "#991a00", "#996600", "#809900", "#339900", "#00991a", "#009966",
    "#008099", "#003399", "#1a0099", "#660099", "#990080", "#d60047", "#ff1463",
    "#00d68f", "#14ffb1",
)

# The flags a component needs per variable.
ELIGIBLE = {
    "Biomass": "IsBiomass",
    "Consumption": "IsConsumer",
    "Predation and Fisheries": "IsPredatedCatched",
    "Ratio Consumption/Biomass": "IsConsumer AND IsBiomass",
    "Ratio Production/Biomass": "IsPredatedCatched AND IsBiomass",
    "Mortality and Growth": (
        "IsBiomass AND IsPredatedCatched AND IsConsumer"
        " AND NOT IsCatchedOnly AND NOT IsPredatedOnly"
    ),
}


def component_resolution(
    components: DataFrame, fluxes: DataFrame, biomass: DataFrame | Iterable[str], fleet=is_fleet
) -> DataFrame:
    """What is known per component: biomass, inflows, outflows, and whether
    all or none of the outflows go to fleets.

    ``biomass`` names the components with a biomass: the long table, or the
    names themselves (such as those of the wide table's columns), which saves
    a pass over the long table.
    """
    if isinstance(biomass, DataFrame):
        measured = biomass.filter(F.col("kind") == "component").select("Var").distinct()
        measured = measured.select(F.col("Var").alias("b"), F.lit(True).alias("IsBiomass"))
    else:
        measured = components.filter(F.col("Component").isin(list(biomass))).select(
            F.col("Component").alias("b"), F.lit(True).alias("IsBiomass")
        )
    to_fleet = fleet(F.col("To"))
    out = fluxes.groupBy(F.col("From").alias("s")).agg(
        F.bool_and(to_fleet).alias("IsCatchedOnly"),
        F.bool_and(~to_fleet).alias("IsPredatedOnly"),
        F.lit(True).alias("IsPredatedCatched"),
    )
    into = fluxes.select(F.col("To").alias("d"), F.lit(True).alias("IsConsumer")).distinct()
    joined = (
        components.select("Component")
        .join(measured, F.col("Component") == F.col("b"), "left")
        .join(into, F.col("Component") == F.col("d"), "left")
        .join(out, F.col("Component") == F.col("s"), "left")
    )
    flags = ("IsBiomass", "IsConsumer", "IsPredatedCatched", "IsCatchedOnly", "IsPredatedOnly")
    return joined.select("Component", *[F.coalesce(f, F.lit(False)).alias(f) for f in flags])


def resolved_components(resolution: DataFrame, variable: str) -> DataFrame:
    """Components the variable can be computed for."""
    return resolution.filter(ELIGIBLE[variable]).select("Component")


def select_valid(selected: DataFrame | Sequence[str], resolved: DataFrame) -> DataFrame:
    """The selected names that are resolved; an error when there is none."""
    spark = resolved.sparkSession
    if not isinstance(selected, DataFrame):
        selected = local_table(spark, [(s,) for s in selected], "Component string")
    valid = selected.select("Component").distinct().join(resolved, "Component", "left_semi")
    if valid.isEmpty():
        raise ValueError("none of the selected components is resolved")
    return valid


def foodweb_nodes(
    info: DataFrame, components: DataFrame, resolved: DataFrame, seed: int = 0
) -> DataFrame:
    """Metadata with position (random where unknown), eligibility, opacity."""
    places = components
    for axis in ("X", "Y"):
        if axis not in places.columns:
            places = places.withColumn(axis, F.lit(None).cast("double"))
    places = places.select(
        F.col("Component").alias("id"),
        F.coalesce("X", F.rand(seed)).alias("X"),
        F.coalesce("Y", F.rand(seed + 1)).alias("Y"),
    )
    flags = resolved.select(F.col("Component").alias("id"), F.lit(True).alias("found")).distinct()
    nodes = info.select(F.col("ID").alias("id"), "FullName", "Colour")
    is_resolved = F.coalesce("found", F.lit(False))
    return nodes.join(places, "id", "left").join(flags, "id", "left").select(
        "id",
        "FullName",
        "Colour",
        is_resolved.alias("is_resolved"),
        F.when(is_resolved, F.lit(1.0)).otherwise(F.lit(0.4)).alias("opacity"),
        (F.col("X") * 1000).alias("x"),
        (F.col("Y") * 1000).alias("y"),
    )


def foodweb_edges(fluxes: DataFrame, labels: bool = True) -> DataFrame:
    label = F.col("Flux") if labels else F.lit("")
    return fluxes.select(
        F.col("Flux").alias("id"), label.alias("label"),
        F.col("From").alias("from"), F.col("To").alias("to"),
    )


def flux_labels(fluxes: DataFrame, info: DataFrame) -> DataFrame:
    """``ID`` (From_To), its label and both ends per edge."""
    names = info.select("ID", "FullName")
    prey = names.select(F.col("ID").alias("p"), F.col("FullName").alias("prey_name"))
    predator = names.select(F.col("ID").alias("q"), F.col("FullName").alias("predator_name"))
    joined = fluxes.join(prey, F.col("From") == F.col("p"), "left").join(
        predator, F.col("To") == F.col("q"), "left"
    )
    return joined.select(
        F.concat("From", F.lit("_"), "To").alias("ID"),
        "From",
        "To",
        F.concat(
            F.lit("From "), F.coalesce("prey_name", "From"),
            F.lit(" to "), F.coalesce("predator_name", "To"),
        ).alias("series"),
    )


def assign_colours(labels: DataFrame) -> DataFrame:
    """``series, Colour``: the palette in turn over the distinct labels, in the
    order of their first (predator, prey) pair.  Needs the edges only, never
    the samples."""
    first = labels.groupBy("series").agg(F.min(F.struct("To", "From")).alias("first"))
    # One row per edge label of the model, so one task is enough to number them.
    turn = F.row_number().over(Window.orderBy("first")) - 1
    return first.select("series", cycle_colour(FLUX_PALETTE, turn).alias("Colour"))


def add_flux_labels(values: DataFrame, fluxes: DataFrame, info: DataFrame) -> DataFrame:
    """Adds ``series`` and ``Colour`` to flux values by ``ID``."""
    labels = flux_labels(fluxes, info)
    named = labels.join(assign_colours(labels), "series").select("ID", "series", "Colour")
    return values.join(dimension(named.distinct()), "ID", "left")

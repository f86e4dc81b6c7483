"""Biomass, consumption, predation and flux series.

Every ``*_values`` function gives one row per sample and series; every
``*_series`` function gives its quantile table.  A selection of None takes all
names that occur.  ``names`` are the names the model has, and a selection
without any of them is an error; where they are not given, a selection without
any row is.  ``fluxes``, the model's flux table, turns a selection of components
into edge names, by which a scan of the long table skips all other rows.
"""

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trophos.functions.numeric import strict_sum
from trophos.functions.quantiles import quantile_summary, quantiles_long
from trophos.schemas import GROUP_COLOUR, VARIABLES
from trophos.sources.model import edge_names, flux_names

# Names of a list that Parquet compares one by one (spark.sql.parquet.pushdown.inFilterThreshold).
PUSHED = 10


def check_names(selected: Sequence[str] | None, names: Iterable[str] | None, rows: DataFrame) -> None:
    """An error if nothing is selected; ``rows`` are looked at only without ``names``."""
    if selected is None:
        return
    if not selected or (rows.isEmpty() if names is None else not set(selected) & set(names)):
        raise ValueError("param not recognized")


def is_grouped(selected: Sequence[str] | None, group: bool) -> bool:
    """Grouping applies to more than one selected member only."""
    return group and (selected is None or len(selected) > 1)


def is_selected(column: str, selected: Sequence[str] | None) -> Column:
    return F.lit(True) if selected is None else is_one_of(column, selected)


def group_components(
    values: DataFrame, label: str, keep: Sequence[str] = (), sums: Sequence[str] = ("value",)
) -> DataFrame:
    """One super-species: members summed per Year, sample and ``keep``."""
    return values.groupBy("Year", "Sample_id", *keep).agg(
        *[strict_sum(F.col(c)).alias(c) for c in sums]
    ).withColumn("ID", F.lit(label))


def add_labels(values: DataFrame, info: DataFrame, group_label: str | None = None) -> DataFrame:
    """Adds ``series`` (full name, else the ID) and ``Colour`` by ``ID``."""
    labels = info.select("ID", "FullName", "Colour")
    group = F.lit(group_label)
    out = values.join(labels, "ID", "left")
    return out.select(
        *values.columns,
        F.coalesce("FullName", "ID").alias("series"),
        F.when(F.col("ID") == group, F.coalesce("Colour", F.lit(GROUP_COLOUR)))
        .otherwise(F.col("Colour")).alias("Colour"),
    )


def is_one_of(column: str, names: Sequence[str]) -> Column:
    """``column`` is one of the names, however many, in a form that a scan can skip row groups and pages by.

    Parquet gets a list of more than ten names as the range from the least to
    the greatest.  Lists of ten arrive as they are; the whole list, a hash set,
    is looked up first for each row that is read.
    """
    names = sorted(set(names))
    whole = F.col(column).isin(names)
    if len(names) <= PUSHED:
        return whole
    parts = [F.col(column).isin(names[i : i + PUSHED]) for i in range(0, len(names), PUSHED)]
    while len(parts) > 1:  # a balanced tree of any number of lists
        parts = [reduce(or_, parts[i : i + 8]) for i in range(0, len(parts), 8)]
    return whole & parts[0]


def edges_at(long: DataFrame, components: Sequence[str] | None, side: str, fluxes: DataFrame | None) -> Column:
    """Filter of the flux rows with a component at ``side``.

    The long table is sorted by ``Var``, which begins with the source: by edge
    names a scan also skips the row groups without a selected target.
    """
    if components is None or fluxes is None:
        return is_selected(side, components)
    end = {"src": "From", "dst": "To"}[side]
    names = fluxes.filter(F.col(end).isin(list(components)))
    return is_one_of("Var", [r["Flux"] for r in flux_names(names).select(F.col("Component").alias("Flux")).collect()])


def own_and_flows(
    long: DataFrame, components: Sequence[str], side: str, fluxes: DataFrame | None = None
) -> DataFrame:
    """Biomass rows of the components and the flux rows with one at ``side``,
    as ``ID, Year, Sample_id, own, dst, value``; ``own`` marks biomass."""
    ids = list(components)
    own = F.col("kind") == "component"
    name = F.when(own, F.col("Var")).otherwise(F.col(side))
    # The first filter is implied by the second; in this form it reaches the scan.
    near = long.filter(is_one_of("Var", ids) | edges_at(long, ids, side, fluxes))
    rows = near.select(name.alias("ID"), "Year", "Sample_id", own.alias("own"), "dst", "value")
    return rows.filter(F.col("ID").isin(ids))


def biomass_values(long, components, group=False, group_label=None):
    """``Year, Sample_id, ID, value`` of the selected components."""
    own = long.filter((F.col("kind") == "component") & is_selected("Var", components))
    values = own.select("Year", "Sample_id", F.col("Var").alias("ID"), "value")
    return group_components(values, group_label) if is_grouped(components, group) else values


def biomass_series(long, components, group=False, group_label=None, *, names=None, method="sort"):
    check_names(components, names, biomass_values(long, components))
    values = biomass_values(long, components, group, group_label)
    return _quant(values, "Biomass", method=method)


def consumption_values(long, components, info, group=False, group_label=None, fluxes=None):
    """Inflows of the selected predators: ``Year, Sample_id, ID, target,
    Colour_target, value`` with the prey's label as target."""
    return _flows(long, components, info, "dst", "src", group, group_label, fluxes).drop("edge")


def consumption_series(
    long, components, info, group=False, group_label=None, *, names=None, fluxes=None, method="sort"
):
    check_names(components, names, long.filter(is_selected("dst", components)))
    flows = _flows(long, components, info, "dst", "src", group, group_label, fluxes)
    return _flow_quant(flows, "Consumption", "All prey", method)


def predation_values(long, components, info, group=False, group_label=None, fluxes=None):
    """Outflows of the selected prey; the target is the predator's or fleet's
    label.  Columns as in ``consumption_values``."""
    return _flows(long, components, info, "src", "dst", group, group_label, fluxes).drop("edge")


def predation_series(
    long, components, info, group=False, group_label=None, *, names=None, fluxes=None, method="sort"
):
    check_names(components, names, long.filter(is_selected("src", components)))
    flows = _flows(long, components, info, "src", "dst", group, group_label, fluxes)
    return _flow_quant(flows, "Predation and Fisheries", "All predators", method)


def flux_values(long, selected=None, group=False, group_label=None):
    """``Year, Sample_id, ID, src, dst, value`` of the selected edges
    (``From_To`` names)."""
    edges = long.filter((F.col("kind") == "flux") & is_selected("Var", selected))
    if is_grouped(selected, group):
        return group_components(edges.select("Year", "Sample_id", "value"), group_label)
    return edges.select("Year", "Sample_id", F.col("Var").alias("ID"), "src", "dst", "value")


def flux_series(
    long, selected=None, group=False, group_label=None, *, names=None, fluxes=None, method="sort"
):
    """With ``fluxes``, the selection may also hold flux ids."""
    if fluxes is not None and selected is not None:
        selected = edge_names(selected, fluxes)
    check_names(selected, names, flux_values(long, selected))
    return _quant(flux_values(long, selected, group, group_label), "Fluxes", method=method)


def _flows(long, components, info, focus, other, group, group_label, fluxes=None):
    """Flows of the focus with the label of the other end; ``edge`` tells targets of one label apart."""
    flows = long.filter((F.col("kind") == "flux") & edges_at(long, components, focus, fluxes))
    labels = info.select(
        F.col("ID").alias("label_id"), "FullName", F.col("Colour").alias("Colour_target")
    )
    flows = flows.join(labels, F.col(other) == F.col("label_id"), "left").select(
        "Year",
        "Sample_id",
        F.col(focus).alias("ID"),
        F.coalesce("FullName", other).alias("target"),
        "Colour_target",
        "value",
        F.col(other).alias("edge"),
    )
    if is_grouped(components, group):
        flows = group_components(flows, group_label, ["target", "Colour_target"])
        flows = flows.withColumn("edge", F.col("Colour_target"))
    return flows


def _quant(values, variable, keys=("Year", "ID"), method="sort"):
    return quantiles_long(quantile_summary(values, keys, method=method), keys, variable, VARIABLES[variable][0])


def _flow_quant(flows, variable, all_label, method):
    """Totals and the flows behind them, summed and summarised in one pass."""
    extra = VARIABLES[variable][1]
    total = ["Year", "Sample_id", "ID"]
    each = [*total, "target", "edge"]
    cells = flows.groupingSets([total, each], *each).agg(
        strict_sum(F.col("value")).alias("value"), (F.grouping("edge") == 1).alias("whole")
    )
    label = F.when(F.col("whole"), F.lit(all_label)).otherwise(F.col("target"))
    cells = cells.select("Year", "ID", "whole", label.alias(extra), "value")
    quant = _quant(cells, variable, ("Year", "ID", "whole", extra), method)
    return quant.select("Year", "Var", "Unit", "ID", extra, "Stat", "Value")

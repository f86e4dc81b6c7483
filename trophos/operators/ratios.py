"""Consumption/biomass and production/biomass ratios."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trophos.functions.numeric import ieee_div, strict_sum
from trophos.functions.quantiles import grouped_quantiles, quantiles_long, spread
from trophos.operators.series import check_names, is_grouped, own_and_flows


def ratio_values(long, components, side, group=False, group_label=None, fluxes=None) -> DataFrame:
    """``Year, Sample_id, ID, biomass, flow, value`` including the last year.

    ``side`` is ``'dst'`` for inflows (consumption) and ``'src'`` for outflows
    (production).  Biomass and flow rows meet in one aggregation, which has the
    rows of a full outer join without joining; what is missing counts as 0.
    """
    rows = own_and_flows(long, components, side, fluxes)
    v, own = F.col("value"), F.col("own")
    cells = rows.groupBy("ID", "Year", "Sample_id").agg(
        F.coalesce(strict_sum(v, own), F.lit(0.0)).alias("biomass"),
        F.coalesce(strict_sum(v, ~own), F.lit(0.0)).alias("flow"),
    )
    if is_grouped(components, group):
        cells = cells.groupBy("Year", "Sample_id").agg(
            F.sum("biomass").alias("biomass"), F.sum("flow").alias("flow")
        ).withColumn("ID", F.lit(group_label))
    return cells.select(
        "Year", "Sample_id", "ID", "biomass", "flow",
        ieee_div(F.col("flow"), F.col("biomass")).alias("value"),
    )


def ratio_samples(long, components, side, group=False, group_label=None) -> DataFrame:
    """``ratio_values`` before the last year of all selected rows, found by a
    scan of the years alone.  For sample lines."""
    last = own_and_flows(long, components, side).agg(F.max("Year"))
    values = ratio_values(long, components, side, group, group_label)
    return values.filter(F.col("Year") != last.scalar())


def drop_last_year(df: DataFrame) -> DataFrame:
    """Rows before the last year of the whole frame.

    Meant for frames of one row per year and series, not for samples.
    """
    last = F.max("Year").over(Window.partitionBy())
    return df.withColumn("last", last).filter(F.col("Year") != F.col("last")).drop("last")


def consumption_biomass_ratio(
    long, components, group=False, group_label=None, *, names=None, fluxes=None, method="sort"
):
    check_names(components, names, own_and_flows(long, components, "dst", fluxes))
    values = ratio_values(long, components, "dst", group, group_label, fluxes)
    return _quant(values, "Ratio Consumption/Biomass", method)


def production_biomass_ratio(
    long, components, group=False, group_label=None, *, names=None, fluxes=None, method="sort"
):
    check_names(components, names, own_and_flows(long, components, "src", fluxes))
    values = ratio_values(long, components, "src", group, group_label, fluxes)
    return _quant(values, "Ratio Production/Biomass", method)


def _quant(values, variable, method):
    keys = ["Year", "ID"]
    # The last year is dropped from the summary: finding it there needs no
    # second pass over the samples.
    summary = drop_last_year(grouped_quantiles(values, keys, method=method))
    return quantiles_long(spread(summary, keys, "raise"), keys, variable, "Unitless")

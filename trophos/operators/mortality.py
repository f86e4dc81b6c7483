"""Total, fishing and natural mortality, and growth."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trophos.functions.numeric import ieee_div, lenient_sum, r_log, strict_sum
from trophos.functions.quantiles import quantiles_long, spread, vector_quantiles
from trophos.operators.series import check_names, is_grouped, own_and_flows
from trophos.schemas import VARIABLES

# Rate column -> name in the quantile table.
METRICS = {
    "Z": "Total Mortality",
    "F": "Fishing Mortality",
    "M": "Natural Mortality",
    "G": "Growth",
}


def is_fleet(name: Column) -> Column:
    """Fishing fleets are the components whose ID starts with ``F``."""
    return name.startswith("F")


def mortality_values(
    long: DataFrame,
    components,
    group: bool = False,
    group_label: str | None = None,
    fleet: Callable[[Column], Column] = is_fleet,
    fluxes: DataFrame | None = None,
) -> DataFrame:
    """``Year, Sample_id, ID, B, B1, C, P, Z, F, M, G`` per sample.

    ``B`` and ``B1`` are this and the next year's biomass, ``C`` the catches
    and ``P`` the predation.  Each sample's last year is left out; a year whose
    successor is missing keeps a row with NULL rates.
    """
    rows = own_and_flows(long, components, "src", fluxes)
    if is_grouped(components, group):
        rows = rows.withColumn("ID", F.lit(group_label))
        # A predator's flow is missing when it is missing for any member.
        rows = rows.groupBy("ID", "Sample_id", "Year", "own", "dst").agg(
            strict_sum(F.col("value")).alias("value")
        )

    v, own = F.col("value"), F.col("own")
    catch = fleet(F.col("dst"))
    cells = rows.groupBy("ID", "Sample_id", "Year").agg(
        F.bool_or(own).alias("present"),
        strict_sum(v, own).alias("B"),
        lenient_sum(v, ~own & catch).alias("C"),
        lenient_sum(v, ~own & ~catch).alias("P"),
    )
    years = Window.partitionBy("ID", "Sample_id").orderBy("Year")
    cells = (
        cells.filter("present")
        .withColumn("next", F.lead("Year").over(years))
        .withColumn("next_B", F.lead("B").over(years))
        .filter(F.col("next").isNotNull())
        .withColumn("B1", F.when(F.col("next") == F.col("Year") + 1, F.col("next_B")))
    )
    b1, c, p = F.col("B1"), F.col("C"), F.col("P")
    z = -r_log(ieee_div(b1, b1 + c + p))
    return cells.withColumn("Z", z).select(
        "Year", "Sample_id", "ID", "B", "B1", "C", "P", "Z",
        (ieee_div(c, c + p) * F.col("Z")).alias("F"),
        (ieee_div(p, c + p) * F.col("Z")).alias("M"),
        r_log(ieee_div(b1 + c + p, F.col("B"))).alias("G"),
    )


def mortality_rates(values: DataFrame) -> DataFrame:
    """One row per rate: ``Year, Sample_id, ID, Metric, value``."""
    rows = values.unpivot(["Year", "Sample_id", "ID"], list(METRICS), "rate", "value")
    names = F.create_map(*[F.lit(t) for pair in METRICS.items() for t in pair])
    return rows.select("Year", "Sample_id", "ID", names[F.col("rate")].alias("Metric"), "value")


def mortality_growth(
    long, components, group=False, group_label=None, *, names=None, fleet=is_fleet, fluxes=None, method="sort"
) -> DataFrame:
    check_names(components, names, own_and_flows(long, components, "src", fluxes))
    values = mortality_values(long, components, group, group_label, fleet, fluxes)
    names = F.array(*map(F.lit, METRICS.values()))
    rates = vector_quantiles(values, ["Year", "ID"], list(METRICS), method)
    rates = rates.withColumn("Metric", F.get(names, F.col("measure")))
    keys = ["Year", "ID", "Metric"]
    variable = "Mortality and Growth"
    return quantiles_long(spread(rates, keys, "drop"), keys, variable, VARIABLES[variable][0])

"""One call for any of the seven variables."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trophos.operators.mortality import mortality_growth
from trophos.operators.network import resolved_components
from trophos.operators.ratios import consumption_biomass_ratio, production_biomass_ratio
from trophos.operators.series import (
    biomass_series,
    consumption_series,
    flux_series,
    predation_series,
)
from trophos.schemas import VARIABLES
from trophos.sources.model import edge_names

_WITH_INFO = {
    "Consumption": consumption_series,
    "Predation and Fisheries": predation_series,
}
_PLAIN = {
    "Biomass": biomass_series,
    "Fluxes": flux_series,
    "Ratio Consumption/Biomass": consumption_biomass_ratio,
    "Ratio Production/Biomass": production_biomass_ratio,
    "Mortality and Growth": mortality_growth,
}


def compute(
    variable: str,
    long: DataFrame,
    selected: Sequence[str],
    info: DataFrame,
    group: bool = False,
    group_label: str | None = None,
    *,
    names: Sequence[str] | None = None,
    fluxes: DataFrame | None = None,
    method: str = "sort",
) -> DataFrame:
    """Quantile table of a variable.  ``names`` and ``fluxes`` of the model are
    used as in ``trophos.operators.series``, ``method`` as in ``trophos.functions.quantiles``."""
    if variable not in VARIABLES:
        raise ValueError(f"unknown variable: {variable}")
    model = {"names": names, "method": method}
    if variable != "Biomass":
        model["fluxes"] = fluxes
    if variable in _WITH_INFO:
        return _WITH_INFO[variable](long, selected, info, group, group_label, **model)
    return _PLAIN[variable](long, selected, group, group_label, **model)


def valid_names(
    variable: str, selected: Sequence[str], resolution: DataFrame, fluxes: DataFrame
) -> list[str]:
    """The selected names the variable can be computed for; an error when none.

    For ``Fluxes`` the selection may hold flux ids or ``From_To`` names and the
    result holds the latter.  Reads the model's tables only.
    """
    if variable == "Fluxes":
        valid = edge_names(selected, fluxes)
    else:
        names = resolved_components(resolution, variable)
        names = names.filter(F.col("Component").isin(list(selected)))
        valid = sorted(r["Component"] for r in names.collect())
    if not valid:
        raise ValueError(f"{variable} cannot be computed for any selected name")
    return valid


def analyze(
    variable: str,
    long: DataFrame,
    selected: Sequence[str],
    info: DataFrame,
    resolution: DataFrame,
    fluxes: DataFrame,
    group: bool = False,
    group_label: str | None = None,
    method: str = "sort",
) -> DataFrame:
    """Checks the selection against the model, then computes the variable."""
    valid = valid_names(variable, selected, resolution, fluxes)
    edges = None if variable == "Fluxes" else fluxes
    return compute(variable, long, valid, info, group, group_label, names=valid, fluxes=edges, method=method)

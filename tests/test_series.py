import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tests.conftest import CELLS, long_rows
from trophos.operators import network, series


def table(quant, *keys):
    return {tuple(r[k] for k in keys): r["Value"] for r in quant.collect()}


def test_biomass(long):
    quant = series.biomass_series(long, ["A", "B"])
    got = table(quant.filter("ID = 'A' and Year = 1"), "Stat")
    assert got == {
        ("q0",): 100, ("q2.5",): 102.5, ("q25",): 125, ("q50",): 150, ("q75",): 175,
        ("q97.5",): 197.5, ("q100",): 200,
    }
    assert quant.columns == ["Year", "Var", "Unit", "ID", "Stat", "Value"]
    assert quant.count() == 2 * 3 * 7


def test_biomass_group(long):
    quant = series.biomass_series(long, ["A", "B"], True, "AB")
    got = table(quant.filter("Stat = 'q50'"), "Year", "ID")
    assert got == {(1, "AB"): 450, (2, "AB"): 345, (3, "AB"): 270}


def test_group_of_one_stays_single(long):
    quant = series.biomass_series(long, ["A"], True, "AB")
    assert {r["ID"] for r in quant.collect()} == {"A"}


def test_consumption(long, info):
    quant = series.consumption_series(long, ["A"], info)
    got = table(quant.filter("Stat = 'q50'"), "Year", "ID", "Prey")
    assert got == {
        (1, "A", "All prey"): 30, (1, "A", "Beta"): 30,
        (2, "A", "All prey"): 15, (2, "A", "Beta"): 15,
    }


def test_predation(long, info):
    quant = series.predation_series(long, ["B"], info)
    got = table(quant.filter("Stat = 'q50' and Year = 1"), "Predator")
    assert got == {("All predators",): 75, ("Alpha",): 30, ("Fleet",): 45}


def test_predation_group_sums_per_predator(long, info):
    quant = series.predation_series(long, ["A", "B"], info, True, "AB")
    got = table(quant.filter("Stat = 'q0' and Year = 1"), "ID", "Predator")
    assert got == {("AB", "All predators"): 60, ("AB", "Alpha"): 20, ("AB", "Fleet"): 40}


def test_targets_with_one_label_are_pooled(long, spark):
    same = spark.createDataFrame(
        [("A", "X", "#1"), ("FX", "X", "#1")], "ID string, FullName string, Colour string"
    )
    got = table(series.predation_series(long, ["B"], same).filter("Year = 1 and Stat = 'q50'"), "Predator")
    # Flows 20, 40 (to A) and 30, 60 (to FX) share the label.
    assert got == {("All predators",): 75, ("X",): 35}


def test_flux(long):
    quant = series.flux_series(long, ["B_A", "A_FX"])
    got = table(quant.filter("Stat = 'q100'"), "Year", "ID")
    assert got == {(1, "B_A"): 40, (2, "B_A"): 20, (1, "A_FX"): 20, (2, "A_FX"): 10}
    group = series.flux_series(long, ["B_A", "A_FX"], True, "G")
    assert table(group.filter("Stat = 'q0'"), "Year", "ID") == {(1, "G"): 30, (2, "G"): 15}


def test_flux_ids(long, fluxes):
    quant = series.flux_series(long, ["F01", "A_FX"], fluxes=fluxes)
    assert {r["ID"] for r in quant.collect()} == {"B_A", "A_FX"}
    with pytest.raises(ValueError, match="param not recognized"):
        series.flux_series(long, ["F99"], fluxes=fluxes)


def test_flux_labels(long, fluxes, info):
    values = network.add_flux_labels(series.flux_values(long, ["B_A"]), fluxes, info)
    assert {(r["series"], r["Colour"]) for r in values.collect()} == {("From Beta to Alpha", "#5050ff")}


def test_unknown_names(long, info):
    with pytest.raises(ValueError, match="param not recognized"):
        series.biomass_series(long, ["Q"], names=["A", "B"])
    with pytest.raises(ValueError, match="param not recognized"):
        series.consumption_series(long, [], info)


def test_missing_value_is_an_error(make_long):
    rows = long_rows(CELLS) + [(3, "component", "A", None, None, 1, None, None)]
    with pytest.raises(SparkRuntimeException, match="missing values"):
        series.biomass_series(make_long(rows), ["A"]).collect()


def test_missing_member_makes_the_group_missing(make_long):
    rows = [r for r in long_rows(CELLS) if not (r[2] == "B" and r[0] == 1 and r[5] == 1)]
    rows.append((1, "component", "B", None, None, 1, float("nan"), None))
    with pytest.raises(SparkRuntimeException, match="missing values"):
        series.biomass_series(make_long(rows), ["A", "B"], True, "AB").collect()


def test_names_with_underscore(make_long, info):
    rows = [(1, "flux", "B_x_A", "B_x", "A", 1, 5.0, None)]
    quant = series.consumption_series(make_long(rows), ["A"], info)
    assert {r["Prey"] for r in quant.collect()} == {"All prey", "B_x"}


def test_labels(long, info):
    values = series.add_labels(series.biomass_values(long, ["A"]), info)
    assert {(r["series"], r["Colour"]) for r in values.collect()} == {("Alpha", "#1")}
    group = series.add_labels(series.biomass_values(long, ["A", "B"], True, "AB"), info, "AB")
    assert {(r["series"], r["Colour"]) for r in group.collect()} == {("AB", "#27548A")}


def test_group_total_is_sum_of_members(long):
    members = series.biomass_values(long, ["A", "B"]).groupBy("Year", "Sample_id").agg(F.sum("value").alias("v"))
    group = series.biomass_values(long, ["A", "B"], True, "AB")
    both = group.join(members, ["Year", "Sample_id"])
    assert both.count() == 6 and both.filter("value <> v").isEmpty()

import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import CELLS, long_rows
from trophos.functions.numeric import ieee_div, r_log
from trophos.operators import mortality, ratios

close = lambda v: pytest.approx(v, abs=1e-7)


def median(quant, *keys):
    return {tuple(r[k] for k in keys): r["Value"] for r in quant.filter("Stat = 'q50'").collect()}


def test_ieee(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (nan, 0.0), (1.0, 4.0), (None, 0.0), (inf, 2.0), (1.0, nan)]
    df = spark.createDataFrame(rows, "n double, d double").coalesce(1)
    got = [r[0] for r in df.select(ieee_div(F.col("n"), F.col("d"))).collect()]
    assert got[0] == inf and got[1] == -inf and math.isnan(got[2]) and math.isnan(got[3])
    assert got[4] == 0.25 and got[5] is None and got[6] == inf and math.isnan(got[7])
    xs = spark.createDataFrame([(0.0,), (-1.0,), (1.0,), (nan,), (None,), (inf,)], "x double").coalesce(1)
    got = [r[0] for r in xs.select(r_log(F.col("x"))).collect()]
    assert got[0] == -inf and math.isnan(got[1]) and got[2] == 0 and math.isnan(got[3])
    assert got[4] is None and got[5] == inf


def test_consumption_ratio(long):
    quant = ratios.consumption_biomass_ratio(long, ["A"])
    assert median(quant, "Year") == {(1,): close(0.2), (2,): close(0.125)}


def test_production_ratio(long):
    quant = ratios.production_biomass_ratio(long, ["A", "B"])
    assert median(quant, "ID", "Year") == {
        ("A", 1): close(0.1), ("A", 2): close(0.0625),
        ("B", 1): close(0.25), ("B", 2): close(25 / 150),
    }
    group = ratios.production_biomass_ratio(long, ["A", "B"], True, "AB")
    assert median(group, "ID", "Year") == {("AB", 1): close(60 / 300), ("AB", 2): close(30 / 230)}


def test_ratio_lines_end_before_the_last_year(long):
    values = ratios.ratio_samples(long, ["A", "B"], "src")
    assert {(r["Sample_id"], r["Year"]) for r in values.collect()} == {(i, y) for i in (1, 2) for y in (1, 2)}


def test_ratio_of_missing_sides(make_long):
    rows = [r for r in long_rows(CELLS) if not (r[2] == "A" and r[5] == 1)]
    rows = [r for r in rows if not (r[2] == "B_A" and r[5] == 2)]
    quant = ratios.consumption_biomass_ratio(make_long(rows), ["A"])
    assert median(quant, "Year") == {(1,): math.inf, (2,): 0.0}


def test_missing_flow_counts_as_zero(make_long):
    rows = long_rows(CELLS) + [(1, "flux", "B_A", "B", "A", 1, None, None)]
    quant = ratios.consumption_biomass_ratio(make_long(rows), ["A"])
    low = {r["Year"]: r["Value"] for r in quant.filter("Stat = 'q0'").collect()}
    assert low == {1: 0.0, 2: close(0.125)}


def test_mortality(long):
    quant = mortality.mortality_growth(long, ["B"])
    got = median(quant, "Year", "Metric")
    assert got == {
        (1, "Total Mortality"): close(0.2876821), (1, "Fishing Mortality"): close(0.1726092),
        (1, "Natural Mortality"): close(0.1150728), (1, "Growth"): close(0.0),
        (2, "Total Mortality"): close(0.1892420), (2, "Fishing Mortality"): close(0.1135452),
        (2, "Natural Mortality"): close(0.0756968), (2, "Growth"): close(-0.0339016),
    }
    assert set(quant.columns) == {"Year", "Var", "Unit", "ID", "Metric", "Stat", "Value"}


def test_mortality_without_predation_is_missing(long):
    got = median(mortality.mortality_growth(long, ["A"]), "Year", "Metric")
    assert len(got) == 8 and set(got.values()) == {None}


def test_mortality_group(long):
    got = median(mortality.mortality_growth(long, ["A", "B"], True, "AB"), "Year", "Metric")
    assert got[1, "Total Mortality"] == close(math.log(290 / 230))


def test_total_is_sum_of_parts(long):
    values = mortality.mortality_values(long, ["B"])
    assert values.count() == 4 and values.filter("abs(Z - F - M) > 1e-12").isEmpty()


def test_year_gap_keeps_a_missing_year(make_long):
    rows = [r for r in long_rows(CELLS) if not (r[2] == "B" and r[5] == 2)]
    values = mortality.mortality_values(make_long(rows), ["B"])
    got = {(r["Sample_id"], r["Year"]): r["Z"] for r in values.collect()}
    assert got == {(1, 1): None, (2, 1): None}


def test_zero_next_biomass_and_zero_flows(make_long):
    cells = {**CELLS, "B": (200.0, 0.0, 120.0), "F01": (20.0, 0.0, None), "F03": (30.0, 0.0, None)}
    values = mortality.mortality_values(make_long(long_rows(cells)), ["B"])
    got = {r["Year"]: r for r in values.filter("Sample_id = 1").collect()}
    assert got[1]["Z"] == math.inf and got[2]["G"] == math.inf
    assert math.isnan(got[2]["F"]) and got[2]["Z"] == 0
    quant = mortality.mortality_growth(make_long(long_rows(cells)), ["B"])
    assert median(quant, "Year", "Metric")[2, "Fishing Mortality"] is None


def test_all_catches_missing_count_as_zero(make_long):
    rows = [r[:6] + (None,) + r[7:] if r[2] == "B_FX" else r for r in long_rows(CELLS)]
    got = mortality.mortality_values(make_long(rows), ["B"]).filter("Year = 1 and Sample_id = 1").first()
    assert got["C"] == 0 and got["F"] == 0 and got["M"] == close(math.log(170 / 150))

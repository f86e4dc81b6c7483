import pytest
from pyspark.sql import functions as F

from trophos.operators import metadata, network
from trophos.plans.analyze import analyze, compute
from trophos.schemas import VARIABLES
from trophos.sources.metadata import read_metadata, write_metadata

INFO = "ID string, FullName string, Colour string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_clean_metadata(spark):
    raw = spark.createDataFrame([(" A ", None, "#1"), ("B", "", " ")], "ID string, FullName string, Color string")
    assert rows(metadata.validate_metadata(raw)) == [("A", "", "#1"), ("B", "", "")]


def test_metadata_that_is_rejected(spark):
    for raw in (
        spark.createDataFrame([("A", "x")], "ID string, FullName string"),
        spark.createDataFrame([(" ", None, "")], INFO),
        spark.createDataFrame([], INFO),
    ):
        clean = metadata.validate_metadata(raw)
        assert clean.columns == ["ID", "FullName", "Colour"] and clean.isEmpty()


def test_repeated_id(spark):
    raw = spark.createDataFrame([("A", "x", "#1"), ("A ", "y", "#2")], INFO)
    with pytest.raises(ValueError, match="more than once"):
        metadata.validate_metadata(raw)


def test_metadata_file_with_bom(spark, tmp_path):
    path = tmp_path / "info.csv"
    path.write_bytes(b"\xef\xbb\xbfID,FullName,Colour\nA,Alpha (adults),#00c5e7\n")
    info = read_metadata(spark, str(path))
    assert rows(info) == [("A", "Alpha (adults)", "#00c5e7")]
    write_metadata(info, f"{tmp_path}/out")
    assert rows(read_metadata(spark, f"{tmp_path}/out")) == rows(info)
    assert read_metadata(spark, f"{tmp_path}/absent").isEmpty()
    for k, body in enumerate(("ID,FullName,Colour\nA,Alpha\n", "ID,FullName,Colour\nA,Alpha,#1,more\n")):
        bad = tmp_path / f"bad{k}.csv"
        bad.write_text(body)
        assert read_metadata(spark, str(bad)).isEmpty()


def test_reconcile(spark):
    info = spark.createDataFrame([("A", "Alpha", "#1"), ("Q", "?", "#2")], INFO)
    names = ["C", "A"] + [f"N{i:02}" for i in range(15)]
    components = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "Component string, Ord int")
    got = {r["ID"]: (r["FullName"], r["Colour"]) for r in metadata.reconcile_metadata(info, components).collect()}
    assert got["A"] == ("Alpha", "#1") and "Q" not in got
    assert got["C"] == ("C", "#5050ff") and got["N00"] == ("N00", "#ce3d32")
    assert got["N13"][1] == "#5050ff"


def test_reconcile_of_equal_sets_changes_nothing(spark, info, components):
    assert rows(metadata.reconcile_metadata(info, components)) == rows(info)


def test_resolution(components, fluxes, long):
    expected = [
        ("A", True, True, True, True, False),
        ("B", True, False, True, False, False),
        ("FX", False, True, False, False, False),
    ]
    assert rows(network.component_resolution(components, fluxes, long)) == expected
    assert rows(network.component_resolution(components, fluxes, ["A", "B"])) == expected


def test_resolved_components(components, fluxes):
    resolution = network.component_resolution(components, fluxes, ["A", "B"])
    got = {v: [r[0] for r in network.resolved_components(resolution, v).orderBy("Component").collect()]
           for v in network.ELIGIBLE}
    assert got == {
        "Biomass": ["A", "B"],
        "Consumption": ["A", "FX"],
        "Predation and Fisheries": ["A", "B"],
        "Ratio Consumption/Biomass": ["A"],
        "Ratio Production/Biomass": ["A", "B"],
        "Mortality and Growth": [],
    }
    assert set(network.ELIGIBLE) | {"Fluxes"} == set(VARIABLES)


def test_selection(components):
    assert rows(network.select_valid(["A", "Q", "A"], components.select("Component"))) == [("A",)]
    with pytest.raises(ValueError, match="resolved|cannot be computed"):
        network.select_valid(["Q"], components.select("Component"))


def test_nodes_and_edges(info, components, fluxes, spark):
    placed = components.withColumn("X", F.when(F.col("Component") == "A", 0.25))
    resolved = spark.createDataFrame([("A",)], "Component string")
    nodes = {r["id"]: r for r in network.foodweb_nodes(info, placed, resolved, seed=3).collect()}
    assert nodes["A"]["x"] == 250 and nodes["A"]["opacity"] == 1.0 and nodes["A"]["is_resolved"]
    assert nodes["B"]["opacity"] == 0.4 and 0 <= nodes["B"]["x"] <= 1000
    assert rows(network.foodweb_edges(fluxes))[0] == ("F01", "F01", "B", "A")
    assert rows(network.foodweb_edges(fluxes, labels=False))[0][1] == ""


def test_flux_colours(fluxes, info):
    labels = network.flux_labels(fluxes, info)
    # Order by (predator, prey): B_A, A_FX, B_FX.
    assert rows(network.assign_colours(labels)) == [
        ("From Alpha to Fleet", "#ce3d32"),
        ("From Beta to Alpha", "#5050ff"),
        ("From Beta to Fleet", "#749b58"),
    ]


def test_colours_start_over(spark):
    edges = spark.createDataFrame([(f"F{i}", "P", f"Q{i:02}") for i in range(53)], "Flux string, From string, To string")
    info = spark.createDataFrame([], INFO)
    got = {r["series"]: r["Colour"] for r in network.assign_colours(network.flux_labels(edges, info)).collect()}
    assert got["From P to Q51"] == got["From P to Q00"] == "#5050ff"


def test_analyze(long, info, components, fluxes):
    resolution = network.component_resolution(components, fluxes, ["A", "B"])
    selected = {"Fluxes": ["F01", "A_FX"], "Mortality and Growth": ["A"]}
    for variable in VARIABLES:
        args = (variable, long, selected.get(variable, ["A", "FX"]), info, resolution, fluxes)
        if variable == "Mortality and Growth":
            with pytest.raises(ValueError, match="resolved|cannot be computed"):
                analyze(*args)
            continue
        quant = analyze(*args)
        assert {r["Var"] for r in quant.select("Var").distinct().collect()} == {variable}
        assert quant.filter("Value is null").isEmpty()
    with pytest.raises(ValueError, match="unknown variable"):
        compute("Depth", long, ["A"], info)
    with pytest.raises(ValueError, match="resolved|cannot be computed"):
        analyze("Fluxes", long, ["nothing"], info, resolution, fluxes)


def test_fluxes_by_either_name(long, info, components, fluxes):
    resolution = network.component_resolution(components, fluxes, ["A", "B"])
    got = [
        {r["ID"] for r in analyze("Fluxes", long, s, info, resolution, fluxes).collect()}
        for s in (["F01"], ["B_A"])
    ]
    assert got == [{"B_A"}, {"B_A"}]

import os

import pytest
from pyspark.sql import functions as F

from trophos.functions.quantiles import STATS
from trophos.operators import series
from trophos.schemas import REGISTRY
from trophos.sources import store


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_register(spark):
    empty = spark.createDataFrame([], REGISTRY)
    ids = spark.createDataFrame([("A",), ("B",), ("A",)], "Component string")
    once = store.register_series(empty, "Biomass", ids)
    twice = store.register_series(once, "Biomass", ids)
    assert rows(twice) == [("Biomass", "A"), ("Biomass", "B")]
    assert store.register_series(twice, "Fluxes", ids).count() == 4


def test_upsert(long):
    old = series.biomass_series(long, ["A", "B"])
    new = series.biomass_series(long.withColumn("value", long["value"] + 1), ["A"])
    both = store.upsert_quantiles(old, new)
    assert both.count() == old.count()
    got = {(r["ID"], r["Value"]) for r in both.filter("Year = 1 and Stat = 'q0'").collect()}
    assert got == {("A", 101), ("B", 200)}
    assert rows(store.upsert_quantiles(both, new)) == rows(both)


def test_upsert_on_disk(spark, tmp_path, long, info):
    path = f"{tmp_path}/store"
    biomass = series.biomass_series(long, ["A", "B"])
    store.write_quantiles(biomass, path)
    store.write_quantiles(series.consumption_series(long, ["A"], info), path)
    before = rows(store.read_quantiles(spark, path))
    store.write_quantiles(biomass, path)
    assert rows(store.read_quantiles(spark, path)) == before
    more = series.biomass_series(long.withColumn("value", long["value"] + 1), ["A"])
    store.write_quantiles(more, path)
    got = store.read_quantiles(spark, path).filter("Var = 'Biomass' and Year = 1 and Stat = 'q0'")
    assert {(r["ID"], r["Value"]) for r in got.collect()} == {("A", 101), ("B", 200)}
    assert len(before) == store.read_quantiles(spark, path).count()


def test_an_empty_id_is_refused(spark, tmp_path, long):
    from pyspark.errors import PySparkException

    quant = series.biomass_series(long, ["A"]).withColumn("ID", F.lit(""))
    with pytest.raises(PySparkException, match="needs an ID"):
        store.write_quantiles(quant, f"{tmp_path}/store")


def biomass(long, names, times):
    return series.biomass_series(long.withColumn("value", long["value"] * times), names)


def least(df):
    return {(r["ID"], r["Value"]) for r in df.filter("Year = 1 and Stat = 'q0'").collect()}


def test_readers_see_whole_snapshots(spark, tmp_path, long, monkeypatch):
    path = f"{tmp_path}/store"
    with pytest.raises(FileNotFoundError, match="no quantiles"):
        store.read_quantiles(spark, path)
    store.write_quantiles(biomass(long, ["A", "B"], 1), path)
    before = store.read_quantiles(spark, path)
    store.write_quantiles(biomass(long, ["A"], 2), path)
    assert least(before) == {("A", 100), ("B", 200)}
    assert least(store.read_quantiles(spark, path)) == {("A", 200), ("B", 200)}
    # a writer that is lost before its snapshot has a number leaves the store as it was
    monkeypatch.setattr(store, "_claim", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.write_quantiles(biomass(long, ["A", "B"], 5), path)
    assert least(store.read_quantiles(spark, path)) == {("A", 200), ("B", 200)}


def test_two_writers_lose_nothing(spark, tmp_path, long, monkeypatch):
    path = f"{tmp_path}/store"
    store.write_quantiles(biomass(long, ["A", "B"], 1), path)
    claim, calls = store._claim, []

    def late(spark, path, number, folder):
        calls.append(number)
        if len(calls) == 1:  # another writer is first
            store.write_quantiles(biomass(long, ["B"], 3), path)
        return claim(spark, path, number, folder)

    monkeypatch.setattr(store, "_claim", late)
    store.write_quantiles(biomass(long, ["A"], 2), path)
    assert calls == [2, 2, 3]
    assert least(store.read_quantiles(spark, path)) == {("A", 200), ("B", 600)}
    assert len([f for f in os.listdir(path) if f.startswith("rows-")]) == 3


def test_files_of_the_store_are_bounded(spark, tmp_path, long):
    path = f"{tmp_path}/store"
    for times in range(1, 6):
        store.write_quantiles(biomass(long, ["A", "B"], times), path, kept=2)
    folders = [f for f in os.listdir(path) if f.startswith("rows-")]
    assert len(folders) == 2 and least(store.read_quantiles(spark, path)) == {("A", 500), ("B", 1000)}
    parts = [f for folder in folders for f in os.listdir(f"{path}/{folder}") if f.endswith(".parquet")]
    assert len(parts) <= 4
    assert [f for f in sorted(os.listdir(f"{path}/_snapshots")) if not f.startswith(".")] == ["000000000004", "000000000005"]


def test_any_variable_is_exported(spark, tmp_path, long):
    own = series.biomass_series(long, ["A"]).withColumn("Var", F.lit("Fluxes by prey"))
    kept = store.upsert_quantiles(series.biomass_series(long, ["B"]), own)
    picked = kept.select(F.col("Var").alias("Variable"), F.col("ID").alias("Component")).distinct()
    assert store.export_series(kept, picked, f"{tmp_path}/out") == ["Biomass.csv", "Fluxes_by_prey.csv"]
    assert spark.read.csv(f"{tmp_path}/out/Fluxes_by_prey.csv", header=True).count() == 3 * 7


def test_export(spark, tmp_path, long, info):
    kept = store.upsert_quantiles(
        series.biomass_series(long, ["A", "B"]), series.predation_series(long, ["B"], info)
    )
    picked = spark.createDataFrame(
        [("Biomass", "A"), ("Predation and Fisheries", "B"), ("Fluxes", "B_A")], REGISTRY
    )
    files = store.export_series(kept, picked, f"{tmp_path}/out")
    assert files == ["Biomass.csv", "Predation_and_Fisheries.csv"]
    assert sorted(os.listdir(f"{tmp_path}/out")) == files
    back = spark.read.csv(f"{tmp_path}/out/Predation_and_Fisheries.csv", header=True)
    assert back.columns == ["Year", "Var", "Unit", "ID", "Predator", "Stat", "Value"]
    assert back.count() == 2 * 3 * 7
    biomass = spark.read.csv(f"{tmp_path}/out/Biomass.csv", header=True)
    assert {r["ID"] for r in biomass.collect()} == {"A"} and biomass.count() == 3 * 7
    # one file each, in order, written anew by a second export
    lines = open(f"{tmp_path}/out/Biomass.csv").read().splitlines()
    assert lines[0] == "Year,Var,Unit,ID,Stat,Value" and lines[1].startswith("1,Biomass,1000t,A,q0,")
    assert [line.split(",")[0] + line.split(",")[4] for line in lines[1:]] == [f"{y}{s}" for y in (1, 2, 3) for s in STATS]
    again = store.export_series(kept.filter("Var = 'Biomass'").withColumn("Value", F.lit(None).cast("double")), picked, f"{tmp_path}/out")
    assert again == ["Biomass.csv"] and sorted(os.listdir(f"{tmp_path}/out")) == files
    assert open(f"{tmp_path}/out/Biomass.csv").read().splitlines()[1] == "1,Biomass,1000t,A,q0,NA"

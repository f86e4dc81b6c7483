import pytest
from pyspark.sql import functions as F

from tests.conftest import CELLS, FLUXES, YEARS
from trophos.operators import mortality, ratios, series
from trophos.sources import model, trajectories


def wide_rows(chains=((1, (1, 2)),)):
    names = [f"{n}[{y}]" for n in CELLS for y in YEARS]
    rows, i = [], 0
    for chain, iters in chains:
        for it in iters:
            i += 1
            values = [None if v is None else v * i for n in CELLS for v in CELLS[n]]
            rows.append((chain, it, *values))
    schema = "chain int, iter bigint, " + ", ".join(f"`{n}` double" for n in names)
    return rows, schema


@pytest.fixture
def wide(spark):
    return spark.createDataFrame(*wide_rows())


def ids(df):
    return [(r["chain"], r["iter"], r["Sample_id"]) for r in df.orderBy("chain", "iter").collect()]


def test_even_chains(spark):
    rows, schema = wide_rows(((1, (10, 20, 30)), (2, (5, 6)), (4, (7,))))
    got = ids(trajectories.number_samples(spark.createDataFrame(rows, schema)))
    assert [g[2] for g in got] == [1, 2, 3, 4, 5, 6]


def test_uneven_iterations(spark):
    for iters in ((1, 2, 5), (1, 2, 3, 9), (0, 1, 4)):
        rows, schema = wide_rows(((1, iters), (2, (3, 4))))
        got = ids(trajectories.number_samples(spark.createDataFrame(rows, schema).repartition(4)))
        assert [g[2] for g in got] == list(range(1, len(iters) + 3))


def test_many_uneven_rows(spark):
    df = spark.range(5000).select(
        (F.col("id") % 3).cast("int").alias("chain"), (F.col("id") * F.col("id")).alias("iter"),
        F.lit(1.0).alias("A[1]"),
    )
    got = ids(trajectories.number_samples(df))
    assert [g[2] for g in got] == list(range(1, 5001))


def test_repeated_iteration_is_an_error(spark):
    rows, schema = wide_rows(((1, (1, 1)),))
    with pytest.raises(ValueError, match="identify"):
        trajectories.number_samples(spark.createDataFrame(rows, schema))


def test_read_one_path_or_one_per_chain(spark, tmp_path, wide):
    wide.write.parquet(f"{tmp_path}/all")
    one = trajectories.read_trajectories(spark, f"{tmp_path}/all")
    assert ids(one) == [(1, 1, 1), (1, 2, 2)]
    wide.drop("chain").write.csv(f"{tmp_path}/csv", header=True)
    two = trajectories.read_trajectories(spark, [f"{tmp_path}/csv"] * 2, "csv")
    assert ids(two) == [(1, 1, 1), (1, 2, 2), (2, 1, 3), (2, 2, 4)]
    assert dict(two.dtypes)["A[1]"] == "double"


def test_to_long(spark, wide, fluxes, long):
    melted = trajectories.to_long(trajectories.number_samples(wide), fluxes)
    assert melted.count() == 2 * len(CELLS) * len(YEARS)
    filled = melted.filter("value is not null")
    assert filled.exceptAll(long).isEmpty() and long.exceptAll(filled).isEmpty()


def test_melt_of_some_names_reads_their_columns(spark, tmp_path, wide, fluxes, capsys):
    wide.write.parquet(f"{tmp_path}/wide")
    numbered = trajectories.read_trajectories(spark, f"{tmp_path}/wide")
    some = trajectories.to_long(numbered, fluxes, ["A", "F01"])
    assert {r["Var"] for r in some.select("Var").distinct().collect()} == {"A", "B_A"}
    some.explain()
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<chain:int,iter:bigint,A[1]:double" in plan and "B[1]:double" not in plan
    with pytest.raises(ValueError, match="param not recognized"):
        trajectories.to_long(numbered, fluxes, ["Q"])


def test_trophic_is_passed_through(spark, wide, fluxes):
    flagged = fluxes.withColumn("Trophic", F.lit(1))
    melted = trajectories.to_long(trajectories.number_samples(wide), flagged)
    assert {(r["kind"], r["Trophic"]) for r in melted.select("kind", "Trophic").collect()} == {
        ("component", None), ("flux", 1),
    }


def test_thousands_of_columns(spark):
    cells = [F.lit(float(i)).alias(f"C{i // 50}[{i % 50}]") for i in range(3000)]
    wide = spark.range(4).select(F.lit(1).alias("chain"), F.col("id").alias("iter"), *cells)
    no_fluxes = spark.createDataFrame([], "Flux string, From string, To string")
    melted = trajectories.to_long(trajectories.number_samples(wide), no_fluxes)
    assert melted.count() == 12_000
    assert melted.filter("Var = 'C7' and Year = 3").agg(F.max("value")).first()[0] == 353.0


def test_long_round_trip(spark, tmp_path, long):
    trajectories.write_long(long, f"{tmp_path}/long")
    back = trajectories.read_long(spark, f"{tmp_path}/long")
    assert back.exceptAll(long).isEmpty() and back.count() == long.count()


def test_series_filter_reaches_the_scan(spark, tmp_path, long, capsys):
    trajectories.write_long(long, f"{tmp_path}/long")
    back = trajectories.read_long(spark, f"{tmp_path}/long")
    series.biomass_series(back, ["A"]).explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(kind" in plan and "(kind" in plan
    assert "EqualTo(Var,A)" in plan and "ReadSchema: struct<Var:string,Year:int,value:double>" in plan


def test_rates_read_only_the_rows_they_need(spark, tmp_path, long, capsys):
    trajectories.write_long(long, f"{tmp_path}/long")
    back = trajectories.read_long(spark, f"{tmp_path}/long")
    mortality.mortality_growth(back, ["A", "B"]).explain()
    plan = capsys.readouterr().out
    assert "PushedFilters: [Or(In(Var, [A,B]),In(src, [A,B]))]" in plan
    mortality.mortality_values(back, ["A", "B"]).explain()
    # Sums per sample, the look ahead.
    assert capsys.readouterr().out.count("Exchange") == 2


def test_selections_reach_the_scan_as_edge_names(spark, tmp_path, long, info, fluxes, capsys):
    trajectories.write_long(long, f"{tmp_path}/long")
    back = trajectories.read_long(spark, f"{tmp_path}/long")
    series.consumption_series(back, ["A", "FX"], info, names=["A"], fluxes=fluxes).explain()
    assert "In(Var, [A_FX,B_A,B_FX])" in capsys.readouterr().out
    ratios.consumption_biomass_ratio(back, ["A"], names=["A"], fluxes=fluxes).explain()
    assert "dst" not in capsys.readouterr().out.split("PushedFilters: ")[1].split("ReadSchema")[0]
    plain = series.consumption_series(back, ["A", "FX"], info)
    pruned = series.consumption_series(back, ["A", "FX"], info, fluxes=fluxes)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, pruned.collect()))


def test_unknown_names_are_an_error_for_every_caller(long, info, fluxes):
    for call in (
        lambda **k: series.biomass_series(long, ["Q"], **k),
        lambda **k: series.consumption_series(long, ["Q"], info, **k),
        lambda **k: series.predation_series(long, ["Q"], info, **k),
        lambda **k: series.flux_series(long, ["Q_Q"], **k),
        lambda **k: ratios.consumption_biomass_ratio(long, ["Q"], **k),
        lambda **k: ratios.production_biomass_ratio(long, ["Q"], **k),
        lambda **k: mortality.mortality_growth(long, ["Q"], **k),
    ):
        for known in ({}, {"names": ["A", "B", "B_A"]}):
            with pytest.raises(ValueError, match="param not recognized"):
                call(**known)


@pytest.mark.parametrize("chains", [1, 30_000])
def test_any_number_of_chains(spark, chains):
    """One path for every number: ids go on over the chains, each of an own length and step."""
    rows = spark.range(chains).select(F.col("id").cast("int").alias("chain"), F.expr("id % 3 + 1").alias("n"))
    rows = rows.select("chain", "n", F.explode(F.expr("sequence(1, n)")).alias("i"))
    iters = F.expr("100 + i * (1 + chain % 2)")
    wide = rows.select("chain", iters.alias("iter"), F.lit(1.0).alias("A[1]"))
    got = trajectories.number_samples(wide.repartition(5)).orderBy("Sample_id").select("chain", "iter", "Sample_id")
    expected = sorted((c, 100 + i * (1 + c % 2)) for c in range(chains) for i in range(1, c % 3 + 2))
    assert [tuple(r) for r in got.collect()] == [(*pair, i) for i, pair in enumerate(expected, 1)]


def test_every_chain_is_checked(spark):
    """A repeat, and a NULL, in the last of many chains."""
    chains = spark.range(20_050).select(F.col("id").cast("int").alias("chain"), F.lit(1).cast("long").alias("iter"), F.lit(1.0).alias("A[1]"))
    last = chains.filter("chain = 20049")
    for more in (last, last.withColumn("iter", F.lit(None).cast("long"))):
        with pytest.raises(ValueError, match="identify"):
            trajectories.number_samples(chains.unionByName(more))


def test_many_paths_are_one_scan(spark, tmp_path, capsys):
    """500 chains in files and folders with odd names; the order of the list counts."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    paths = []
    for i in range(500):
        path = tmp_path / f"chain {499 - i:03d} %41.parquet"
        table = pa.table({"iter": pa.array([1, 2]), "A[1]": [float(i), i + 0.5]})
        if i % 100 == 0:
            path.mkdir()
            pq.write_table(table, path / "part.parquet")
        else:
            pq.write_table(table, path)
        paths.append(str(path))
    wide = trajectories.read_trajectories(spark, paths)
    rows = wide.orderBy("Sample_id").select("chain", "iter", "`A[1]`").collect()
    assert [tuple(r) for r in rows] == [(i + 1, j, i + (j - 1) / 2) for i in range(500) for j in (1, 2)]
    wide.explain()
    assert capsys.readouterr().out.count("FileScan parquet [iter") == 1


def test_chain_without_a_column(spark, tmp_path):
    frames = {"a": [(1, 2.0, 3.0)], "b": [(1, 4.0)]}
    for name, rows in frames.items():
        columns = ["iter", "A[1]", "B[1]"][: len(rows[0])]
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}")
    wide = trajectories.read_trajectories(spark, [f"{tmp_path}/{n}" for n in "ba"]).orderBy("Sample_id")
    assert [tuple(r) for r in wide.select("`A[1]`", "`B[1]`").collect()] == [(4.0, None), (2.0, 3.0)]
    with pytest.raises(ValueError):
        trajectories.read_trajectories(spark, [])


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_order_over_several_files(spark, tmp_path, fmt):
    """Palette colours follow files and rows, however the files are split and read."""
    from trophos.operators.metadata import reconcile_metadata

    names = [f"C{i * 37 % 1000:03d}" for i in range(1000)]
    for k in range(4):
        part = spark.createDataFrame([(n, 1) for n in names[250 * k : 250 * k + 250]], "Component string, Inside int")
        part.coalesce(1).write.format(fmt).option("header", True).save(f"{tmp_path}/components/k={k}")
    spark.createDataFrame(FLUXES, "Flux string, From string, To string").write.format(fmt).option("header", True).save(f"{tmp_path}/fluxes")
    empty = spark.createDataFrame([], "ID string, FullName string, Colour string")
    key, found = "spark.sql.files.maxPartitionBytes", []
    for size in ("128m", "600", "2000"):
        spark.conf.set(key, size)
        try:
            components, _ = model.read_model(spark, str(tmp_path), fmt)
            assert [r["Component"] for r in components.orderBy("Ord").collect()] == names
            found.append(sorted(map(tuple, reconcile_metadata(empty, model.dimension(components)).collect())))
        finally:
            spark.conf.unset(key)
    assert found[0] == found[1] == found[2]


def test_dimension_of_any_size(spark):
    for n in (0, 3, 30_000):
        table = model.dimension(spark.range(n).select(F.col("id").cast("string").alias("ID")))
        assert table.count() == n and table.columns == ["ID"]


def scanned_rows(df):
    """Rows that the file scans of a query gave, after row groups and pages were skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    seen, todo = 0, [plan.executedPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan]
    while todo:
        node = todo.pop()
        if "QueryStage" in node.getClass().getSimpleName():
            node = node.plan()
        if "FileSourceScan" in node.getClass().getSimpleName():
            seen += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return seen


def test_forty_edges_do_not_read_the_others(spark, tmp_path):
    """The edges of one predator lie all over the names; more than ten reach Parquet one by one."""
    edges = [(f"X{i}", f"P{i // 40:03d}", f"Q{i % 40:02d}") for i in range(8_000)]
    fluxes = spark.createDataFrame(edges, "Flux string, From string, To string")
    rows = spark.createDataFrame([(f"{f}_{t}", f, t) for _, f, t in edges], "Var string, src string, dst string")
    long = rows.crossJoin(spark.range(1, 26).withColumnRenamed("id", "Sample_id")).select(
        "Sample_id", F.lit("flux").alias("kind"), "Var", "src", "dst", F.lit(1).alias("Year"),
        F.lit(1.0).alias("value"), F.lit(None).cast("int").alias("Trophic"),
    )
    key = "parquet.page.row.count.limit"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set(key, "500")
    try:
        trajectories.write_long(long.coalesce(1), f"{tmp_path}/long")
    finally:
        conf.unset(key)
    back = trajectories.read_long(spark, f"{tmp_path}/long")
    chosen = [f"Q{i:02d}" for i in (7,)]
    info = spark.createDataFrame([], "ID string, FullName string, Colour string")
    some = fluxes.filter(F.col("From") < "P040")
    few = series.consumption_values(back, chosen, info, fluxes=some)
    assert few.count() == 40 * 25
    assert scanned_rows(few) < 40 * 25 * 25 < long.count() / 4


def test_chains_with_another_header_or_short_rows_are_refused(spark, tmp_path):
    for name, bad in (("order", "chain,iter,B[1],A[1]\n2,1,5,6\n"), ("short", "chain,iter,A[1],B[1]\n2,1,5\n")):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "a.csv").write_text("chain,iter,A[1],B[1]\n1,1,3,4\n")
        (folder / "b.csv").write_text(bad)
        with pytest.raises(Exception, match="MALFORMED|CSV header"):
            trajectories.read_trajectories(spark, str(folder), "csv").collect()


def test_bucketed_table_sums_without_shuffle(spark, long, capsys):
    table = trajectories.save_long_table(long, "bucketed_long", 4)
    mortality.mortality_values(table, ["A", "B"], True, "AB").explain()
    assert "Exchange" not in capsys.readouterr().out


def model_tables(spark, wide, components, fluxes):
    return {
        "mcmc": wide, "components_param": components, "species": None, "fluxes_def": fluxes, "ntstep": 3,
    }


def test_valid_model(spark, wide, components, fluxes):
    tables = model_tables(spark, wide, components, fluxes)
    assert model.is_valid(tables) and model.first_failure(tables) is None


@pytest.mark.parametrize("name", ["mcmc", "components_param", "species", "fluxes_def", "ntstep"])
def test_missing_table(spark, wide, components, fluxes, name):
    tables = model_tables(spark, wide, components, fluxes)
    del tables[name]
    assert not model.is_valid(tables) and name in model.first_failure(tables)


def test_faulty_tables(spark, wide, components, fluxes):
    good = model_tables(spark, wide, components, fluxes)
    faults = {
        "Component occurs": {"components_param": components.union(components)},
        "Flux occurs": {"fluxes_def": fluxes.union(fluxes)},
        "Inside": {"components_param": components.drop("Inside")},
        "From": {"fluxes_def": fluxes.drop("From")},
        "[<year>]": {"mcmc": wide.withColumn("odd", F.lit(1.0))},
        "chain and iter": {"mcmc": wide.drop("iter")},
    }
    for message, change in faults.items():
        assert message in model.first_failure({**good, **change})


def test_read_model(spark, tmp_path, components, fluxes):
    # Y and Trophic are optional; X has no value for one component; extra columns are ignored.
    placed = components.withColumns({"X": F.when(F.col("Inside") == 1, 0.5), "more": F.lit("x")})
    placed.coalesce(1).write.csv(f"{tmp_path}/components", header=True, nullValue="NA")
    fluxes.coalesce(1).write.csv(f"{tmp_path}/fluxes", header=True)
    c, f = model.read_model(spark, str(tmp_path), "csv")
    assert c.columns == ["Component", "Inside", "X", "Y", "Ord"]
    assert [(r["X"], r["Y"]) for r in c.orderBy("Ord").collect()] == [(0.5, None), (0.5, None), (None, None)]
    assert f.select("Trophic").distinct().collect() == [(None,)]
    assert [r["Component"] for r in c.orderBy("Ord").collect()] == ["A", "B", "FX"]
    assert [(r["Flux"], r["From"], r["To"]) for r in f.orderBy("Ord").collect()] == FLUXES
    fluxes.drop("To").coalesce(1).write.mode("overwrite").csv(f"{tmp_path}/fluxes", header=True)
    assert "To" not in model.read_model(spark, str(tmp_path), "csv")[1].columns

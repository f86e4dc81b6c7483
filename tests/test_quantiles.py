import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from trophos.functions import quantiles
from trophos.functions.quantiles import PROBS, STATS, quantile_summary, quantiles_long, vector_quantiles
from trophos.functions.sketches import merge_states, sketch_state, state_quantiles


def by_percentile(df, keys):
    """The same numbers from the built-in aggregate, which holds a group in one task."""
    v = F.when(~F.isnan("value"), F.col("value"))
    q = df.groupBy(*keys).agg(F.percentile(v, F.array(*map(F.lit, PROBS))).alias("q"))
    return q.select(*keys, *[F.col("q")[i].alias(s) for i, s in enumerate(STATS)]).orderBy(*keys).toPandas()


def same(df, keys, methods=("sort", "bins")):
    expected = by_percentile(df, keys)
    for method in methods:
        found = quantile_summary(df, keys, method=method).orderBy(*keys).toPandas()
        pd.testing.assert_frame_equal(expected, found, check_exact=True)


def test_matches_numpy(spark):
    x = np.random.default_rng(0).lognormal(size=501)
    row = quantile_summary(spark.createDataFrame(pd.DataFrame({"k": 1, "value": x})), ["k"]).first()
    assert [row[s] for s in STATS] == pytest.approx(list(np.quantile(x, PROBS)), rel=1e-12)


def skewed(spark, n):
    """Long tails, a third of all rows tied, infinities, a NULL key, one hot key."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 > 0, F.lit(0)).when(F.col("id") % 2 == 0, (F.col("id") % 5).cast("int")).alias("k"),
        F.when(F.rand(1) < 0.3, 0.0).when(F.rand(2) < 0.01, 1e15 * F.rand(3))
        .when(F.rand(4) < 0.001, -F.lit(float("inf"))).when(F.rand(5) < 0.001, float("inf"))
        .otherwise(F.exp(6 * F.randn(6)) * F.signum(F.randn(7))).alias("value"),
    )


@pytest.mark.parametrize("n", [1, 300, 20_000])
def test_equals_percentile(spark, n):
    same(skewed(spark, n).cache(), ["k"])


@pytest.mark.parametrize("steps", [1, 16])
def test_any_bins_will_do(spark, monkeypatch, steps):
    monkeypatch.setattr(quantiles, "STEPS", steps)
    same(skewed(spark, 3000).cache(), ["k"], ["bins"])


def test_without_broadcasts(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        same(skewed(spark, 3000).cache(), ["k"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_reaches_the_ends_of_the_doubles(spark):
    xs = [5e-324, 1e-300, 0.0, -0.0, -0.5, 1.7e308, -1.7e308, 3.0, 3.0000000000000004, 8.0, 7.999999999999999, 1e-5] * 3
    same(spark.createDataFrame([(1, x) for x in xs], "k int, value double"), ["k"])


def test_bins_rise_with_the_values(spark):
    powers = 2.0 ** np.arange(-1074, 1024)
    xs = np.concatenate([powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf), 1.5 * powers[:-1], [np.inf]])
    xs = np.unique(np.concatenate([xs, -xs]))
    df = spark.createDataFrame(pd.DataFrame({"v": xs})).select("v", F.expr(quantiles._bin("v")).alias("bin"))
    bins = df.orderBy("v").toPandas()["bin"]
    assert (bins.diff().dropna() >= 0).all()


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e9, 1e9), min_size=1, max_size=40))
def test_quantiles_are_ordered(spark, xs):
    df = spark.createDataFrame([(1, x) for x in xs], "k int, value double")
    row = quantile_summary(df, ["k"]).toPandas()[list(STATS)].iloc[0].to_numpy()
    slack = 1e-9 * max(1.0, np.abs(row).max())
    assert (np.diff(row) >= -slack).all()
    np.testing.assert_array_equal(row, by_percentile(df, ["k"])[list(STATS)].iloc[0].to_numpy())


@pytest.mark.parametrize("method", ["sort", "bins"])
def test_missing_values(spark, method):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0), (1, None), (1, nan), (2, nan)], "k int, value double")
    kept = quantile_summary(df, ["k"], na="drop", method=method).orderBy("k").collect()
    assert kept[0]["q50"] == 1.0 and kept[1]["q50"] is None
    with pytest.raises(SparkRuntimeException, match="missing values"):
        quantile_summary(df, ["k"], method=method).collect()
    with pytest.raises(ValueError, match="method"):
        quantile_summary(df, ["k"], method="guess")


def test_long_form_keeps_empty_groups(spark):
    df = spark.createDataFrame([(1, "a", None)], "Year int, ID string, value double")
    summary = quantile_summary(df, ["Year", "ID"], na="drop")
    rows = quantiles_long(summary, ["Year", "ID"], "V", "u").collect()
    assert [r["Stat"] for r in rows] == list(STATS) and {r["Value"] for r in rows} == {None}


def final_plan(df, capsys):
    """The plan that ran, after the adaptive steps."""
    df.collect()
    capsys.readouterr()
    df.explain()
    plan = capsys.readouterr().out
    return plan.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("method", ["sort", "bins"])
def test_the_input_is_evaluated_once(spark, capsys, tmp_path, method):
    rows = spark.range(5_000).select((F.col("id") % 7).alias("k"), F.rand(1).alias("value"))
    rows.write.parquet(str(tmp_path / "rows"))
    plan = final_plan(quantile_summary(spark.read.parquet(str(tmp_path / "rows")), ["k"], method=method), capsys)
    assert plan.count("FileScan") == 1 and "BatchEvalPython" not in plan
    if method == "sort":
        assert plan.count(" Exchange hashpartitioning") == 1


def test_ties_are_combined_before_they_move(spark, capsys):
    df = spark.range(100_000).select(F.lit(1).alias("k"), F.rand(1).alias("value"))
    quantile_summary(df, ["k"], method="bins").explain()
    plan = capsys.readouterr().out
    assert "partial_count" in plan and "percentile" not in plan


@pytest.mark.parametrize("method", ["sort", "bins"])
def test_large_groups(spark, method):
    """100 groups of 20,000 values, one of 200,000; the built-in aggregate holds each in memory."""
    k = F.when(F.col("id") < 200_000, 0).otherwise(F.col("id") % 100)
    df = spark.range(2_200_000).select(k.cast("int").alias("k"), F.exp(2 * F.randn(3)).alias("value"))
    same(df, ["k"], [method])


@pytest.mark.parametrize("method", ["sort", "bins"])
def test_several_columns_at_once(spark, capsys, method):
    df = skewed(spark, 600).withColumn("other", F.rand(9)).withColumnRenamed("value", "a").cache()
    both = vector_quantiles(df, ["k"], ["a", "other"], method)
    for i, column in enumerate(("a", "other")):
        one = quantile_summary(df.withColumnRenamed(column, "value"), ["k"], na="drop").orderBy("k").collect()
        own = both.filter(F.col("measure") == i).orderBy("k").collect()
        assert [tuple(r)[1:] for r in one] == [tuple(r["q"]) for r in own]
    if method == "sort":
        assert final_plan(both, capsys).count(" Exchange hashpartitioning") == 1


def rank_errors(df, states, k):
    """How far, in parts of the rows, each quantile's ranks are from where they should be."""
    found = {r["k"]: r["q"] for r in state_quantiles(states, ["k"], PROBS).collect()}
    out = []
    for key, rows in df.toPandas().groupby("k", dropna=False):
        x = np.sort(rows["value"].dropna().to_numpy())
        q = found[None if pd.isna(key) else key]
        low, high = np.searchsorted(x, q, "left") / len(x), np.searchsorted(x, q, "right") / len(x)
        out += list(np.maximum(0, np.maximum(low - PROBS, PROBS - high)))
    return max(out)


@pytest.mark.parametrize("k, bound", [(200, 0.025), (2000, 0.004)])
def test_sketches_keep_to_their_rank_error(spark, k, bound):
    """Skew, ties of a third of the rows, a hot key; of one state and of merged ones."""
    df = skewed(spark, 60_000).cache()
    assert rank_errors(df, sketch_state(df, ["k"], k=k), k) <= bound
    parts = [sketch_state(df.filter(F.pmod(F.xxhash64("value"), F.lit(7)) == i), ["k"], k=k) for i in range(7)]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    merged = merge_states(stacked, ["k"], k)
    assert rank_errors(df, merged, k) <= 1.5 * bound
    sizes = [r[0] for r in merged.select(F.length("sketch")).collect()]
    assert max(sizes) < 40 * k + 4000


def test_sketch_of_groups_without_values(spark):
    df = spark.createDataFrame([(1, None), (2, 1.5), (2, float("nan"))], "k int, value double")
    states = sketch_state(df, ["k"])
    merged = merge_states(states.unionByName(states), ["k"]).orderBy("k")
    assert [(r["missing"], r["n"]) for r in merged.collect()] == [(2, 0), (2, 2)]
    kept = quantile_summary(df, ["k"], na="drop", method="sketch").orderBy("k").collect()
    assert kept[0]["q50"] is None and [kept[1][s] for s in STATS] == [1.5] * 7
    with pytest.raises(SparkRuntimeException, match="missing values"):
        quantile_summary(df, ["k"], method="sketch").collect()


def test_sorting_deals_the_groups_to_many_tasks_and_sorts_once(spark):
    rows = spark.range(7000).selectExpr("id % 350 as k", "rand(1) as value", "rand(2) as other")
    for found in (quantile_summary(rows, ["k"]), vector_quantiles(rows, ["k"], ["value", "other"])):
        assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 20
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Sort [") == plan.count("Window [") == 1

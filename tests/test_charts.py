import numpy as np
import pytest
from pyspark.sql import functions as F

from trophos.functions.beta import beta_cdf, beta_quantile
from trophos.operators import charts, mortality, series


def test_cdf_closed_form():
    x = np.linspace(0, 1, 401)
    assert np.abs(beta_cdf(x, 2, 3) - (6 * x**2 - 8 * x**3 + 3 * x**4)).max() < 1e-14
    assert np.abs(beta_cdf(x, 1, 1) - x).max() < 1e-14
    arcsine = 2 / np.pi * np.arcsin(np.sqrt(x))
    assert np.abs(beta_cdf(x, 0.5, 0.5) - arcsine).max() < 1e-13


@pytest.mark.parametrize("a,b", [(3e6, 7e6), (1e-8, 1e-8), (1e-8, 2.0), (250.0, 3.0), (0.01, 40.0)])
def test_cdf_of_extreme_shapes(a, b):
    x = np.linspace(0.0005, 0.9995, 1000)
    f = beta_cdf(x, a, b)
    assert np.isfinite(f).all() and (np.diff(f) >= -1e-10).all() and f.min() >= 0 and f.max() <= 1
    assert np.abs(f + beta_cdf(1 - x, b, a) - 1).max() < 1e-9


def test_cdf_against_integration():
    a, b = 6.0, 14.0
    grid = np.linspace(0, 1, 2_000_001)
    density = grid ** (a - 1) * (1 - grid) ** (b - 1)
    total = np.cumsum((density[1:] + density[:-1]) / 2)
    assert beta_cdf(0.3, a, b) == pytest.approx(total[600_000 - 1] / total[-1], abs=1e-9)
    q = beta_quantile(np.array([0.05, 0.95]), a, b)
    assert beta_cdf(q, a, b) == pytest.approx([0.05, 0.95], abs=1e-12)


def test_sample_lines(long):
    values = series.biomass_values(long, ["A"])
    lines = charts.trajectory_sample(values, [2, 1]).orderBy("Year").collect()
    assert [(r["Year"], r["S1"], r["S2"]) for r in lines] == [(1, 200, 100), (2, 160, 80), (3, 120, 60)]
    ids = charts.pick_samples(10**12, 3, seed=1)
    assert ids == charts.pick_samples(10**12, 3, seed=1) and len(set(ids)) == 3
    assert charts.pick_samples(3, 3) == [1, 2, 3]


def test_proportions(long, info):
    flows = series.predation_values(long, ["A", "B"], info)
    means = charts.mean_by_target(flows, ["Year", "ID", "target"])
    shares = charts.proportion_by_year(means, ["ID"])
    got = {r["target"]: r["proportion"] for r in shares.filter("ID = 'B' and Year = 1").collect()}
    assert got == pytest.approx({"Alpha": 0.4, "Fleet": 0.6})
    totals = shares.groupBy("ID", "Year").agg(F.sum("proportion").alias("s")).collect()
    assert len(totals) == 4 and all(r["s"] == pytest.approx(1) for r in totals)


def rates(spark, values):
    return spark.createDataFrame([(1, "A", float(x), 1.0) for x in values], "Year int, ID string, F double, M double")


def test_fit(spark):
    spread = 0.1 / np.sqrt(2)
    row = charts.beta_params(rates(spark, [0.3 - spread, 0.3 + spread])).first()
    assert (row["mean"], row["var"]) == pytest.approx((0.3, 0.01))
    assert (row["a"], row["b"]) == pytest.approx((6, 14))
    half = charts.beta_params(rates(spark, [1.0, 3.0]), share=True).first()
    assert half["mean"] == pytest.approx((0.5 + 0.75) / 2)


def test_bands(spark):
    spread = 0.1 / np.sqrt(2)
    params = charts.beta_params(rates(spark, [0.3 - spread, 0.3 + spread, float("nan")]))
    bands = charts.beta_bands(params).orderBy("y0").toPandas()
    assert len(bands) == 1000 and np.abs(bands.bottom + bands.top - 1).max() < 1e-12
    assert bands.top.is_monotonic_increasing and bands.mean_F[0] == pytest.approx(0.3)
    mid = (bands.y0 + bands.y1) / 2
    assert np.abs(bands.top - beta_cdf(mid.to_numpy(), 6, 14)).max() < 1e-9
    assert bands.q05[0] == pytest.approx(float(beta_quantile(0.05, 6, 14)), abs=1e-9)


@pytest.mark.parametrize("x,expected", [(0.0, (0, 1, 0, 0)), (1.0, (1, 0, 1, 1)), (2.5, (1, 0, 1, 1))])
def test_flat_bands(spark, x, expected):
    bands = charts.beta_bands(charts.beta_params(rates(spark, [x, x])), k=4).collect()
    assert {(r["bottom"], r["top"], r["mean_F"], r["q05"]) for r in bands} == {expected}


def test_one_sample_has_no_band(spark):
    bands = charts.beta_bands(charts.beta_params(rates(spark, [0.4])), k=2).collect()
    assert [(r["bottom"], r["top"], r["q95"]) for r in bands] == [(None, None, None)] * 2


def test_bands_of_mortality(long):
    values = mortality.mortality_values(long, ["A", "B"], True, "AB")
    bands = charts.beta_bands(charts.beta_params(values, share=True), k=10)
    assert bands.count() == 20 and bands.filter("abs(bottom + top - 1) > 1e-12").isEmpty()


def test_drawn_samples_exist_and_are_shared(spark):
    """Gaps in the ids, any partitioning, fewer ids than wanted."""
    ids = [3, 8, 21, 500, 7_000_000_000]
    long = spark.createDataFrame([(i, y, float(i * y)) for i in ids for y in (1, 2)], "Sample_id long, Year int, value double")
    long = long.withColumn("ID", F.lit("A"))
    first = [tuple(r) for r in charts.draw_samples(long, 3, seed=1).collect()]
    again = [tuple(r) for r in charts.draw_samples(long.repartition(7), 3, seed=1).collect()]
    assert sorted(first) == sorted(again) and len(first) == 3 and {i for i, _ in first} <= set(ids)
    assert sorted(slot for _, slot in first) == [1, 2, 3] and sorted(first) == sorted(first, key=lambda r: r[1])
    draws = {tuple(sorted(r["Sample_id"] for r in charts.draw_samples(long, 3, seed=s).collect())) for s in range(6)}
    assert len(draws) > 1
    drawn = charts.draw_samples(long, 9)
    few = charts.only_samples(long, charts.draw_samples(long, 2))
    assert few.count() == 4 and few.columns == long.columns
    lines = charts.sampled_lines(long, drawn, 9).filter("Year = 2").first()
    assert [lines[f"S{i}"] for i in range(1, 10)] == [2.0 * i for i in ids] + [None] * 4


def test_beta_quantiles_by_few_evaluations(monkeypatch):
    """The digits of 60 bisections, by about a third of the evaluations and less."""
    from trophos.functions import beta

    seen, plain = [0], beta.beta_cdf

    def counted(x, a, b):
        seen[0] += np.broadcast(x, a, b).size
        return plain(x, a, b)

    rng = np.random.default_rng(0)
    a, b = np.exp(rng.uniform(-3, 7, (2, 300)))
    monkeypatch.setattr(beta, "beta_cdf", counted)
    for p in (0.05, 0.5, 0.95):
        low, high = np.zeros(300), np.ones(300)
        for _ in range(60):
            middle = (low + high) / 2
            right = plain(middle, a, b) < p
            low, high = np.where(right, middle, low), np.where(right, high, middle)
        seen[0] = 0
        assert np.abs(beta.beta_quantile(p, a, b) - (low + high) / 2).max() < 1e-13
        assert seen[0] / 300 < 20
    assert beta.beta_quantile(0.5, 2.0, 2.0) == pytest.approx(0.5, abs=1e-15)

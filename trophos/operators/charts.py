"""Frames behind the charts: sample lines, proportions and fuzzy bands."""

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trophos.functions.beta import cdf_at_midpoints, quantile_of
from trophos.functions.numeric import ieee_div, known, strict_mean

# Fixed value: below it a mean counts as 0 (or 1), and the floor of the fit.
EPS = 1e-8


def pick_samples(last_id: int, n: int = 3, seed: int | None = None) -> list[int]:
    """``n`` different sample ids from ``1 … last_id``, in increasing order."""
    return sorted(random.Random(seed).sample(range(1, last_id + 1), n))


def trajectory_sample(
    values: DataFrame, ids: Sequence[int], keys: Sequence[str] = ("Year", "ID"), value: str = "value"
) -> DataFrame:
    """The values of the given samples as columns ``S1, S2, …`` per group.

    The filter is on ``Sample_id``, a grouping key of every series, so it
    reaches the scan and only these samples are summed.
    """
    chosen = values.filter(F.col("Sample_id").isin(list(ids)))
    lines = [
        F.max(F.when(F.col("Sample_id") == i, F.col(value))).alias(f"S{slot}")
        for slot, i in enumerate(ids, 1)
    ]
    return chosen.groupBy(*keys).agg(*lines)


def draw_samples(long: DataFrame, n: int = 3, seed: int = 0) -> DataFrame:
    """``Sample_id, slot`` of ``n`` random samples among those that exist, numbered in their order.

    The draw takes the ids with the least hashes of seed and id: the same seed
    gives the same samples whatever the partitioning, and only ``n`` ids are
    gathered.  All series of a call share one draw.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("Sample_id").cast("string")))
    ids = long.select("Sample_id").distinct().orderBy(key, "Sample_id").limit(n)
    return ids.select("Sample_id", F.row_number().over(Window.orderBy("Sample_id")).alias("slot"))


def only_samples(long: DataFrame, drawn: DataFrame) -> DataFrame:
    """The long rows of drawn samples, from which any series is computed for them alone."""
    # as many rows as samples were drawn
    return long.join(F.broadcast(drawn.select("Sample_id")), "Sample_id", "left_semi")


def sampled_lines(
    values: DataFrame, drawn: DataFrame, n: int, keys: Sequence[str] = ("Year", "ID"), value: str = "value"
) -> DataFrame:
    """The values of drawn samples as columns ``S1 … Sn`` per group, NULL where a slot has none."""
    rows = values.join(F.broadcast(drawn), "Sample_id")
    lines = [F.max(F.when(F.col("slot") == i, F.col(value))).alias(f"S{i}") for i in range(1, n + 1)]
    return rows.groupBy(*keys).agg(*lines)


def mean_by_target(values: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean over the samples per group; missing when any sample is."""
    return values.groupBy(*keys).agg(strict_mean(F.col(value)).alias("value"))


def proportion_by_year(means: DataFrame, chart_keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``proportion``: the share of ``value`` in its chart and year."""
    total = F.sum(known(F.col("value"))).over(Window.partitionBy(*chart_keys, "Year"))
    return means.withColumn("proportion", ieee_div(F.col("value"), total))


def beta_params(
    rates: DataFrame, keys: Sequence[str] = ("Year", "ID"), col: str = "F", share: bool = False
) -> DataFrame:
    """Moment fit of a Beta distribution per group: ``mean, var, a, b``.

    ``share=True`` fits the proportion F/(F+M) in place of the rate ``col``.
    ``a`` and ``b`` are NULL where the mean is 0 or 1 up to ``EPS``, or where
    there is no variance (one sample).
    """
    x = F.col(col)
    if share:
        both = F.col("F") + F.col("M")
        x = F.when(both != 0, F.col("F") / both)
    moments = rates.groupBy(*keys).agg(
        F.avg(known(x)).alias("mean"), F.var_samp(known(x)).alias("var")
    )
    m, v, eps = F.col("mean"), F.col("var"), F.lit(EPS)
    inner = (m > EPS) & (m < 1 - EPS) & v.isNotNull()
    t = F.greatest(F.greatest(m * (1 - m), eps) / F.greatest(v, eps) - 1, eps)
    return moments.select(
        *keys,
        "mean",
        "var",
        F.when(inner, F.greatest(m * t, eps)).alias("a"),
        F.when(inner, F.greatest((1 - m) * t, eps)).alias("b"),
    )


def beta_bands(params: DataFrame, keys: Sequence[str] = ("Year", "ID"), k: int = 1000) -> DataFrame:
    """``k`` bins of [0, 1] per group with the probabilities of the two bands,
    and per group the fitted mean and its 5 % and 95 % quantiles."""
    a, b, m = F.col("a"), F.col("b"), F.col("mean")

    def unless_flat(fit: Column, at0: float, at1: float) -> Column:
        return F.when(m <= EPS, F.lit(at0)).when(m >= 1 - EPS, F.lit(at1)).otherwise(fit)

    fitted = params.select(
        *keys,
        m.alias("mean"),
        unless_flat(a / (a + b), 0.0, 1.0).alias("mean_F"),
        cdf_at_midpoints(k)(a, b).alias("cdf"),
        quantile_of(0.05)(a, b).alias("fit05"),
        quantile_of(0.95)(a, b).alias("fit95"),
    )
    bins = fitted.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    below = F.get(F.col("cdf"), F.col("bin"))
    return bins.select(
        *keys,
        (F.col("bin") / F.lit(float(k))).alias("y0"),
        ((F.col("bin") + 1) / F.lit(float(k))).alias("y1"),
        unless_flat(1 - below, 0.0, 1.0).alias("bottom"),
        unless_flat(below, 1.0, 0.0).alias("top"),
        "mean_F",
        unless_flat(F.col("fit05"), 0.0, 1.0).alias("q05"),
        unless_flat(F.col("fit95"), 0.0, 1.0).alias("q95"),
    )

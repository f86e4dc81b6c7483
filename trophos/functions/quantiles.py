"""Seven-quantile summaries with linear interpolation between order statistics.

Exact, in one lazy plan that evaluates its input once.  ``method`` says how the
wanted ranks are found; both give the same numbers, and no size decides between
them:

``"sort"``  one shuffle by group; a task sorts the groups it gets, spilling to
    disk, and numbers their values.  The groups are dealt to ``SORT_TASKS``
    tasks, which hold a few each: meant for the series, whose groups (series and
    year) have one row per sample each.
``"bins"``  ties are counted on the map side and dealt by group and value bin;
    running sums of the bins' counts say which few bins hold a wanted rank, and
    only their values are sorted.  No task sees a whole group, so one group with
    a third of all rows is as good as many.  Some three times the fixed cost.
``"sketch"``  not exact, see ``trophos.functions.sketches``.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trophos.functions.numeric import known
from trophos.functions.sketches import sketch_state, state_quantiles

# Probabilities and the names of their quantiles.
PROBS = (0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0)
STATS = ("q0", "q2.5", "q25", "q50", "q75", "q97.5", "q100")

# Tasks that sort.  A given number, since partitions that Spark may join are
# joined up to 64 MB of packed rows, which take some 26 times that when sorted.
SORT_TASKS = 32

# Bins between a number and its double; the bin of missing values.
STEPS, MISSING = 64, -(1 << 62)


def quantile_summary(
    values: DataFrame, keys: Sequence[str], value: str = "value", *, na: str = "raise", method: str = "sort"
) -> DataFrame:
    """``keys`` plus ``q0 … q100`` of ``value`` per group.

    ``na='raise'`` fails on NULL or NaN values, ``na='drop'`` ignores them.
    """
    return spread(grouped_quantiles(values, keys, value, method), keys, na)


def grouped_quantiles(
    values: DataFrame, keys: Sequence[str], value: str = "value", method: str = "sort"
) -> DataFrame:
    """``keys``, ``missing`` (NULL/NaN count) and the quantile array ``q``."""
    rows = values.select(F.struct(*keys).alias("k"), known(F.col(value).cast("double")).alias("v"))
    cells = _dealt(rows, method).select("k", F.lit(0).alias("m"), "v")
    return _method(method)(cells).select("k.*", "missing", "q")


def vector_quantiles(
    values: DataFrame, keys: Sequence[str], columns: Sequence[str], method: str = "sort"
) -> DataFrame:
    """``keys``, ``measure`` (the place of a column in ``columns``), ``missing`` and ``q``, for several columns at once.

    Rows go to the tasks of their group as they are, all columns in one, and are
    taken apart there.
    """
    vector = F.array(*[known(F.col(c).cast("double")) for c in columns])
    rows = values.select(F.struct(*keys).alias("k"), vector.alias("vector"))
    cells = _dealt(rows, method).select("k", F.posexplode("vector").alias("m", "v"))
    return _method(method)(cells).select("k.*", F.col("m").alias("measure"), "missing", "q")


def _method(name: str):
    if name not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    return METHODS[name]


def _dealt(rows: DataFrame, method: str) -> DataFrame:
    return rows.repartition(SORT_TASKS, "k") if method == "sort" else rows


def _by_sorting(cells: DataFrame) -> DataFrame:
    # missing values come last: they change no rank
    group = "over (partition by k, m order by v nulls last"
    # counts in the same order, so that the rows are sorted and held once
    whole = f"{group} rows between unbounded preceding and unbounded following)"
    ranked = cells.selectExpr(
        "k", "m", "v", f"count(v) {whole} as total", f"count(*) {whole} as rows", f"row_number() {group}) - 1 as first"
    )
    held = " or ".join(f"first = {r}" for r in _RANKS)
    found = ranked.filter(f"(first < total and ({held})) or (total = 0 and first = 0)")
    return _interpolated(found.selectExpr("k", "m", "total", "rows - total as missing", "first", "1L as n", "v"))


def _by_bins(cells: DataFrame) -> DataFrame:
    cells = cells.selectExpr("struct(k, m) as k", f"{_bin('v')} as bin", "v")
    ties = cells.groupBy("k", "bin", "v").agg(F.count("*").alias("n"))
    # the rest reads this one shuffle, twice
    ties = ties.repartition("k", "bin")
    bins = ties.groupBy("k", "bin").agg(F.sum("n").alias("rows"))
    real = f"sum(if(bin <> {MISSING}, rows, 0L)) over (partition by k"
    bins = bins.selectExpr(
        "k", "bin", "rows", f"{real}) as total",
        f"sum(if(bin = {MISSING}, rows, 0L)) over (partition by k) as missing",
        f"{real} order by bin) - if(bin <> {MISSING}, rows, 0L) as start",
    )
    held = " or ".join(f"({r} >= start and {r} < start + rows)" for r in _RANKS)
    holding = bins.filter(f"total = 0 or bin <> {MISSING} and ({held})").drop("rows")
    t, h = ties.alias("t"), holding.alias("h")
    inner = t.join(h, F.expr("t.k = h.k and t.bin = h.bin")).selectExpr(
        "t.k", "total", "missing", "start + sum(n) over (partition by t.k, t.bin order by v) - n as first", "n", "v"
    )
    held = " or ".join(f"({r} >= first and {r} < first + n)" for r in _RANKS)
    return _interpolated(inner.filter(f"total = 0 or {held}").select("k.*", "total", "missing", "first", "n", "v"))


def _interpolated(found: DataFrame) -> DataFrame:
    """From ``k, m, total, missing, first, n, v``: the values that hold the wanted ranks, ``n`` of each from ``first`` on."""
    ranks = f"filter(array({', '.join(_RANKS)}), r -> r >= first and r < first + n)"
    found = found.selectExpr("k", "m", "total", "missing", f"transform({ranks}, r -> struct(r, v)) as at")
    found = found.groupBy("k", "m").agg(
        F.max("total").alias("total"), F.max("missing").alias("missing"), F.flatten(F.collect_list("at")).alias("at")
    )
    found = found.selectExpr("k", "m", "total", "missing", "map_from_entries(array_distinct(at)) as at")
    q = f"if(total > 0, array({', '.join(map(_quantile, PROBS))}), null) as q"
    return found.selectExpr("k", "m", "missing", q)


def _position(p: float) -> str:
    return f"({p}D * cast(total - 1 as double))"


def _quantile(p: float) -> str:
    at = _position(p)
    low, high = f"at[floor({at})]", f"at[ceil({at})]"
    return f"if({low} = {high}, {low}, (ceil({at}) - {at}) * {low} + ({at} - floor({at})) * {high})"


# SQL of the ranks, from 0, that the quantiles lie at or between.
_RANKS = tuple(dict.fromkeys(f"{side}({_position(p)})" for p in PROBS for side in ("floor", "ceil")))


def _by_sketches(cells: DataFrame) -> DataFrame:
    return state_quantiles(sketch_state(cells, ["k", "m"], "v"), ["k", "m"], PROBS)


METHODS = {"sort": _by_sorting, "bins": _by_bins, "sketch": _by_sketches}


def _bin(v: str) -> str:
    """SQL of the number of a value's bin: any non-decreasing function is correct.

    The exponent and the first bits of the fraction; where ``log2`` rounds to
    the next exponent, the fraction makes up for it.
    """
    exponent = f"floor(log2(abs({v})))"
    place = f"floor(({exponent} - 1 + abs({v}) / pow(2.0D, {exponent})) * {STEPS})"
    place = f"(if(abs({v}) = double('infinity'), {2048 * STEPS}L, {place}) + {1100 * STEPS}L)"
    # never null, or the join by bin would filter the input of one of its sides
    return f"coalesce(case when {v} = 0 then 0L when {v} > 0 then {place} when {v} < 0 then -{place} end, {MISSING}L)"


def spread(quantiles: DataFrame, keys: Sequence[str], na: str = "raise") -> DataFrame:
    """Quantile array to columns, applying the missing-value policy."""
    if na not in ("raise", "drop"):
        raise ValueError("na must be 'raise' or 'drop'")
    q = F.col("q")
    if na == "raise":
        q = F.when(
            F.col("missing") > 0,
            F.raise_error(F.lit("missing values and NaN's not allowed in quantiles")),
        ).otherwise(q)
    out = quantiles.select(*keys, q.alias("q"))
    return out.select(*keys, *[F.col("q")[i].alias(s) for i, s in enumerate(STATS)])


def quantiles_long(
    summary: DataFrame, keys: Sequence[str], var: str, unit: str
) -> DataFrame:
    """One row per quantile: ``Year, Var, Unit, <other keys>, Stat, Value``.

    Groups without any value keep their seven NULL rows.
    """
    rows = summary.unpivot(list(keys), [f"`{s}`" for s in STATS], "Stat", "Value")
    others = [k for k in keys if k != "Year"]
    return rows.select(
        "Year", F.lit(var).alias("Var"), F.lit(unit).alias("Unit"), *others, "Stat", "Value"
    )

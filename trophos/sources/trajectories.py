"""Sampled trajectories: the wide matrix, its sample ids, and the long table."""

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from trophos.plans.scratch import Scratch
from trophos.schemas import LONG
from trophos.sources.model import CELL, local_table, value_columns


def read_trajectories(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet") -> DataFrame:
    """The wide matrix with ``Sample_id`` 1 … n over its stacked chains.

    One path holds all chains (columns ``chain, iter, "<name>[<year>]" …``);
    a list holds one chain per path, numbered in that order.  A list is one
    scan, in which a row's file tells its chain; a value column that only some
    Parquet chains have is missing in the others, CSV chains need one header.
    """
    if isinstance(path, str):
        return number_samples(_read(spark, path, fmt))
    if not path:
        raise ValueError("no chain to read")
    numbers = [(file, i) for i, p in enumerate(path, 1) for file in _files(spark, p)]
    # one row per file, which the driver has listed anyway
    chains = local_table(spark, numbers, "file string, chain int")
    file = F.regexp_replace("_metadata.file_path", "^file:///", "file:/").alias("_file")
    rows = _read(spark, list(dict.fromkeys(path)), fmt, file)
    rows = rows.drop("chain").join(F.broadcast(chains), F.col("_file") == F.col("file"))
    return number_samples(rows.drop("_file", "file"))


def _files(spark, path):
    """The files of a chain, as their rows name them; no file is opened."""
    return [re.sub("^file:///", "file:/", f) for f in spark.read.format("text").load(path).inputFiles()]


def _read(spark, path, fmt, *more):
    if fmt != "csv":
        # the chains of a list may have different columns; one path's files have the same
        merge = str(not isinstance(path, str)).lower()
        return spark.read.option("mergeSchema", merge).format(fmt).load(path).select("*", *more)
    # the header of every file must be that of the first; longer and shorter rows are errors
    text = StructType([StructField(c, StringType()) for c in spark.read.csv(path, header=True).columns])
    raw = spark.read.schema(text).csv(path, header=True, nullValue="NA", mode="FAILFAST", enforceSchema=False)
    types = {"chain": "int", "iter": "bigint"}
    casts = [f"cast({q} as {types.get(c, 'double')}) as {q}" for c in raw.columns for q in (_quoted(c),)]
    return raw.select(*map(F.expr, casts), *more)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def number_samples(wide: DataFrame) -> DataFrame:
    """Adds ``Sample_id``: contiguous from 1 in the order of (chain, iter).

    Evenly spaced iterations give the id by arithmetic from per-chain counts,
    without moving a row; the ids before each chain are a prefix sum over the
    chains, of which there may be any number.  Otherwise the (chain, iter) pairs
    alone are sorted by range over all tasks and their ids joined back.
    """
    scratch = Scratch(wide.sparkSession)
    ids = wide.select("chain", "iter")
    chains = ids.groupBy("chain").agg(
        F.count("*").alias("n"), F.count_distinct("iter").alias("distinct"),
        F.min("iter").alias("first"), F.max("iter").alias("last"),
    )
    gaps = F.greatest(F.col("n") - 1, F.lit(1))
    chains = scratch.keep(
        chains.select(
            "chain", "n", "first",
            # a NULL iter is not distinct from anything
            (F.col("chain").isNull() | (F.col("n") != F.col("distinct"))).alias("repeated"),
            ((F.col("last") - F.col("first")) % gaps != 0).alias("uneven"),
            F.greatest(F.expr("(last - first) div greatest(n - 1, 1)"), F.lit(1)).alias("step"),
        ),
        "chains",
    )
    seen = chains.agg(F.bool_or("repeated"), F.bool_or("uneven"), F.max("step")).first()
    if seen[0]:
        raise ValueError("chain and iter must identify each row")
    if seen[1]:
        return _ranked(wide, scratch)
    chains = running_total(chains, "chain", "n", "offset", scratch).select("chain", "first", "step", "offset")
    chains = scratch.keep(chains, "offsets")
    # n different integers within a range of n values leave no gap; wider steps
    # need a look at every iteration.
    if (seen[2] or 1) > 1:
        beside = (F.col("iter") - F.col("first")) % F.col("step") != 0
        if not ids.join(chains, "chain").filter(beside).isEmpty():
            return _ranked(wide, scratch)
    index = F.expr("(iter - first) div step")
    return (
        wide.join(chains, "chain")
        .withColumn("Sample_id", F.col("offset") + index + 1)
        .drop("first", "step", "offset")
    )


def running_total(table: DataFrame, order: str, value: str, name: str, scratch: Scratch) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before, by ``order``, which must be unique.

    The rows are sorted by range over all tasks; each sums its own, and one sum
    per sorted partition says what comes before it.
    """
    rows = _sorted(table, [order], scratch, f"{name}_sorted")
    parts = rows.groupBy("part").agg(F.sum(value).alias("sum"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("earlier"))
    own = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    rows = rows.join(parts, "part").withColumn(name, F.col("earlier") + F.col("own"))
    return rows.drop("part", "place", "earlier", "own")


def _sorted(rows, order, scratch, name):
    """``rows`` written in order, with the number of a row's sorted partition and its place in it."""
    # The id of a sorted row holds its partition (high bits) and its place in
    # it (low 33 bits).  It is written so that later reads see the same ids.
    ids = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ids = scratch.keep(ids, name)
    return ids.withColumns(
        {"part": F.shiftright("at", 33), "place": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))}
    ).drop("at")


def _ranked(wide, scratch):
    ids = _sorted(wide.select("chain", "iter"), ["chain", "iter"], scratch, "ids")
    # One row per sorted partition.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ids.groupBy("part").count().select(
        "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")
    )
    ids = ids.join(offsets, "part").select(
        "chain", "iter", (F.col("offset") + F.col("place") + 1).alias("Sample_id")
    )
    return wide.join(ids, ["chain", "iter"])


def to_long(wide: DataFrame, fluxes: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """One row per sample and value column, missing cells included.

    Names are parsed and matched with the fluxes once per column, not per row:
    the melted rows carry a column number that looks up its label.  With
    ``names`` (components and flux ids) only their columns are read.
    """
    spark = wide.sparkSession
    columns = value_columns(wide)
    if names is not None:
        wanted = set(names)
        columns = [c for c in columns if _name_and_year(c)[0] in wanted]
        if not columns:
            raise ValueError("param not recognized")
    parsed = [(i, *_name_and_year(c)) for i, c in enumerate(columns)]
    trophic = F.col("Trophic").cast("int") if "Trophic" in fluxes.columns else F.lit(None).cast("int")
    edges = fluxes.select("Flux", "From", "To", trophic.alias("Trophic"))
    names = local_table(spark, parsed, "pos int, name string, Year int")
    labels = names.join(edges, F.col("name") == F.col("Flux"), "left").select(
        "pos",
        F.when(F.col("Flux").isNull(), "component").otherwise("flux").alias("kind"),
        F.coalesce(F.concat("From", F.lit("_"), "To"), "name").alias("Var"),
        F.col("From").alias("src"),
        F.col("To").alias("dst"),
        "Year",
        "Trophic",
    )
    cells = F.expr(f"array({', '.join(map(_quoted, columns))})").cast("array<double>")
    melted = wide.select("Sample_id", F.posexplode(cells).alias("pos", "value"))
    # one row per column of the matrix, so the driver has its names already
    return melted.join(F.broadcast(labels), "pos").select(*LONG.names)


def _name_and_year(column):
    match = CELL.fullmatch(column)
    if not match:
        return None, None
    year = match[2].strip()
    return match[1], int(year) if re.fullmatch(r"-?\d+", year) else None


def write_long(long: DataFrame, path: str) -> None:
    """Parquet partitioned by ``kind`` and sorted by variable within each file.

    The rows are not shuffled: a file keeps the samples of its melted rows, so
    per-sample sums combine within a task, and the sort lets a scan skip the
    row groups of other variables.
    """
    long.sortWithinPartitions("kind", "Var", "Year", "Sample_id").write.mode(
        "overwrite"
    ).partitionBy("kind").parquet(path)


def read_long(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LONG).parquet(path).select(*LONG.names)


def save_long_table(long: DataFrame, table: str, buckets: int) -> DataFrame:
    """Catalog table bucketed by sample: grouping by sample, series and year,
    and the step to the next year, then need no shuffle."""
    long.write.mode("overwrite").bucketBy(buckets, "Sample_id").sortBy("Sample_id").saveAsTable(table)
    return long.sparkSession.table(table)

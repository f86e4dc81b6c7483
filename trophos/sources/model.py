"""Component and flux tables, and the checks of a model's tables."""

import re
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from trophos.plans.scratch import Scratch
from trophos.schemas import COMPONENTS, FLUXES

# Where a row stands: its file, the beginning of its split, and its number there.
# Splits and partitions number rows differently, but always in this order.
PLACE = ("_metadata.file_path", "_metadata.file_block_start")

# A wide column: <name>[<year>].
CELL = re.compile(r"(.*)\[(.*)\]", re.DOTALL)

# What a model must contain.
MODEL_TABLES = ("components_param", "species", "fluxes_def", "ntstep")
COMPONENT_COLUMNS = ("Component", "Inside")
FLUX_COLUMNS = ("Flux", "From", "To")
OPTIONAL = ("X", "Y", "Trophic")


def read_table(spark: SparkSession, path: str, fmt: str, schema: StructType) -> DataFrame:
    """The columns of ``schema`` that the table has, in their types, and NULL
    for optional ones it lacks, with the order of the rows in ``Ord``: files by
    name, and the order within each.  Malformed CSV rows are an error."""
    if fmt == "csv":
        types = {f.name: f.dataType for f in schema}
        found = spark.read.csv(path, header=True).columns
        own = StructType([StructField(c, types.get(c, StringType())) for c in found])
        df = spark.read.schema(own).csv(
            path, header=True, nullValue="NA", mode="FAILFAST", enforceSchema=False
        )
    else:
        df = spark.read.format(fmt).load(path)
    columns = []
    for f in schema:
        if f.name in df.columns:
            columns.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name in OPTIONAL:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
    place = F.struct(*map(F.col, PLACE), F.monotonically_increasing_id().alias("row"))
    return df.select(*columns, place.alias("Ord"))


def read_model(spark: SparkSession, path: str, fmt: str = "parquet"):
    """``(components, fluxes)`` of ``<path>/components`` and ``<path>/fluxes``,
    each of any number of files, with its row order in ``Ord``."""
    components = read_table(spark, f"{path}/components", fmt, COMPONENTS)
    return components, read_table(spark, f"{path}/fluxes", fmt, FLUXES)


def in_order(components: DataFrame) -> DataFrame:
    """Components with ``Ord``; by name when the table has no order."""
    if "Ord" in components.columns:
        return components
    return components.withColumn("Ord", F.col("Component"))


def dimension(df: DataFrame) -> DataFrame:
    """A model's table computed once, so that later plans read it and know its size.

    It is written to the shared folder, whatever its size; nothing of it goes
    through the driver.  Spark broadcasts it where it is below its own threshold.
    """
    return Scratch(df.sparkSession).keep(df, "dimension")


def flux_names(fluxes: DataFrame) -> DataFrame:
    """``Flux`` ids and the ``From_To`` names used in the long table."""
    return fluxes.select("Flux", F.concat("From", F.lit("_"), "To").alias("Component"))


def edge_names(selected, fluxes: DataFrame) -> list[str]:
    """``From_To`` names of the edges selected by flux id or by that name."""
    wanted = list(selected)
    names = flux_names(fluxes)
    found = names.filter(F.col("Flux").isin(wanted) | F.col("Component").isin(wanted))
    return sorted({r["Component"] for r in found.collect()})


def local_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """Rows of the driver as a local relation, whose size the optimizer knows
    (a plain ``createDataFrame`` of Python rows hides it)."""
    fields = [f.split()[0] for f in schema.split(",")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return spark.createDataFrame(pa.table([pa.array(c) for c in columns], names=fields), schema)


def validate_model(tables: Mapping[str, object]) -> DataFrame:
    """``position, check, ok, message`` of every structural and data check.

    ``tables`` may hold ``mcmc`` (the wide matrix), ``components_param``,
    ``fluxes_def`` as DataFrames, and ``species`` and ``ntstep``, of which only
    the presence counts.  Checks whose table is missing fail too.
    """
    frames = [t for t in tables.values() if isinstance(t, DataFrame)]
    spark = frames[0].sparkSession if frames else SparkSession.active()
    checks = [
        ("mcmc", "mcmc" in tables, "Missing the element mcmc"),
        ("mcmc columns", _has(tables, "mcmc", ("chain", "iter")),
         "The mcmc table needs the columns chain and iter"),
    ]
    checks += [(t, t in tables, f"Missing the element {t}") for t in MODEL_TABLES]
    checks += [
        ("components_param columns", _has(tables, "components_param", COMPONENT_COLUMNS),
         "components_param needs the columns Component and Inside"),
        ("fluxes_def columns", _has(tables, "fluxes_def", FLUX_COLUMNS),
         "fluxes_def needs the columns Flux, From and To"),
        ("column names", _has(tables, "mcmc", ()) and all(map(_cell, value_columns(tables["mcmc"]))),
         "Every value column must be named <name>[<year>]"),
    ]
    known = local_table(
        spark,
        [(i, name, bool(ok), None if ok else message) for i, (name, ok, message) in enumerate(checks)],
        "position int, check string, ok boolean, message string",
    )
    passed = {name for name, ok, _ in checks if ok}
    for i, (table, key) in enumerate((("components_param", "Component"), ("fluxes_def", "Flux"))):
        if f"{table} columns" in passed:
            known = known.unionByName(_unique(tables[table], len(checks) + i, table, key))
    return known


def is_valid(tables: Mapping[str, object]) -> bool:
    return validate_model(tables).filter(~F.col("ok")).isEmpty()


def first_failure(tables: Mapping[str, object]) -> str | None:
    """Message of the first failed check."""
    row = validate_model(tables).filter(~F.col("ok")).orderBy("position").first()
    return row["message"] if row else None


def value_columns(wide: DataFrame) -> list[str]:
    return [c for c in wide.columns if c not in ("chain", "iter", "Sample_id")]


def _cell(column: str) -> bool:
    match = CELL.fullmatch(column)
    return bool(match) and bool(re.fullmatch(r"\s*-?\d+\s*", match[2]))


def _has(tables, name, columns) -> bool:
    table = tables.get(name)
    return isinstance(table, DataFrame) and set(columns) <= set(table.columns)


def _unique(table, position, name, key):
    ok = F.coalesce(F.max("n"), F.lit(0)) <= 1
    return table.groupBy(key).agg(F.count("*").alias("n")).agg(
        F.lit(position).alias("position"),
        F.lit(f"{name} unique {key}").alias("check"),
        ok.alias("ok"),
        F.when(~ok, F.lit(f"{key} occurs more than once in {name}")).alias("message"),
    )

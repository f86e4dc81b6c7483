"""Registry of requested series, store of quantile tables, CSV export."""

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trophos.functions.quantiles import STATS
from trophos.plans.scratch import Scratch
from trophos.schemas import QUANT, VARIABLES, quant_columns

KEY = ["Var", "ID"]
CSV = {"nullValue": "NA"}
#: Folder of the files that name snapshots, and the number of snapshots that stay.
CLAIMS, SNAPSHOTS = "_snapshots", 10


def register_series(registry: DataFrame, variable: str, ids: DataFrame) -> DataFrame:
    """Adds the ``(variable, Component)`` rows that are not registered yet.

    For a grouped series the component is the group's label, the ID its
    quantile table is stored under.
    """
    new = ids.select(F.lit(variable).alias("Variable"), "Component").distinct()
    r, n = registry.alias("r"), new.alias("n")
    same = F.col("r.Variable").eqNullSafe(F.col("n.Variable")) & F.col(
        "r.Component"
    ).eqNullSafe(F.col("n.Component"))
    return registry.unionByName(n.join(r, same, "left_anti"))


def upsert_quantiles(store: DataFrame, quant: DataFrame) -> DataFrame:
    """The store with every ``(Var, ID)`` of ``quant`` replaced by its rows."""
    newest = quant.select(*KEY).distinct()
    kept = store.join(newest, KEY, "left_anti")
    return kept.unionByName(quant, allowMissingColumns=True)


def write_quantiles(quant: DataFrame, path: str, kept: int = SNAPSHOTS) -> None:
    """Upsert on disk: a new snapshot in which every ``(Var, ID)`` of ``quant`` has its rows of ``quant``.

    A snapshot is a folder of files in the order of the keys; quantiles are as
    many as the model has series and years, so it is written whole and stays in
    few files.  Its number is claimed by renaming a small file that names the
    folder, which fails if the number is taken: a reader sees all of an upsert
    or nothing, and of two writers one starts again from the other's snapshot.
    The newest ``kept`` snapshots stay for readers that still hold an older one.
    """
    spark = quant.sparkSession
    full = quant
    for field in QUANT.fields:
        if field.name not in full.columns:
            full = full.withColumn(field.name, F.lit(None).cast(field.dataType))
    empty = F.coalesce(F.col("ID") == "", F.lit(True))
    full = full.withColumn("ID", F.when(empty, F.raise_error(F.lit("a stored series needs an ID"))).otherwise(F.col("ID")).cast("string"))
    new = Scratch(spark).keep(full.select(*QUANT.names), "upsert")
    while True:
        number, folder = _newest(spark, path)
        old = spark.read.schema(QUANT).parquet(f"{path}/{folder}") if folder else spark.createDataFrame([], QUANT)
        written = f"rows-{uuid.uuid4().hex}"
        upsert_quantiles(old, new).select(*QUANT.names).sort(*KEY, "Year").write.parquet(f"{path}/{written}")
        if _claim(spark, path, number + 1, written):
            break
        _files(spark, path).delete(_path(spark, f"{path}/{written}"), True)
    _expire(spark, path, number + 1 - kept)


def read_quantiles(spark, path: str) -> DataFrame:
    """The newest snapshot; it stays as it is while later ones are written."""
    _, folder = _newest(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no quantiles are stored in {path}")
    return spark.read.schema(QUANT).parquet(f"{path}/{folder}")


def _path(spark, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark, path: str):
    """The file system of a path, which may be a shared one that only Spark reaches."""
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark, path: str) -> list[int]:
    """Numbers of the snapshots, oldest first."""
    files, folder = _files(spark, path), _path(spark, f"{path}/{CLAIMS}")
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(name) for name in names if name.isdigit())


def _claimed(spark, path: str, number: int):
    return _path(spark, f"{path}/{CLAIMS}/{number:012d}")


def _folder(spark, path: str, number: int) -> str:
    file = _files(spark, path).open(_claimed(spark, path, number))
    try:
        return file.readUTF()
    finally:
        file.close()


def _newest(spark, path: str) -> tuple[int, str | None]:
    """Number and folder of the newest snapshot, 0 and None without one."""
    numbers = _numbers(spark, path)
    return (numbers[-1], _folder(spark, path, numbers[-1])) if numbers else (0, None)


def _claim(spark, path: str, number: int, folder: str) -> bool:
    """Makes ``folder`` the snapshot of this number, unless there is one."""
    files, fs = _files(spark, path), spark._jvm.org.apache.hadoop.fs
    draft = files.makeQualified(_path(spark, f"{path}/{CLAIMS}/_{folder}"))
    file = files.create(draft, False)
    file.writeUTF(folder)
    file.close()
    rename = getattr(fs, "Options$Rename")
    no_overwrite = spark.sparkContext._gateway.new_array(rename, 1)
    no_overwrite[0] = rename.NONE
    target = files.makeQualified(_claimed(spark, path, number))
    try:
        fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, no_overwrite)
        return True
    except Py4JJavaError:
        files.delete(draft, False)
        if files.exists(target):
            return False
        raise


def _expire(spark, path: str, last: int) -> None:
    """Removes the snapshots up to this number."""
    files = _files(spark, path)
    for number in _numbers(spark, path):
        if number <= last:
            folder = _folder(spark, path, number)
            files.delete(_claimed(spark, path, number), False)
            files.delete(_path(spark, f"{path}/{folder}"), True)


def export_rows(store: DataFrame, selection: DataFrame) -> DataFrame:
    """Stored rows of the selected pairs with the name of their file; pairs
    that are not stored are skipped."""
    keys = selection.select(F.col("Variable").alias("Var"), F.col("Component").alias("ID")).distinct()
    name = F.regexp_replace("Var", "[^A-Za-z0-9]", "_")
    return store.join(keys, KEY, "left_semi").withColumn("file", name)


def export_series(store: DataFrame, selection: DataFrame, path: str) -> list[str]:
    """One CSV file per selected variable below ``path``, in one job.

    A variable of the model has its own columns, any other all of them.  Rows
    are in the order of ID, target or metric, year and statistic.  The store is
    evaluated once.  Files appear under their names when all are written.
    Returns these names in their order.
    """
    spark = store.sparkSession
    full = export_rows(store, selection)
    for name in set(QUANT.names) - set(full.columns):
        full = full.withColumn(name, F.lit(None).cast(QUANT[name].dataType))
    line = F.to_csv(F.struct(*QUANT.names), CSV)
    header = F.lit(",".join(QUANT.names))
    for variable in VARIABLES:
        columns = quant_columns(variable)
        own = F.col("Var") == variable
        line = F.when(own, F.to_csv(F.struct(*columns), CSV)).otherwise(line)
        header = F.when(own, F.lit(",".join(columns))).otherwise(header)
    stat = F.array_position(F.array(*map(F.lit, STATS)), F.col("Stat"))
    order = ["Var", "ID", "Prey", "Predator", "Metric", "Year", "stat"]
    rows = Scratch(spark).keep(full.select("file", *order[:-1], stat.alias("stat"), line.alias("value"), header.alias("header")), "export")
    # a variable's least row brings its header along
    first = Window.partitionBy("file").orderBy(*order)
    rows = rows.withColumn("place", F.row_number().over(first))
    rows = rows.select("file", "place", F.when(F.col("place") == 1, F.concat_ws("\n", "header", "value")).otherwise(F.col("value")).alias("value"))
    written = f"{path}/_export-{uuid.uuid4().hex}"
    rows.sortWithinPartitions("file", "place").select("file", "value").write.partitionBy("file").text(written)
    return _named_files(spark, written, path)


def _named_files(spark, written: str, path: str) -> list[str]:
    """Gives the single part of each folder ``file=<name>`` its name; the folders go."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(written)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = []
    for status in files.listStatus(folder):
        kind, _, name = status.getPath().getName().partition("=")
        if kind == "file":
            (part,) = [f.getPath() for f in files.listStatus(status.getPath()) if f.getPath().getName().startswith("part-")]
            target = hadoop(f"{path}/{name}.csv")
            files.delete(target, True)
            files.rename(part, target)
            files.delete(hadoop(f"{path}/.{name}.csv.crc"), False)  # of a local file system
            names.append(f"{name}.csv")
    files.delete(folder, True)
    return sorted(names)

"""Intermediate tables of multi-pass jobs.

They go to the shared folder named by ``spark.checkpoint.dir``, so a lost
executor costs a re-read and not a recomputation.  Reading them back as
parquet also gives the optimizer their true size: whether one is small enough
to broadcast is then decided by Spark's own threshold.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder in the warehouse, which executors share too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return folder.rstrip("/")


class Scratch:
    """One uniquely named folder of tables."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/trophos-{uuid.uuid4().hex}"
        self.tables: dict[str, DataFrame] = {}

    def keep(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """Write ``df`` and return the written table."""
        name = name or f"step{len(self.tables)}"
        target = f"{self.path}/{name}"
        df.write.parquet(target)
        self.tables[name] = self.spark.read.schema(df.schema).parquet(target)
        return self.tables[name]

    def keep_only(self, *names: str) -> None:
        """Empty the tables no later plan reads."""
        for other in self.tables.keys() - set(names):
            empty = self.spark.createDataFrame([], self.tables.pop(other).schema)
            empty.write.mode("overwrite").parquet(f"{self.path}/{other}")

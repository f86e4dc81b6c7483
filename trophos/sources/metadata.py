"""Metadata CSV files."""

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from trophos.operators.metadata import validate_metadata
from trophos.schemas import INFO

MALFORMED = re.compile("MALFORMED|CSV header")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Validated metadata; an unreadable or malformed file gives an empty frame.

    Malformed are a row with more or fewer fields than the header, and a file
    whose header is not that of the first.
    """
    empty = spark.createDataFrame([], INFO)
    try:
        text = StructType([StructField(c, StringType()) for c in spark.read.csv(path, header=True).columns])
    except AnalysisException:
        return empty
    options = {"header": True, "nullValue": "NA", "mode": "FAILFAST", "enforceSchema": False}
    raw = spark.read.schema(text).csv(path, **options)
    try:
        return validate_metadata(raw)  # reads every field of every row
    except (PySparkException, Py4JJavaError) as error:
        if MALFORMED.search(str(error)):
            return empty
        raise


def write_metadata(info: DataFrame, path: str) -> None:
    info.select("ID", "FullName", "Colour").write.mode("overwrite").csv(
        path, header=True, emptyValue=""
    )

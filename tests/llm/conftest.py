import os

import pytest
from llm_rows import CLASHING, ODD
from pyspark.sql import functions as F

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return FOLDER


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, folder):
    return spark.read.parquet(f"{folder}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    return rows.select("*", *[F.lit(None).cast("string").alias(c) for c in CLASHING]).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(1, 1, 1), (1, 0, 0), (2, 1, None), (None, 1, 1), (6, 0, 0), (7, 1, 0), (99, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


YEARS = (1, 2, 3)
# The hand-computed web: components A, B and fleet FX; sample 2 = 2 x sample 1.
CELLS = {
    "A": (100.0, 80.0, 60.0),
    "B": (200.0, 150.0, 120.0),
    "F01": (20.0, 10.0, None),
    "F02": (10.0, 5.0, None),
    "F03": (30.0, 15.0, None),
}
FLUXES = [("F01", "B", "A"), ("F02", "A", "FX"), ("F03", "B", "FX")]


@pytest.fixture(scope="session")
def fluxes(spark):
    return spark.createDataFrame(FLUXES, "Flux string, From string, To string")


@pytest.fixture(scope="session")
def components(spark):
    return spark.createDataFrame(
        [("A", 1), ("B", 1), ("FX", 0)], "Component string, Inside int"
    )


@pytest.fixture(scope="session")
def info(spark):
    return spark.createDataFrame(
        [("A", "Alpha", "#1"), ("B", "Beta", "#2"), ("FX", "Fleet", "#3")],
        "ID string, FullName string, Colour string",
    )


def long_rows(cells, samples=(1, 2)):
    edges = {f: (s, t) for f, s, t in FLUXES}
    rows = []
    for i in samples:
        for name, values in cells.items():
            src, dst = edges.get(name, (None, None))
            var = f"{src}_{dst}" if src else name
            for year, v in zip(YEARS, values):
                if v is not None:
                    kind = "flux" if src else "component"
                    rows.append((i, kind, var, src, dst, year, v * i, None))
    return rows


@pytest.fixture(scope="session")
def make_long(spark):
    from trophos.schemas import LONG

    return lambda rows: spark.createDataFrame(rows, LONG)


@pytest.fixture(scope="session")
def long(make_long):
    return make_long(long_rows(CELLS)).cache()

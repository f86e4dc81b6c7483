"""A food web derived from sales tables.

Regions are components, market segments are fishing fleets, and every
``ORDERS_PER_SAMPLE`` consecutive order keys are one sample, so the number of
samples grows with the orders.  A region's biomass is what its customers
ordered in a year; a flux is what suppliers of one region sold to customers of
another or, for urgent orders, to a segment.  Amounts are in thousands.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ORDERS_PER_SAMPLE = 250

# The columns in use; a given schema saves Spark a job that reads footers.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_suppkey bigint, l_extendedprice double",
}


class Sales:
    """Lazy tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}.parquet")

    def _markets(self) -> DataFrame:
        """(region key, region name, segment) of all customers."""
        customer, nation, region = map(self.table, ("customer", "nation", "region"))
        return (
            customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("r_regionkey", "r_name", "c_mktsegment")
            .distinct()
        )

    @cached_property
    def _names(self) -> tuple[list[str], list[str]]:
        """Names of the regions and the fleets: the components of the model."""
        region = F.concat(F.lit("R"), F.col("r_regionkey").cast("string"))
        fleet = F.concat(F.lit("F"), "c_mktsegment")
        found = self._markets().agg(F.collect_set(region).alias("r"), F.collect_set(fleet).alias("f")).first()
        return sorted(found["r"]), sorted(found["f"])

    def regions(self) -> list[str]:
        return self._names[0]

    def fleets(self) -> list[str]:
        return self._names[1]

    # A fact table meets the customers or suppliers before the nations: Spark
    # then compares true table sizes when it picks the side to broadcast.

    def _regions_of_nations(self, key: str, name: str) -> DataFrame:
        region = F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))
        return self.table("nation").select(F.col("n_nationkey").alias(key), region.alias(name))

    def _orders(self):
        orders = self.table("orders").select(
            "o_orderkey",
            "o_custkey",
            "o_totalprice",
            F.year("o_orderdate").cast("int").alias("Year"),
            (F.expr(f"o_orderkey div {ORDERS_PER_SAMPLE}") + 1).alias("Sample_id"),
            (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        )
        return orders.join(
            self.table("customer"), F.col("o_custkey") == F.col("c_custkey")
        ).join(self._regions_of_nations("c_nationkey", "region"), "c_nationkey")

    def biomass(self) -> DataFrame:
        cells = self._orders().groupBy("Sample_id", "region", "Year").agg(
            F.sum(_cents("o_totalprice")).alias("cents")
        )
        none = F.lit(None).cast("string")
        return _rows(cells, "component", F.col("region"), none, none)

    def flux(self) -> DataFrame:
        sold = (
            self.table("lineitem")
            .select("l_orderkey", "l_suppkey", _cents("l_extendedprice").alias("cents"))
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self._regions_of_nations("s_nationkey", "src"), "s_nationkey")
        )
        fleet = F.concat(F.lit("F"), "c_mktsegment")
        buyers = self._orders().select(
            "o_orderkey", "Sample_id", "Year",
            F.when(F.col("urgent"), fleet).otherwise(F.col("region")).alias("dst"),
        )
        cells = (
            sold.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("Sample_id", "src", "dst", "Year")
            .agg(F.sum("cents").alias("cents"))
        )
        src, dst = F.col("src"), F.col("dst")
        return _rows(cells, "flux", F.concat(src, F.lit("_"), dst), src, dst)

    def long(self) -> DataFrame:
        return self.biomass().unionByName(self.flux())

    def fluxes(self) -> DataFrame:
        """Edges that occur, numbered by name."""
        # The distinct edges of the web, at most regions x (regions + fleets).
        edges = self.flux().select("src", "dst").distinct()
        ranked = edges.withColumn(
            "Flux", F.concat(F.lit("X"), F.expr(
                "cast(row_number() over (order by concat(src, '_', dst)) as string)"))
        )
        return ranked.select("Flux", F.col("src").alias("From"), F.col("dst").alias("To"))

    def components(self, fluxes: DataFrame) -> DataFrame:
        """Both ends of the edges with positions by the rank of their name."""
        names = fluxes.select(F.col("From").alias("Component")).union(fluxes.select("To")).distinct()
        rank = F.expr("row_number() over (order by Component)")
        inside = F.col("Component").startswith("R").cast("int").alias("Inside")
        return names.withColumn("rank", rank).select(
            "Component", inside, (F.col("rank") / 16).alias("X"), (F.col("rank") / 32).alias("Y")
        )

    def raw_info(self) -> DataFrame:
        """Metadata as a user might upload it: the regions with customers,
        untidy names, and one ID the model does not have."""
        key = F.col("r_regionkey").cast("string")
        regions = self._markets().select("r_regionkey", "r_name").distinct()
        rows = regions.select(
            F.concat(F.lit(" R"), key).alias("ID"),
            F.concat("r_name", F.lit("  ")).alias("FullName"),
            F.concat(F.lit("#00000"), key).alias("Color"),
        )
        unknown = regions.agg(F.count("*").alias("n")).select(
            F.concat(F.lit("Z"), F.col("n").cast("string")), F.lit(" "), F.lit(None).cast("string")
        )
        return rows.union(unknown)


def _cents(column):
    return F.rint(F.col(column) * 100).cast("long")


def _rows(cells, kind, name, src, dst):
    return cells.select(
        "Sample_id",
        F.lit(kind).alias("kind"),
        name.alias("Var"),
        src.alias("src"),
        dst.alias("dst"),
        "Year",
        (F.col("cents").cast("double") / 100000).alias("value"),
        F.lit(None).cast("int").alias("Trophic"),
    )

"""Table layouts shared by every module."""

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(*fields):
    return StructType([StructField(name, kind, True) for name, kind in fields])


COMPONENTS = _struct(
    ("Component", StringType()),
    ("Inside", IntegerType()),
    ("X", DoubleType()),
    ("Y", DoubleType()),
)

FLUXES = _struct(
    ("Flux", StringType()),
    ("From", StringType()),
    ("To", StringType()),
    ("Trophic", IntegerType()),
)

INFO = _struct(
    ("ID", StringType()),
    ("FullName", StringType()),
    ("Colour", StringType()),
)

LONG = _struct(
    ("Sample_id", LongType()),
    ("kind", StringType()),
    ("Var", StringType()),
    ("src", StringType()),
    ("dst", StringType()),
    ("Year", IntegerType()),
    ("value", DoubleType()),
    ("Trophic", IntegerType()),
)

REGISTRY = _struct(("Variable", StringType()), ("Component", StringType()))

QUANT = _struct(
    ("Year", IntegerType()),
    ("Var", StringType()),
    ("Unit", StringType()),
    ("ID", StringType()),
    ("Prey", StringType()),
    ("Predator", StringType()),
    ("Metric", StringType()),
    ("Stat", StringType()),
    ("Value", DoubleType()),
)

# Variable name -> (unit, extra column of its quantile table).
VARIABLES = {
    "Biomass": ("1000t", None),
    "Consumption": ("1000t", "Prey"),
    "Predation and Fisheries": ("1000t", "Predator"),
    "Fluxes": ("1000t", None),
    "Ratio Consumption/Biomass": ("Unitless", None),
    "Ratio Production/Biomass": ("Unitless", None),
    "Mortality and Growth": ("Rate (y-1)", "Metric"),
}

# Fixed value: colour of a grouped series.
GROUP_COLOUR = "#27548A"


def quant_columns(variable):
    """Columns of one variable's quantile table, in order."""
    extra = VARIABLES[variable][1]
    middle = [extra] if extra else []
    return ["Year", "Var", "Unit", "ID", *middle, "Stat", "Value"]

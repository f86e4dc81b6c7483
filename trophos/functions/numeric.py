"""Column helpers for IEEE arithmetic and missing-value rules.

Spark in ANSI mode throws on ``x / 0``, returns NULL for ``ln(0)`` and skips
NULL in sums.  The analytics need infinities, and a sum that is missing as
soon as one term is missing.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")
_NAN = float("nan")


def is_missing(c: Column) -> Column:
    """NULL or NaN."""
    return c.isNull() | F.isnan(c)


def known(c: Column) -> Column:
    """The value, with NaN turned into NULL."""
    return F.when(~F.isnan(c), c)


def ieee_div(n: Column, d: Column) -> Column:
    """``n / d`` where a zero divisor gives an infinity, or NaN for 0/0."""
    at_zero = (
        F.when(F.isnan(n) | (n == 0), F.lit(_NAN))
        .when(n > 0, F.lit(_INF))
        .when(n < 0, F.lit(-_INF))
    )
    return F.when(d != 0, n / d).when(d == 0, at_zero)


def r_log(x: Column) -> Column:
    """Natural logarithm with ``log(0) = -Infinity`` and ``log(<0) = NaN``."""
    return (
        F.when(F.isnan(x) | (x < 0), F.lit(_NAN))
        .when(x == 0, F.lit(-_INF))
        .otherwise(F.ln(x))
    )


def strict_sum(c: Column, where: Column | None = None) -> Column:
    """Sum of ``c`` that is NULL when any summed value is NULL or NaN."""
    missing = is_missing(c)
    if where is not None:
        c, missing = F.when(where, c), where & missing
    return F.when(~F.bool_or(F.coalesce(missing, F.lit(False))), F.sum(c))


def strict_mean(c: Column) -> Column:
    """Mean of ``c`` that is NULL when any value is NULL or NaN."""
    return F.when(~F.bool_or(is_missing(c)), F.avg(c))


def lenient_sum(c: Column, where: Column) -> Column:
    """Sum over the rows of ``where`` without missing values: NULL only when
    ``where`` selects no row at all, 0 when all its values are missing."""
    rows = F.count(F.when(where, F.lit(1)))
    return F.when(rows > 0, F.coalesce(F.sum(F.when(where, known(c))), F.lit(0.0)))

"""Arithmetic whose null and zero rules differ from Spark's defaults."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_as_zero(column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def sum0(column) -> Column:
    """Sum that skips nulls and is 0, not null, for a group without any value."""
    return F.coalesce(F.sum(column), F.lit(0.0))


def row_count() -> Column:
    """Number of rows, null or not."""
    return F.count(F.lit(1))


def mean_over_rows(column) -> Column:
    """Sum over the number of *rows*: a null adds nothing but is still counted."""
    return sum0(column) / row_count()


def ieee_div(numerator: Column, denominator: Column) -> Column:
    """Floating-point division where x/0 is +inf, -inf or NaN instead of an error."""
    num = numerator.cast("double")
    den = denominator.cast("double")
    by_zero = (
        F.when(F.isnan(num), F.lit(float("nan")))
        .when(num > 0, F.lit(float("inf")))
        .when(num < 0, F.lit(float("-inf")))
        .when(num == 0, F.lit(float("nan")))
    )
    return F.when(den == 0, by_zero).otherwise(F.try_divide(num, den))

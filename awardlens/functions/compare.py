"""Three-way comparison of two amounts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import null_as_zero

# Category names, in report order.
LESS, EQUAL, GREATER = "less_than", "equal", "greater_than"


def compare3(left: Column, right: Column) -> Column:
    """``less_than`` / ``equal`` / ``greater_than``, with null counted as 0."""
    a, b = null_as_zero(left), null_as_zero(right)
    return F.when(a < b, LESS).when(a == b, EQUAL).otherwise(GREATER)

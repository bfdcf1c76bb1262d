"""Column expressions. All of them are built-in Spark functions; there is no UDF."""

from .cleaning import bool_from_words, iso_date, null_tokens_to_null, parse_tf
from .compare import compare3
from .lineage import file_id
from .numbers import ieee_div, mean_over_rows, null_as_zero, row_count, sum0
from .sectors import sector_code, sector_name

__all__ = [
    "bool_from_words",
    "compare3",
    "file_id",
    "ieee_div",
    "iso_date",
    "mean_over_rows",
    "null_as_zero",
    "null_tokens_to_null",
    "parse_tf",
    "row_count",
    "sector_code",
    "sector_name",
    "sum0",
]

"""Cell-level cleaning of text read from CSV.

The rules are written as SQL text over the SQL text of a cell, because an ingest applies
them to hundreds of columns in one projection, which is built far faster from text than
from column objects. The functions without ``_sql`` give the same as a column.
"""

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a missing cell.
NULL_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "n/a",
    "nan",
    "null",
]


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_list(values: Iterable[str]) -> str:
    return ", ".join(map(sql_text, values))


def present_sql(cell: str) -> str:
    """True for a cell that does not spell a missing value, null for null."""
    return f"{cell} NOT IN ({_sql_list(NULL_TOKENS)})"


def null_tokens_sql(cell: str) -> str:
    return f"CASE WHEN {present_sql(cell)} THEN {cell} END"


def bool_words_sql(cell: str, true_words: Iterable[str], false_words: Iterable[str]) -> str:
    return (
        f"CASE WHEN {cell} IN ({_sql_list(true_words)}) THEN true"
        f" WHEN {cell} IN ({_sql_list(false_words)}) THEN false END"
    )


def iso_date_sql(cell: str) -> str:
    return rf"CASE WHEN {cell} RLIKE r'^\d{{4}}-\d{{2}}-\d{{2}}$' THEN try_cast({cell} AS date) END"


# What a number or a time may look like, blanks around it aside. Spark's own
# casts also take suffixes (12d), hexadecimal floats, plus signs, years and time zones.
INTEGER = r"^[ \t]*-?[0-9]+[ \t]*$"
HEXADECIMAL = r"^[ \t]*0[xX][0-9a-fA-F]+[ \t]*$"
NUMBER = r"^[ \t]*-?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?[ \t]*$|^[ \t]*-?(?i:inf|infinity|nan)[ \t]*$"
TIME = r"^[ \t]*[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?)?[ \t]*$"


def integer_sql(cell: str, kind: str) -> str:
    """Decimal digits, or hexadecimal ones after ``0x``."""
    digits = f"conv(substring(trim(BOTH ' \t' FROM {cell}), 3), 16, 10)"
    return (
        f"CASE WHEN {cell} RLIKE r'{INTEGER}' THEN try_cast({cell} AS {kind})"
        f" WHEN {cell} RLIKE r'{HEXADECIMAL}' THEN try_cast({digits} AS {kind}) END"
    )


def number_sql(cell: str, kind: str) -> str:
    """A floating-point number; spellings of a missing cell are none."""
    return (
        f"CASE WHEN {cell} RLIKE r'{NUMBER}' AND {present_sql(cell)}"
        f" THEN try_cast({cell} AS {kind}) END"
    )


def time_sql(cell: str, kind: str) -> str:
    """Date, or date and time of day; no bare year, no time zone."""
    return f"CASE WHEN {cell} RLIKE r'{TIME}' THEN try_cast({cell} AS {kind}) END"


def null_tokens_to_null(cell: str) -> Column:
    """The cell, or null where it spells a missing value."""
    return F.expr(null_tokens_sql(cell))


def bool_from_words(cell: str, true_words: Iterable[str], false_words: Iterable[str]) -> Column:
    """Boolean from exact spellings; null for null and for any other text."""
    return F.expr(bool_words_sql(cell, true_words, false_words))


def iso_date(cell: str) -> Column:
    """Date from ``YYYY-MM-DD`` text, null for any other text."""
    return F.expr(iso_date_sql(cell))


def parse_tf(flag: Column) -> Column:
    """``t``/``T`` is true, ``f``/``F`` is false, anything else (also ``true``) is null."""
    letter = F.lower(flag.cast("string"))
    return F.when(letter == "t", True).when(letter == "f", False)

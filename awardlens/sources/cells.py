"""Text cells to typed columns, all columns in one projection."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import (
    NULL_TOKENS,
    bool_words_sql,
    integer_sql,
    iso_date_sql,
    null_tokens_sql,
    number_sql,
    present_sql,
    sql_text,
    time_sql,
)
from .schema_json import DECLARED, UNSIGNED_MAX
from .vocabulary import Vocabulary

BAD_VALUES = "_bad_values"
ON_BAD_VALUE = ("fail", "null", "flag")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def typed_sql(cell: str, field: T.StructField, words: Vocabulary) -> str:
    """The cell as the field's type; null where it is missing or not such a value.

    Most spellings of a missing cell are no value of any type but text, so only text,
    floating-point numbers (``nan``) and flags have to look at them.
    """
    kind = field.dataType
    if isinstance(kind, (T.ArrayType, T.StructType)):
        raise ValueError(f"column {field.name!r}: CSV cells cannot hold {kind.simpleString()}")
    if isinstance(kind, T.StringType):
        return null_tokens_sql(cell)
    if isinstance(kind, T.BooleanType):
        known = [[word for word in side if word not in NULL_TOKENS] for side in words]
        return bool_words_sql(cell, *known)
    if isinstance(kind, T.DateType):
        return iso_date_sql(cell)
    if isinstance(kind, T.BinaryType):
        return f"try_cast({null_tokens_sql(cell)} AS binary)"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return number_sql(cell, kind.simpleString())
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return time_sql(cell, kind.simpleString())
    value = integer_sql(cell, kind.simpleString())
    top = UNSIGNED_MAX.get(field.metadata.get(DECLARED))
    if top is None:
        return value
    return f"CASE WHEN ({value}) BETWEEN 0 AND {top} THEN {value} END"


def type_cells(
    rows: DataFrame, schema: T.StructType, words: Vocabulary, on_bad_value: str = "fail"
) -> DataFrame:
    """Convert the text columns named in ``schema``; other columns pass through.

    A cell that is not missing and not a value of its type raises an error (``fail``),
    becomes null (``null``), or becomes null and sets the row's ``_bad_values`` (``flag``).

    All of it is one projection over the raw cells: with hundreds of columns every
    further projection costs about as much as parsing.
    """
    if on_bad_value not in ON_BAD_VALUE:
        raise ValueError(f"on_bad_value must be one of {ON_BAD_VALUE}, got {on_bad_value!r}")
    declared = {field.name: field for field in schema.fields}
    columns: list[str] = []
    bad: list[str] = []
    fields: list[T.StructField] = []
    for name in rows.columns:
        cell = _quoted(name)
        field = declared.get(name)
        if field is None:
            columns.append(cell)
            fields.append(T.StructField(name, T.StringType()))
            continue
        value = typed_sql(cell, field, words)
        if not isinstance(field.dataType, T.StringType):
            if on_bad_value == "fail":
                message = sql_text(f"column {name}: not a {field.dataType.simpleString()}: ")
                value = (
                    f"coalesce({value}, CASE WHEN {present_sql(cell)}"
                    f" THEN raise_error(concat({message}, {cell})) END)"
                )
            elif on_bad_value == "flag":
                bad.append(f"CASE WHEN ({value}) IS NULL THEN {present_sql(cell)} END")
        columns.append(f"{value} AS {cell}")
        fields.append(T.StructField(name, field.dataType, True, field.metadata))
    if on_bad_value == "flag":
        flag = f"exists(array({', '.join(bad)}), b -> b IS TRUE)" if bad else "false"
        columns.append(f"{flag} AS {BAD_VALUES}")
        fields.append(T.StructField(BAD_VALUES, T.BooleanType()))
    # The types are right already; this carries the fields' metadata over.
    return rows.selectExpr(*columns).to(T.StructType(fields))


# Types tried for an undeclared column, narrowest first.
INFERRED_KINDS = {
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "double": T.DoubleType(),
}


def infer_fields(
    rows: DataFrame, columns: Sequence[str], words: Vocabulary
) -> list[T.StructField]:
    """Types of text columns, from all of their cells: the first kind all cells fit.

    A column without any value, or that fits no kind, stays text.
    """
    if not columns:
        return []

    def fits(name: str, kind: T.DataType) -> str:
        cell = _quoted(name)
        value = typed_sql(cell, T.StructField(name, kind), words)
        return f"bool_and(CASE WHEN {present_sql(cell)} THEN ({value}) IS NOT NULL END)"

    found = rows.agg(
        *(
            F.expr(f"array({', '.join(fits(name, kind) for kind in INFERRED_KINDS.values())})")
            for name in columns
        )
    ).first()
    fields = []
    for name, fitting in zip(columns, found):
        kind = next((k for k, fit in zip(INFERRED_KINDS.values(), fitting) if fit), T.StringType())
        fields.append(T.StructField(name, kind))
    return fields

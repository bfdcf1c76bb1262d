"""Column types declared in a JSON file."""

import json
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import types as T

# Type names a schema file may use. Spark has no unsigned integers, so each
# is held in the next larger type; its declared name stays in the field's metadata.
SIMPLE_TYPES = {
    "string": T.StringType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(),
    "float32": T.FloatType(),
    "float": T.FloatType(),
    "float64": T.DoubleType(),
    "double": T.DoubleType(),
    "bool": T.BooleanType(),
    "boolean": T.BooleanType(),
    "date32[day]": T.DateType(),
    "date64[ms]": T.DateType(),
    "timestamp[s]": T.TimestampNTZType(),
    "timestamp[ms]": T.TimestampNTZType(),
    "timestamp[us]": T.TimestampNTZType(),
    "timestamp[ns]": T.TimestampNTZType(),
    "binary": T.BinaryType(),
    "large_binary": T.BinaryType(),
    "large_string": T.StringType(),
}
UNSIGNED_MAX = {"uint8": 2**8 - 1, "uint16": 2**16 - 1, "uint32": 2**32 - 1, "uint64": 2**64 - 1}

# Metadata key under which a field keeps what Spark's type cannot say.
DECLARED = "declared"


def load_schema(path: str | Path) -> T.StructType:
    """Read a schema file: ``{"fields": [{"name", "type", "nullable"?, "metadata"?}, ...]}``.

    A type is a simple name, or an object of type ``dictionary`` or ``list`` (with
    ``valueType``) or ``struct`` (with ``fields``). Raises ``FileNotFoundError`` for a
    missing file and ``ValueError`` for anything malformed.
    """
    return schema_from_text(Path(path).read_text(encoding="utf-8"))


def schema_from_text(text: str) -> T.StructType:
    try:
        declared = json.loads(text)
    except json.JSONDecodeError as error:
        raise ValueError(f"schema is not valid JSON: {error}") from error
    if not isinstance(declared, dict) or "fields" not in declared:
        raise ValueError("schema must be an object with a 'fields' list")
    return T.StructType([_field(entry) for entry in declared["fields"]])


def schema_metadata(text: str) -> dict[str, str]:
    """The schema's own metadata, with all values as text."""
    return _as_text(json.loads(text).get("metadata"))


def _as_text(metadata: dict[str, Any] | None) -> dict[str, str]:
    return {key: str(value) for key, value in (metadata or {}).items()}


def _simple(name: Any) -> T.DataType:
    if name not in SIMPLE_TYPES:
        raise ValueError(f"unsupported type {name!r}")
    return SIMPLE_TYPES[name]


def _field(entry: dict[str, Any]) -> T.StructField:
    name, declared = entry.get("name"), entry.get("type")
    if not name:
        raise ValueError(f"field without a name: {entry}")
    if not declared:
        raise ValueError(f"field {name!r} has no type")
    data_type, notes = _complex(name, declared) if isinstance(declared, dict) else (None, None)
    if data_type is None:
        if not isinstance(declared, str):
            raise ValueError(f"field {name!r} has an invalid type: {declared!r}")
        data_type, notes = _simple(declared), {DECLARED: declared}
    metadata = {**_as_text(entry.get("metadata")), **notes}
    return T.StructField(name, data_type, entry.get("nullable", True), metadata)


def _complex(name: str, declared: dict[str, Any]) -> tuple[T.DataType, dict[str, Any]]:
    kind = declared.get("type")
    if kind in ("dictionary", "list"):
        value_name = declared.get("valueType")
        if not value_name:
            raise ValueError(f"{kind} field {name!r} has no valueType")
        value = _simple(value_name)
        if kind == "list":
            return T.ArrayType(value), {DECLARED: "list"}
        index = declared.get("indexType", "int32")
        _simple(index)
        return value, {
            DECLARED: value_name,
            "dictionary_index": index,
            "dictionary_ordered": bool(declared.get("ordered", False)),
        }
    if kind == "struct":
        if not declared.get("fields"):
            raise ValueError(f"struct field {name!r} has no fields")
        return T.StructType([_field(entry) for entry in declared["fields"]]), {DECLARED: "struct"}
    raise ValueError(f"field {name!r} has an unsupported type {declared!r}")


# Folder inside a dataset, or a manifest of it, that holds its schema; readers of the data
# pass it over.
STORED_SCHEMA = "_schema"


def stored_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The schema that was stored with the dataset, if it was."""
    try:
        row = spark.read.text(f"{path.rstrip('/')}/{STORED_SCHEMA}", wholetext=True).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row and T.StructType.fromJson(json.loads(row[0]))


def store_schema(spark: SparkSession, path: str, schema: T.StructType) -> None:
    folder = f"{path.rstrip('/')}/{STORED_SCHEMA}"
    text = spark.createDataFrame([(schema.json(),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(folder)


def merged_fields(old: T.StructType | None, new: T.StructType) -> T.StructType:
    """Columns keep their places, new ones follow, a changed type counts from now on."""
    fields = {field.name: field for field in old or ()} | {field.name: field for field in new}
    return T.StructType(list(fields.values()))

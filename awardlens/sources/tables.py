"""Parquet datasets and plain CSV files."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import session_conf, writing
from . import snapshots
from .drops import LINEAGE
from .schema_json import merged_fields, store_schema, stored_schema

# Id-like columns that must stay text in plain CSV files.
TEXT_COLUMNS = [
    "dod_acquisition_program_code",
    "parent_award_agency_id",
    "recipient_phone_number",
    "recipient_fax_number",
    "recipient_zip_4_code",
]


def read_awards(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    schema: T.StructType | None = None,
    drop_years: Sequence[str] | None = None,
    between: Mapping[str, tuple] | None = None,
) -> DataFrame:
    """A ``year=/file=`` dataset, lazily. Partition values stay text, so ``01`` is kept.

    Drops may differ in columns: the schema is the one stored with the dataset, or given.
    Only for a dataset without one it is merged from the footers of all files.
    ``drop_years`` leaves out the folders of other drops before anything is listed in a
    task; a drop's year need not be the fiscal year of all its rows. ``between`` keeps rows
    whose columns lie in ``(low, high)``, both included, None being open; of a dataset with
    a manifest only folders that can hold such rows are read.
    """
    manifest = snapshots.current(spark, path)
    if manifest is not None:
        rows = snapshots.read(spark, path, manifest, drop_years, between, schema)
        return _chosen(rows, columns, between)
    if schema is None:
        schema = stored_schema(spark, path)
    reader = spark.read.option("mergeSchema", schema is None)
    if schema is not None:
        reader = reader.schema(schema)
    with session_conf(spark, {"spark.sql.sources.partitionColumnTypeInference.enabled": "false"}):
        rows = reader.parquet(path)
    if drop_years is not None:
        rows = rows.filter(F.col("year").isin(*map(str, drop_years)))
    return _chosen(rows, columns, between)


def _chosen(
    rows: DataFrame, columns: Sequence[str] | None, between: Mapping[str, tuple] | None
) -> DataFrame:
    for name, (low, high) in (between or {}).items():
        if low is not None:
            rows = rows.filter(F.col(f"`{name}`") >= F.lit(low))
        if high is not None:
            rows = rows.filter(F.col(f"`{name}`") <= F.lit(high))
    return rows if columns is None else rows.select(*(f"`{name}`" for name in columns))


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header line alone."""
    return spark.read.option("header", True).csv(path).columns


def read_plain_csv(
    spark: SparkSession,
    path: str,
    text_columns: Sequence[str] = TEXT_COLUMNS,
    schema: T.StructType | None = None,
) -> DataFrame:
    """CSV with a header: declared types, or inferred ones with ``text_columns`` as text.

    Inference reads the file once more, so pass a schema for large inputs. Inferred
    integers are 64 bits wide, and dates and times stay text.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    if schema is None:
        inferred = reader.option("inferSchema", True).csv(path).schema
        schema = T.StructType(
            [T.StructField(f.name, _plain(f.dataType, f.name in text_columns)) for f in inferred]
        )
    return reader.option("inferSchema", False).schema(schema).csv(path)


def _plain(kind: T.DataType, as_text: bool) -> T.DataType:
    if as_text or isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return T.StringType()
    return T.LongType() if isinstance(kind, T.IntegralType) else kind


def write_csv(
    df: DataFrame, path: str, single_file: bool = False, compression: str = "none"
) -> None:
    """CSV with a header, one file per task; a single file only for small results.

    Compressed files (``gzip``) are read by one task each.
    """
    out = df.coalesce(1) if single_file else df
    with writing(df.sparkSession):
        write = out.write.mode("overwrite").option("header", True).option("escape", '"')
        write.option("compression", compression).csv(path)


def write_awards(
    df: DataFrame, path: str, overwrite: bool = True, atomic: bool = False
) -> None:
    """Parquet partitioned by ``year`` and ``file``.

    Partitions in ``df`` replace those of the same name and others stay, so a run can be
    repeated. Without ``overwrite`` an existing path is an error. With ``atomic`` the dataset
    gets a manifest that ``read_awards`` follows: a job that dies changes nothing.
    """
    absent = [name for name in LINEAGE if name not in df.columns]
    if absent:
        raise ValueError(f"rows lack the lineage columns {absent}")
    if atomic:
        snapshots.commit(df, path, overwrite)
        return
    if snapshots.current(df.sparkSession, path) is not None:
        raise ValueError(f"{path} has a manifest: write to it with atomic=True")
    # A task holds the rows of few files, so it can keep their writers open instead of
    # sorting all its rows by partition first.
    with writing(df.sparkSession):
        (
            df.write.mode("overwrite" if overwrite else "errorifexists")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "zstd")
            .option("parquet.compression.codec.zstd.level", "9")
            .partitionBy(*LINEAGE)
            .parquet(path)
        )
    data = [field for field in df.schema.fields if field.name not in LINEAGE]
    written = T.StructType(data + [df.schema[name] for name in LINEAGE])
    store_schema(df.sparkSession, path, merged_fields(stored_schema(df.sparkSession, path), written))

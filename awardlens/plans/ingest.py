"""Yearly drops of compressed CSV into one typed, partitioned Parquet dataset."""

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import uri_file_id, uri_name
from ..session import scratch_dir, scratch_scope, staged
from ..sources.cells import BAD_VALUES, infer_fields, type_cells
from ..sources.drops import FILE_COLUMNS, FILE_URI, LINEAGE, Drop, read_drops, year_directories
from ..sources.schema_json import load_schema
from ..sources.tables import read_awards, write_awards
from ..sources.vocabulary import Vocabulary, bool_vocabulary
from .outlays import OUTLAY_COLUMNS, outlay_rows

ON_BAD_VALUE = ("fail", "null", "skip_file")


def ingest(
    spark: SparkSession,
    years: Sequence[str],
    output: str,
    schema: T.StructType | str | Path,
    dirs: Sequence[str] | None = None,
    root: str = "data/raw",
    data_dict: str | Path | None = None,
    overwrite: bool = True,
    on_bad_value: str = "skip_file",
    on_corrupt: str = "skip",
    atomic: bool = False,
) -> DataFrame:
    """Read, clean, type and write the drops; returns the files with their errors and rows.

    Of each file's ``rows_read``, ``rows_kept`` are in the dataset and ``rows_skipped`` are
    not: rows with a wrong number of cells, and all rows of a file that was kept out. What
    could not be read to the end has no ``rows_read``.

    A cell that is not of its column's type keeps its whole file out and the other files
    in (``skip_file``), becomes null (``null``), or fails the job (``fail``). To keep files
    apart their rows are typed once into the shared scratch folder, with a flag that is
    then all that decides which of them are written. With ``atomic`` the output becomes a
    dataset with a manifest (``sources.snapshots``): it changes as a whole or not at all.
    """
    if on_bad_value not in ON_BAD_VALUE:
        raise ValueError(f"on_bad_value must be one of {ON_BAD_VALUE}, got {on_bad_value!r}")
    declared = schema if isinstance(schema, T.StructType) else load_schema(schema)
    with scratch_scope(spark):
        drop = read_drops(spark, year_directories(years, dirs, root), on_corrupt)
        files, kept = drop.files, None
        if drop.located is not None:
            mode = "flag" if on_bad_value == "skip_file" else on_bad_value
            rows = typed_rows(drop.located, declared, bool_vocabulary(data_dict), mode)
            if mode == "flag":
                rows = staged(rows, "typed")
                spoiled = staged(rows.filter(BAD_VALUES).select(FILE_URI).distinct(), "spoiled")
                if not spoiled.isEmpty():
                    rows = rows.join(spoiled, FILE_URI, "left_anti")
                    files = _report_spoiled(files, spoiled)
                rows = rows.drop(BAD_VALUES)
                kept = rows.groupBy(F.col(FILE_URI).alias("uri")).agg(F.count(F.lit(1)).alias("kept"))
            write_awards(rows.drop(FILE_URI), output, overwrite, atomic)
            kept = kept or _kept_rows(drop, output)
        files = _with_ledger(files, kept)
        report = scratch_dir(spark, "files", keep=True)
        files.write.parquet(report)
    return spark.read.schema(files.schema).parquet(report)


def typed_rows(
    text: DataFrame, declared: T.StructType, words: Vocabulary, on_bad_value: str
) -> DataFrame:
    """Cells typed, missing ones null: declared columns as declared, others inferred."""
    data = [name for name in text.columns if name not in (*LINEAGE, FILE_URI)]
    known = set(declared.fieldNames())
    extra = infer_fields(text, [name for name in data if name not in known], words)
    wanted = [field for field in declared.fields if field.name in data] + extra
    return type_cells(text, T.StructType(wanted), words, on_bad_value)


def _kept_rows(drop: Drop, output: str) -> DataFrame:
    """``uri`` and ``kept``: rows of each file in the dataset, by the footers of its folders.

    Files that share a folder are told apart by parsing these few once more.
    """
    spark = drop.files.sparkSession
    good = drop.files.filter(F.col("error").isNull()).select(
        "year", "uri", uri_file_id(uri_name(F.col("uri"))).alias("file")
    )
    shared = good.groupBy(*LINEAGE).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    years = [row[0] for row in good.select("year").distinct().collect()]
    counted = (
        read_awards(spark, output, LINEAGE, drop_years=years)
        .groupBy(*LINEAGE)
        .agg(F.count(F.lit(1)).alias("kept"))
    )
    kept = good.join(shared, LINEAGE, "left_anti").join(counted, LINEAGE).select("uri", "kept")
    if shared.isEmpty():
        return kept
    namesakes = good.join(shared, LINEAGE, "left_semi").select(F.col("uri").alias(FILE_URI))
    parsed = drop.located.join(namesakes, FILE_URI, "left_semi").groupBy(F.col(FILE_URI).alias("uri"))
    return kept.union(parsed.agg(F.count(F.lit(1)).alias("kept")))


def _with_ledger(files: DataFrame, kept: DataFrame | None) -> DataFrame:
    if kept is not None:
        files = files.join(kept, "uri", "left")
    found = F.col("kept") if kept is not None else F.lit(0)
    rows = F.coalesce(F.when(F.col("error").isNull(), found), F.lit(0)).cast("long")
    return files.select(
        *FILE_COLUMNS,
        rows.alias("rows_kept"),
        (F.col("rows_read") - rows).alias("rows_skipped"),
    )


def _report_spoiled(files: DataFrame, spoiled: DataFrame) -> DataFrame:
    marked = files.join(
        spoiled.select(F.col(FILE_URI).alias("uri"), F.lit(True).alias("_spoiled")), "uri", "left"
    )
    return marked.withColumn(
        "error", F.coalesce("error", F.when(F.col("_spoiled"), F.lit("has a bad value")))
    ).select(*files.columns)


def read_outlay_drops(
    spark: SparkSession, years_dirs: Sequence[tuple[str, str]], on_corrupt: str = "skip"
) -> tuple[Drop, DataFrame | None]:
    """The drops and, typed and renamed, the five columns of the outlay check.

    A broken file, or one without these columns, contributes nothing.
    """
    drop = read_drops(spark, years_dirs, on_corrupt, required=list(OUTLAY_COLUMNS))
    return drop, None if drop.rows is None else outlay_rows(drop.rows)

"""Datasets whose readers follow a manifest: whole commits, and folders passed over by range.

Data of a commit goes to a folder of its own under ``_data``. Then a manifest is written that
lists all live ``year``/``file`` folders, those of earlier commits that were not replaced
included; it counts once its ``_SUCCESS`` is there, which Spark writes last. Readers take the
latest manifest, so a job that dies at any point leaves the dataset as it was. The manifest
has the number of rows of each folder and the range of some columns in it: a filter on these
becomes a choice of folders before any file is opened.

One writer at a time: a second one is found out when it publishes, and fails.
"""

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import session_conf, writing
from .schema_json import merged_fields, stored_schema, store_schema

DATA, MANIFESTS = "_data", "_manifests"
YEAR, FILE = "year", "file"
#: Columns whose ranges are kept by default, where a dataset has them.
ZONE_COLUMNS = ("action_date_fiscal_year", "period_of_performance_current_end_date")


def _files(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(status.getPath().toString() for status in found or ())


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _published(spark: SparkSession, path: str) -> list[str]:
    """Folders of the complete manifests, the latest last."""
    marks = _files(spark, f"{path}/{MANIFESTS}/*/_SUCCESS")
    return [mark.rpartition("/")[0] for mark in marks]


def _version(manifest: str) -> int:
    return int(manifest.rpartition("/")[2].partition("-")[0])


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the manifest that readers of the dataset follow, if it has one."""
    published = _published(spark, path.rstrip("/"))
    return published[-1] if published else None


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def _zones(kinds: Mapping[str, T.DataType]) -> list[Column]:
    out = []
    for name in kinds:
        out += [F.min(f"`{name}`").alias(f"low {name}"), F.max(f"`{name}`").alias(f"high {name}")]
    return out


def commit(
    df: DataFrame, path: str, overwrite: bool = True, zone_columns: Sequence[str] = ZONE_COLUMNS
) -> DataFrame:
    """Make the rows part of the dataset, all or none; folders of the same name are replaced.

    Returns ``year``, ``file``, ``rows`` and the ranges of the folders written. They are taken
    from the written files, of which only the columns in question are read.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    before = current(spark, path)
    if before is None and _files(spark, f"{path}/*"):
        if _files(spark, f"{path}/{YEAR}=*"):
            raise FileExistsError(f"{path} holds data without a manifest")
    if before is not None and not overwrite:
        raise FileExistsError(f"{path} already exists")
    version = 1 if before is None else _version(before) + 1
    name = f"{version:012d}-{uuid.uuid4().hex}"
    target = f"{path}/{DATA}/{name}"
    with writing(spark):
        (
            df.write.option("compression", "zstd")
            .option("parquet.compression.codec.zstd.level", "9")
            .partitionBy(YEAR, FILE)
            .parquet(target)
        )
    data = [field for field in df.schema.fields if field.name not in (YEAR, FILE)]
    kinds = {f.name: f.dataType for f in data if f.name in zone_columns}
    written = T.StructType(data + [df.schema[YEAR], df.schema[FILE]])
    facts = (
        _read_folder(spark, target, written)
        .groupBy(YEAR, FILE)
        .agg(F.count(F.lit(1)).alias("rows"), *_zones(kinds))
        .withColumn("folder", F.lit(name))
    )
    old = None if before is None else _manifest(spark, before)
    manifest = f"{path}/{MANIFESTS}/{name}"
    schema = merged_fields(None if before is None else stored_schema(spark, before), written)
    store_schema(spark, manifest, schema)
    live = facts if old is None else _replaced(old, facts)
    live.coalesce(1).write.mode("append").parquet(manifest)
    others = [m for m in _published(spark, path) if _version(m) == version and not m.endswith(name)]
    if others:
        _delete(spark, manifest)
        raise RuntimeError(f"another job has written version {version} of {path}")
    return _manifest(spark, manifest).filter(F.col("folder") == name).drop("folder")


def _replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the old manifest but those of the same year and file, and the new rows.

    A range that has no place in a column's new type is dropped: its folder is then read.
    """
    kinds = dict(new.dtypes)
    casts = {
        name: F.col(f"`{name}`").try_cast(kinds[name])
        for name, kind in old.dtypes
        if name in kinds and kinds[name] != kind
    }
    kept = old.join(
        new.select(F.col(YEAR).alias("new year"), F.col(FILE).alias("new file")),
        F.col(YEAR).eqNullSafe(F.col("new year")) & F.col(FILE).eqNullSafe(F.col("new file")),
        "left_anti",
    )
    return kept.withColumns(casts).unionByName(new, allowMissingColumns=True)


def _read_folder(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    with session_conf(spark, {"spark.sql.sources.partitionColumnTypeInference.enabled": "false"}):
        return spark.read.schema(schema).parquet(folder)


def folders(
    spark: SparkSession,
    manifest: str,
    drop_years: Sequence[str] | None = None,
    between: Mapping[str, tuple] | None = None,
) -> DataFrame:
    """The manifest's rows of folders that can hold rows of these years and ranges.

    A folder without a known range, or with nulls only, is taken as one that can.
    """
    live = _manifest(spark, manifest)
    if drop_years is not None:
        live = live.filter(F.col(YEAR).isin(*map(str, drop_years)))
    for name, (low, high) in (between or {}).items():
        if f"low {name}" in live.columns:
            below, above = F.col(f"`high {name}`") < F.lit(low), F.col(f"`low {name}`") > F.lit(high)
            outside = F.lit(False)
            outside = outside | F.coalesce(below, F.lit(False)) if low is not None else outside
            outside = outside | F.coalesce(above, F.lit(False)) if high is not None else outside
            live = live.filter(~outside)
    return live


def read(
    spark: SparkSession,
    path: str,
    manifest: str,
    drop_years: Sequence[str] | None = None,
    between: Mapping[str, tuple] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Rows of the folders in question; ``between`` still has to be applied to the rows."""
    chosen = folders(spark, manifest, drop_years, between)
    return scan(spark, path, chosen, schema or stored_schema(spark, manifest))


def scan(
    spark: SparkSession,
    path: str,
    chosen: DataFrame,
    schema: T.StructType,
    commit_column: str | None = None,
) -> DataFrame:
    """Rows of the folders ``chosen`` from a manifest, with the commit that they are of if asked for.

    Only names of folders come to the driver, as when Spark lists a dataset. Each commit
    that has live folders is a scan with a filter on its partitions.
    """
    path = path.rstrip("/")
    key = lambda: F.concat_ws("/", F.coalesce(YEAR, F.lit("")), F.coalesce(FILE, F.lit("")))
    by_commit: dict[str, list[str]] = {}
    for folder, name in chosen.select("folder", key()).collect():
        by_commit.setdefault(folder, []).append(name)
    scans = [
        _read_folder(spark, f"{path}/{DATA}/{folder}", schema).filter(key().isin(*names))
        for folder, names in sorted(by_commit.items())
    ] or [spark.createDataFrame([], schema)]
    if commit_column is not None:
        commits = [*sorted(by_commit)] or [""]
        scans = [rows.withColumn(commit_column, F.lit(of)) for rows, of in zip(scans, commits, strict=True)]
    return reduce(DataFrame.unionByName, scans)


def remove_unreferenced(spark: SparkSession, path: str) -> list[str]:
    """Delete manifests but the current one, and data that it does not list.

    To be run when no reader of an earlier manifest and no writer is at work.
    """
    path = path.rstrip("/")
    manifest = current(spark, path)
    if manifest is None:
        return []
    live = {row[0] for row in _manifest(spark, manifest).select("folder").distinct().collect()}
    gone = [f for f in _files(spark, f"{path}/{DATA}/*") if f.rpartition("/")[2] not in live]
    gone += [f for f in _files(spark, f"{path}/{MANIFESTS}/*") if f.rpartition("/")[2] != manifest.rpartition("/")[2]]
    for folder in gone:
        _delete(spark, folder)
    return gone

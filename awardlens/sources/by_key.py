"""Rows laid out by a key, so that filters and totals by key don't shuffle the wide rows.

A layout is a folder with three parts: the rows of ordinary keys as a Parquet table bucketed
and sorted by the key; the rows of *heavy* keys, which would fill a bucket on their own, and
those without a key, as plain Parquet; and the list of heavy keys. The wide rows are shuffled
once, when the layout is written. After that a key filter moves keys only, and totals are
added up where a bucket is read; the heavy rows are added up on the map side first.

The layout counts once its description is there, which is written last.
"""

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import measured, writing
from . import snapshots

ROWS, HEAVY, HEAVY_KEYS, DESCRIPTION = "rows", "heavy", "heavy-keys", "_layout"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class KeyedRows:
    """A layout as it is read; ``of_commit`` is the manifest of the dataset it was made of."""

    key: str
    light: DataFrame
    heavy: DataFrame
    heavy_keys: DataFrame
    of_commit: str | None

    def rows(self, columns: Sequence[str] | None = None) -> DataFrame:
        """All rows, those without a key included."""
        names = self.light.columns if columns is None else columns
        chosen = [_quoted(name) for name in names]
        return self.light.select(*chosen).unionByName(self.heavy.select(*chosen))

    def _parts(self, keys: DataFrame | None, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        chosen = [_quoted(name) for name in dict.fromkeys([self.key, *columns])]
        light, heavy = self.light.select(*chosen), self.heavy.select(*chosen)
        if keys is None:
            return light, heavy
        wanted = keys.select(F.col(_quoted(self.key)).cast(dict(light.dtypes)[self.key])).distinct()
        # Heavy keys are few; with the size of those wanted known, Spark needn't shuffle their rows.
        few = measured(self.heavy_keys.join(wanted, self.key, "left_semi"))
        return light.join(wanted, self.key, "left_semi"), heavy.join(few, self.key, "left_semi")

    def of_keys(self, keys: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """Rows whose key occurs in ``keys``; each row once. A null key matches nothing."""
        names = self.light.columns if columns is None else list(columns)
        light, heavy = self._parts(keys, names)
        return light.unionByName(heavy).select(*(_quoted(name) for name in names))

    def totals(
        self, totals: Sequence[Column], columns: Sequence[str], keys: DataFrame | None = None
    ) -> DataFrame:
        """One row per key, of all keys or of those in ``keys``, with ``totals`` over ``columns``.

        Rows without a key are one group, unless ``keys`` are given.
        """
        parts = [part.groupBy(_quoted(self.key)).agg(*totals) for part in self._parts(keys, columns)]
        return parts[0].unionByName(parts[1])


def write_by_key(
    df: DataFrame,
    path: str,
    key: str,
    buckets: int = 64,
    heavy_rows: int = 1_000_000,
    of_commit: str | None = None,
) -> KeyedRows:
    """Lay out the rows in a new folder. ``df`` is read four times, so it should be a dataset.

    Keys with more than ``heavy_rows`` rows are heavy: there are at most rows / ``heavy_rows``
    of them. Choose ``buckets`` so that a bucket, read with all its columns, fits a task.
    """
    if buckets < 1 or heavy_rows < 1:
        raise ValueError("buckets and heavy_rows must be at least 1")
    spark, path, name = df.sparkSession, path.rstrip("/"), _quoted(key)
    if _description(spark, path) is not None:
        raise FileExistsError(f"{path} already holds a layout")
    many = df.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    with writing(spark):
        many.filter(F.col("_n") > heavy_rows).select(name).write.parquet(f"{path}/{HEAVY_KEYS}")
    heavy_keys = spark.read.schema(T.StructType([df.schema[key]])).parquet(f"{path}/{HEAVY_KEYS}")
    table = _table(spark, path, df.schema, key, buckets)
    with writing(spark, _one_shuffle(buckets)):
        _heavy_rows(df, heavy_keys, key).write.parquet(f"{path}/{HEAVY}")
        (
            _light_rows(df, heavy_keys, key, buckets)
            .write.mode("append")
            .format("parquet")
            .option("compression", "zstd")
            .bucketBy(buckets, key)
            .sortBy(key)
            .saveAsTable(table)
        )
    told = {"key": key, "buckets": buckets, "of_commit": of_commit, "schema": df.schema.jsonValue()}
    text = spark.createDataFrame([(json.dumps(told),)], "value string")
    text.coalesce(1).write.text(f"{path}/{DESCRIPTION}")
    return read_by_key(spark, path)


def _one_shuffle(buckets: int) -> dict[str, str]:
    """Settings by which wide rows are shuffled and sorted once, also where heavy keys are many.

    A join by key then deals its rows to the buckets already, and holds a bucket's heavy keys,
    which are few beside its rows, in a table of at most so many bytes rather than sort its rows.
    """
    return {
        "spark.sql.shuffle.partitions": str(buckets),
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    }


def _heavy_rows(df: DataFrame, heavy_keys: DataFrame, key: str) -> DataFrame:
    """The rows of heavy keys, and those without a key, which needn't be shuffled for it."""
    columns, name = [_quoted(column) for column in df.columns], _quoted(key)
    known = df.filter(F.col(name).isNotNull()).join(heavy_keys, key, "left_semi").select(*columns)
    return known.unionByName(df.filter(F.col(name).isNull()))


def _light_rows(df: DataFrame, heavy_keys: DataFrame, key: str, buckets: int) -> DataFrame:
    """The rows of other keys, dealt to the buckets."""
    columns, name = [_quoted(column) for column in df.columns], _quoted(key)
    known = df.filter(F.col(name).isNotNull()).join(heavy_keys, key, "left_anti").select(*columns)
    return known.repartition(buckets, F.col(name))


def read_by_key(spark: SparkSession, path: str, dataset: str | None = None) -> KeyedRows:
    """The layout in ``path``, also in another session than the one that wrote it.

    With ``dataset``, it is an error if the layout was made of another commit than the present.
    """
    path = path.rstrip("/")
    told = _description(spark, path)
    if told is None:
        raise FileNotFoundError(f"{path} holds no complete layout")
    if dataset is not None and told["of_commit"] != snapshots.current(spark, dataset):
        raise ValueError(f"{path} is behind {dataset}: write it anew")
    schema, key = T.StructType.fromJson(told["schema"]), told["key"]
    table = _table(spark, path, schema, key, told["buckets"])
    spark.catalog.refreshTable(table)
    return KeyedRows(
        key,
        spark.table(table),
        spark.read.schema(schema).parquet(f"{path}/{HEAVY}"),
        spark.read.schema(T.StructType([schema[key]])).parquet(f"{path}/{HEAVY_KEYS}"),
        told["of_commit"],
    )


def forget(spark: SparkSession, path: str) -> None:
    """Take the layout's table out of the session's catalogue; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {_table_name(path.rstrip('/'))}")


def _description(spark: SparkSession, path: str) -> dict | None:
    try:
        row = spark.read.text(f"{path}/{DESCRIPTION}").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row and json.loads(row[0])


def _table_name(path: str) -> str:
    return f"rows_by_key_{hashlib.md5(path.encode()).hexdigest()}"


def _table(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int) -> str:
    """Name of the catalogue's entry for the bucketed files, which tells Spark of the buckets."""
    name, location = _table_name(path), f"{path}/{ROWS}".replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({schema.toDDL()}) USING parquet"
        f" CLUSTERED BY ({_quoted(key)}) SORTED BY ({_quoted(key)}) INTO {buckets} BUCKETS LOCATION '{location}'"
    )
    return name

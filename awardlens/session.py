"""Session helpers: shared scratch space, scoped settings, measured small tables."""

import tempfile
import uuid
from collections.abc import Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OPEN_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession):
    """Remove at the end what is staged inside the ``with`` block.

    Results that are still lazy on it must be written or collected inside.
    """
    _OPEN_SCOPES.append([])
    try:
        yield
    finally:
        for path in _OPEN_SCOPES.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_dir(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder for one run, inside the shared folder in ``spark.checkpoint.dir``.

    ``keep``: it outlives an open ``scratch_scope``.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="awardlens-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _OPEN_SCOPES and not keep:
        _OPEN_SCOPES[-1].append(path)
    return path


@contextmanager
def session_conf(spark: SparkSession, settings: dict[str, str]):
    """Apply SQL settings for the length of a ``with`` block."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


@contextmanager
def writing(spark: SparkSession, settings: Mapping[str, str] | None = None):
    """For a ``with`` block that writes: what a write has shuffled goes when it ends.

    Otherwise shuffle files stay until the driver happens to collect its garbage, and lie on the
    disks beside what later steps write. ``settings`` hold in the block besides.
    """
    own = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        # A task that writes few folders keeps their files open instead of sorting its rows.
        "spark.sql.maxConcurrentOutputFileWriters": "32",
    }
    with session_conf(spark, own | dict(settings or {})):
        yield


def measured(df: DataFrame) -> DataFrame:
    """Keep a small aggregate in memory so that the planner knows its true size.

    Joins with it are then broadcast only when that size is below
    ``spark.sql.autoBroadcastJoinThreshold``, and shuffled otherwise. A lost executor
    only costs a recomputation: the lineage stays.
    """
    kept = df.persist()
    kept.count()
    return kept


def staged(
    df: DataFrame,
    name: str,
    partition_by: Sequence[str] = (),
    compression: str = "snappy",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Write ``df`` once as Parquet in the shared scratch folder and read it from there.

    For input that several passes read: the passes then scan only the columns they need,
    do not repeat the joins or parsing behind ``df``, and survive lost executors. ``options``
    go to the Parquet writer.
    """
    path = scratch_dir(df.sparkSession, name)
    with writing(df.sparkSession):
        write = df.write.option("compression", compression).options(**(options or {}))
        write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

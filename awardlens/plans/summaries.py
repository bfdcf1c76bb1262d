"""Small results kept per drop file, so that a new drop costs no scan of the others.

A summary is a dataset of its own, with a manifest, laid out by ``year`` and ``file`` like the
one it is of. Its manifest tells of which commit each file's rows were made. A refresh reads
only the files whose commit is another one now and replaces their rows, all or none; what a
job that dies leaves behind does not count.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quantiles import Proposal
from ..operators.sampling import draw_of, exact_sample, prefix_counts
from ..sources import snapshots
from ..sources.drops import LINEAGE
from ..sources.schema_json import stored_schema
from ..sources.tables import read_awards
from .funding import funding_rollup

OF_COMMIT = "of_commit"
#: Per file, commit and whatever else; the rows of a file must depend on that file alone.
Summary = Callable[[DataFrame, Sequence[str]], DataFrame]


def stale_files(spark: SparkSession, dataset: str, summary: str) -> DataFrame:
    """``year``, ``file`` and ``folder`` (commit) of files that the summary lacks as they are now."""
    live = _live(spark, dataset).select(*LINEAGE, "folder")
    kept = snapshots.current(spark, summary)
    if kept is None:
        return live
    known = snapshots.folders(spark, kept).select(
        F.col("year").alias("known year"),
        F.col("file").alias("known file"),
        F.col(f"low {OF_COMMIT}").alias("known commit"),
    )
    same = F.col("year").eqNullSafe(F.col("known year")) & F.col("file").eqNullSafe(F.col("known file"))
    return live.join(known, same & (F.col("folder") == F.col("known commit")), "left_anti")


def _live(spark: SparkSession, dataset: str) -> DataFrame:
    manifest = snapshots.current(spark, dataset)
    if manifest is None:
        raise ValueError(f"{dataset} has no manifest: write it with atomic=True")
    return snapshots.folders(spark, manifest)


def refresh(
    spark: SparkSession, dataset: str, summary: str, summarise: Summary = funding_rollup
) -> DataFrame:
    """Bring the summary up to date; returns the files read for it, with their summary rows.

    ``summarise(rows, per)`` gives rows that hold the columns ``per``: year, file and commit.
    """
    stale = stale_files(spark, dataset, summary)
    schema = stored_schema(spark, snapshots.current(spark, dataset))
    rows = snapshots.scan(spark, dataset, stale, schema, OF_COMMIT)
    if stale.isEmpty():
        return stale.select(*LINEAGE, F.lit(0).cast("long").alias("rows"))
    found = summarise(rows, [*LINEAGE, OF_COMMIT])
    # A file's few rows go to one task, which writes them to one file.
    placed = found.repartition(*(F.col(name) for name in LINEAGE))
    written = snapshots.commit(placed, summary, zone_columns=(OF_COMMIT,))
    return written.select(*LINEAGE, "rows")


def read_summary(spark: SparkSession, dataset: str, summary: str) -> DataFrame:
    """The rows kept of all files; an error if the dataset has changed since the refresh."""
    if not stale_files(spark, dataset, summary).isEmpty():
        raise ValueError(f"{summary} is behind {dataset}: refresh it first")
    return read_awards(spark, summary).drop(OF_COMMIT)


def value_sketches(columns: Sequence[str], k: int = 2000) -> Summary:
    """Per file and column: rows with a value, the exact range, and a KLL sketch (some 10 KB).

    NaN ranks above all values. It is in the counts and the range but not in the sketch.
    """

    def sketches(rows: DataFrame, per: Sequence[str]) -> DataFrame:
        named = [
            F.struct(F.lit(name).alias("column"), F.col(f"`{name}`").cast("double").alias("v"))
            for name in columns
        ]
        values = rows.select(*per, F.explode(F.array(*named)).alias("cell")).select(*per, "cell.*")
        number = F.when(~F.isnan("v"), F.col("v"))
        return values.groupBy(*per, "column").agg(
            F.count("v").alias("values"),
            F.min("v").alias("low"),
            F.max("v").alias("high"),
            F.kll_sketch_agg_double(number, F.lit(k)).alias("sketch"),
        )

    return sketches


def proposal(sketches: DataFrame, column: str) -> Proposal:
    """The files' sketches of a column put together, for ``operators.quantiles``.

    One row comes to the driver; its size doesn't depend on the number of rows or files.
    """
    of_column = sketches.filter(F.col("column") == column)
    whole = of_column.agg(
        F.coalesce(F.sum("values"), F.lit(0)).alias("rows"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    ).first()
    spark = sketches.sparkSession

    def likely(shares: Sequence[float]) -> list[float]:
        if whole["low"] is None or whole["low"] != whole["low"]:  # no value, or NaN alone
            return [whole["low"]] * len(shares)
        one = spark.createDataFrame([(whole["sketch"],)], "sketch binary")
        asked = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))) for q in shares]
        return list(one.select(*asked).first())

    return Proposal(whole["rows"], whole["low"], whole["high"], likely)


OF_DRAWS = "of_draws"


def draw_counts(columns: Sequence[str], seed: int, strata: Sequence[str] = ()) -> Summary:
    """Per file, stratum and first digits of the draw over ``columns``: rows.

    At most 65,536 rows per file and stratum. ``of_draws`` tells what the draws are made of, the
    columns' types included, so that counts of other draws are never added up with these.
    """

    def counts(rows: DataFrame, per: Sequence[str]) -> DataFrame:
        drawn = rows.withColumn("_draw", draw_of(rows, columns, seed))
        told = _made_of(rows, columns, seed)
        return prefix_counts(drawn, [*dict.fromkeys([*per, *strata])]).withColumn(OF_DRAWS, F.lit(told))

    return counts


def _made_of(rows: DataFrame, columns: Sequence[str], seed: int) -> str:
    kinds = dict(rows.dtypes)
    return "|".join([str(seed), *(f"{name} {kinds[name]}" for name in columns)])


def sample_from_counts(
    rows: DataFrame, counts: DataFrame, fraction: float, seed: int, strata: Sequence[str] = ()
) -> DataFrame:
    """``exact_sample`` of the rows of a dataset, by the counts kept of its files.

    The columns of ``rows`` are those the draws were made of. The cuts come from the counts, so
    the dataset is read once; counts of another seed, other columns or types are an error.
    """
    told = _made_of(rows, rows.columns, seed)
    other = counts.filter(~F.col(OF_DRAWS).eqNullSafe(F.lit(told))).select(OF_DRAWS).first()
    if other is not None:
        raise ValueError(f"counts are of the draws {other[0]!r}, not {told!r}")
    return exact_sample(rows, fraction, seed, strata, counts=counts)

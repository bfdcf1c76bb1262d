"""Helpers shared by the corpus operators."""

import gc
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that count as white space, as a class for Java and Python patterns.
WHITE = r"[\x20\x09-\x0D]"
#: Texts are handed to the per-text functions in runs of about this many characters.
RUN_CHARS = 4_000_000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, should they lack it."""
    if getattr(spark.sparkContext, "_awardlens_sent", False):
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="awardlens-code-")
    copy = shutil.copytree(
        package, f"{folder}/src/{package.name}", ignore=shutil.ignore_patterns("__pycache__")
    )
    archive = shutil.make_archive(f"{folder}/awardlens", "zip", Path(copy).parent)
    spark.sparkContext.addPyFile(archive)
    spark.sparkContext._awardlens_sent = True


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text``, null text as the empty text.

    Whatever other columns the input has, and whatever their names, they end here.
    """
    ship(docs.sparkSession)
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def shared_file(spark: SparkSession, path: str) -> Broadcast:
    """The bytes of a vocabulary file (a few MB, whatever the corpus), read once by the driver."""
    data = Path(path).read_bytes()
    if len(data) > 64_000_000:
        raise ValueError(f"{path} is no vocabulary file: {len(data)} bytes")
    return spark.sparkContext.broadcast(data)


def runs(batches: Iterator[pa.RecordBatch], text_col: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``RUN_CHARS`` bytes of text, one row at least."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(text_col))
        start, size = 0, 0
        for row, length in enumerate(pa.compute.binary_length(text).to_pylist()):
            size += length or 0
            if size >= RUN_CHARS:
                yield batch.slice(start, row + 1 - start)
                start, size = row + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def keep_rows(docs: DataFrame, accept: Callable, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, whose text ``accept(list of texts)`` says yes to.

    One pass without shuffle or join: the decision needs nothing but the text (null: empty).
    """

    ship(docs.sparkSession)

    def kept(batches):
        for batch in runs(batches, text_col):
            column = batch.column(batch.schema.get_field_index(text_col))
            texts = [text or "" for text in column.to_pylist()]
            yield batch.filter(pa.array(accept(texts), pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


_RESIDENT: dict = {}


def resident(family: str, key, make: Callable):
    """What a worker process keeps from task to task for the operator it works for.

    A worker outlives its tasks and may come to serve other operators: state of another
    ``family`` is let go, so that vocabularies and memories of words never add up.
    """
    if len(_RESIDENT) > 3 or any(kept_family != family for kept_family, _ in _RESIDENT):
        _RESIDENT.clear()
        gc.collect()
    if (family, key) not in _RESIDENT:
        _RESIDENT[family, key] = make()
    return _RESIDENT[family, key]


class WordCache(dict):
    """Word -> value of ``compute``, two generations of at most ``limit`` words each.

    When the young generation is full it becomes the old one; words met again come back.
    """

    def __init__(self, compute: Callable, limit: int = 200_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.compute(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value

    def put(self, word, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = value


def bounded_sample(
    docs: DataFrame,
    by: str,
    per_group: int,
    seed: int = 7,
    max_groups: int = 1000,
    shape: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """At most ``per_group`` different rows for each value of ``by``, picked by a hash of them.

    The hash is of the whole row, so rows that share an id, or have none, are drawn each on
    its own; equal rows count once. Different rows are estimated per group first, so that
    only those with a low hash, a few times ``per_group`` whatever the size of the group, go
    on. ``shape`` may narrow these before they are shuffled and ranked; it has to keep ``by``
    and the two columns whose names begin with ``sample``. Rows with a null ``by`` are left
    out, and all but the ``max_groups`` values of ``by`` with the most rows.
    """
    from pyspark.sql import Window

    mark = F.xxhash64(F.lit(seed), *(F.col(f"`{name}`") for name in docs.columns))
    marked = docs.where(F.col(f"`{by}`").isNotNull()).withColumn("sample mark", mark)
    sizes = (
        marked.groupBy(by)
        .agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("sample mark").alias("different"))
        .orderBy(F.desc("n"), by)
        .limit(max_groups)
        .collect()
    )
    # Uniform in [0, 1): the share of a group that is looked at is 4 times what is taken.
    draw = F.pmod(F.col("sample mark"), F.lit(1 << 30)) / float(1 << 30)
    cut = F.lit(-1.0)
    for value, _, different in sizes:
        share = min(1.0, (4 * per_group + 64) / max(1, different))
        cut = F.when(F.col(by) == F.lit(value), F.lit(share)).otherwise(cut)
    drawn = marked.withColumn("sample draw", draw).where(F.col("sample draw") < cut)
    drawn = (shape(drawn) if shape else drawn).dropDuplicates([by, "sample mark"])
    order = Window.partitionBy(by).orderBy("sample draw", "sample mark")
    return (
        drawn.withColumn("sample rank", F.row_number().over(order))
        .where(F.col("sample rank") <= per_group)
        .drop("sample draw", "sample mark", "sample rank")
    )

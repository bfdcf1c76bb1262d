"""Exact dedup against a persistent index of text digests."""

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir, staged
from .common import WHITE


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with each run of white space as one space; null counts as empty."""
    one_spaced = F.regexp_replace(F.coalesce(text, F.lit("")), f"{WHITE}+", " ")
    return F.unhex(F.sha2(one_spaced, 256))


class DigestIndex:
    """Digests of all texts seen so far, each with the document that stays for it.

    A Parquet table in ``location``, bucketed and sorted by digest. It outlives the
    session: an index opened again at its location is the same index. ``buckets`` is fixed
    when it is created and part of the folder's name; choose it so that a bucket of the
    grown index fits a task.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        path = f"{location.rstrip('/')}/digests-{buckets}"
        self.name = f"digest_index_{hashlib.md5(path.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        spark.catalog.refreshTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, firsts: DataFrame) -> None:
        """Append the rows (``digest``, ``keep_id``) whose digest the index lacks.

        The index side of the anti-join is read bucket by bucket without a shuffle.
        """
        fresh = firsts.select("digest", "keep_id").join(
            self.table().select("digest").hint("merge"), "digest", "left_anti"
        )
        (
            fresh.repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)

    def deduplicate(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Check a batch of documents against the index and add its new texts.

        One row per row of the batch: ``doc_id``, ``digest``, ``keep_id`` (the document
        that stays for this text, of the index or else the smallest of the batch),
        ``group_size`` (rows of the batch with this text), ``kept``. A batch that is sent
        again, after a failure, keeps what it kept.

        Texts are read once; all that follows works on digests. Counts are combined before
        they are shuffled, and the join that hands results back to the rows is one that
        Spark splits where a digest is frequent.

        Null text counts as empty. A null ``doc_id`` ranks behind all others. Of repeated
        rows (same ``doc_id``, same text) one is kept. An empty batch gives no rows. Other
        columns are ignored.
        """
        rows = staged(
            docs.select(
                F.col("doc_id"),
                text_digest(F.col(text_col)).alias("digest"),
                F.monotonically_increasing_id().alias("row"),
            ),
            "digests",
        )
        order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
        firsts = staged(
            rows.groupBy("digest")
            .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
            .select(
                "digest",
                F.col("first.doc_id").alias("keep_id"),
                F.col("first.row").alias("first_row"),
                "group_size",
            ),
            "firsts",
        )
        self.add(firsts)
        first = F.col("first_row") == F.col("row")
        found = staged(
            firsts.select("digest", "first_row", "group_size").join(
                self.table().hint("merge"), "digest"
            ),
            "found",
        )
        return rows.join(found.hint("merge"), "digest").select(
            "doc_id",
            "digest",
            "keep_id",
            "group_size",
            (first & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        )


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index of its own in the shared scratch folder, a bucket per shuffle partition."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex(spark, scratch_dir(spark, "digest-index"), buckets)


def drop_copies(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are left out by ``doc_id``. Where a ``doc_id`` occurs more than once, its rows are
    told apart by digest, and rows alike in both are reduced to one.
    """
    found = staged(index.deduplicate(docs).select("doc_id", "digest", "kept"), "decisions")
    repeated = staged(
        found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"),
        "repeated",
    )
    some_repeat = not repeated.isEmpty()
    leave = found.where("NOT kept").select("doc_id")
    rows = _by_id(docs, leave.union(repeated) if some_repeat else leave, "left_anti")
    if some_repeat:
        kept = _by_id(found.where("kept"), repeated, "left_semi").select("doc_id", "digest")
        again = _by_id(docs, repeated, "left_semi")
        digest, kept_id = "kept digest", "kept id"
        while digest in docs.columns or kept_id in docs.columns:
            digest, kept_id = digest + "'", kept_id + "'"
        again = again.withColumn(digest, text_digest(F.col("text")))
        once = again.dropDuplicates(["doc_id", digest]).join(
            kept.select(F.col("doc_id").alias(kept_id), F.col("digest").alias(f"{digest}s")),
            F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(digest) == F.col(f"{digest}s")),
            "left_semi",
        )
        rows = rows.unionByName(once.drop(digest))
    return rows


def _by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    named = ids.select(F.col("doc_id").alias("listed id"))
    return docs.join(named, docs["doc_id"].eqNullSafe(named["listed id"]), how)

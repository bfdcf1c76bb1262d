"""Ranked lexical search by norm buckets: long vectors first, bounds before exact scores."""

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged
from .common import runs, texts_of

#: ASCII without letters and digits separates terms; A-Z are lower-cased; other characters count.
TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)
#: Vectors that share a bucket inside a task.
BUCKET = 4096
#: Items that are searched in one pass over the documents.
ITEM_BLOCK = 1000
#: The longest vectors, one of so many, are searched first to learn how high the k-th score is.
FIRST_SHARE = 32
#: What a bound in floating point may be too low by.
SLACK = 1 + 1e-9


def terms_of(text: bytes) -> list[bytes]:
    """Terms of UTF-8 text: runs of ASCII letters and digits, lower-cased, and all non-ASCII."""
    return text.translate(TABLE).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_scale(n, n_docs: int, n_terms: int):
    """``m`` of documents with ``n`` terms."""
    return 100 - 50 + (50 * n * n_docs) // n_terms


def impacts_of(tf, m, weights):
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


# ---- inside a task -----------------------------------------------------------------------


class Best:
    """The ``k`` highest-scoring documents of an item, equal scores by ascending id."""

    def __init__(self, k: int, least: int):
        self.k, self.least, self.rows = k, max(1, least), []

    def add(self, scores: np.ndarray, docs: list) -> None:
        self.rows += [(-s, d is None, d) for s, d in zip(scores.tolist(), docs, strict=True)]
        self.rows.sort(key=lambda row: (row[0], row[1], 0 if row[1] else row[2]))
        del self.rows[self.k :]
        if len(self.rows) == self.k:
            self.least = max(self.least, -self.rows[-1][0])


class Bucket:
    """Impact vectors of some documents, by row and by coordinate."""

    def __init__(self, docs, starts, terms, impacts, norms, n_terms: int):
        self.docs, self.starts, self.terms, self.impacts, self.norms = docs, starts, terms, impacts, norms
        self.longest = float(norms.max())
        order = np.argsort(terms, kind="stable")
        rows = np.repeat(np.arange(len(norms)), np.diff(starts))
        self.rows, self.column_impacts = rows[order], impacts[order]
        self.column_starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.highest = np.zeros(n_terms, np.int64)
        filled = np.flatnonzero(np.diff(self.column_starts))
        if len(filled):
            self.highest[filled] = np.maximum.reduceat(
                self.column_impacts, self.column_starts[filled]
            )

    def candidates(self, item: np.ndarray, least: int) -> np.ndarray:
        """Rows that no bound shows to score below ``least``.

        Cauchy-Schwarz first: the item's vector holds ones, so no score exceeds the root of
        its length times the longest vector. Then coordinates: with the highest impact of
        each in this bucket, a row that has none of the leading terms cannot get there. Of
        the rows that have some, what is still to come is bounded by the coordinates and by
        Cauchy-Schwarz on the rest of the vector.
        """
        nothing = np.empty(0, np.int64)
        if math.sqrt(len(item)) * self.longest * SLACK < least:
            return nothing
        highest = self.highest[item]
        order = np.argsort(-highest, kind="stable")
        to_come = np.append(np.cumsum(highest[order][::-1])[::-1], 0)
        if to_come[0] < least:
            return nothing
        leading = int(np.argmax(to_come < least)) if to_come[-1] < least else len(item)
        spans = [
            slice(self.column_starts[t], self.column_starts[t + 1]) for t in item[order[:leading]]
        ]
        rows = np.concatenate([self.rows[span] for span in spans])
        found = np.concatenate([self.column_impacts[span] for span in spans]).astype(np.float64)
        part = np.bincount(rows, found, len(self.norms))
        square = np.bincount(rows, found * found, len(self.norms))
        rest = np.sqrt(np.maximum(self.norms * self.norms * SLACK - square, 0))
        rest = np.minimum(rest * math.sqrt(len(item) - leading), to_come[leading])
        return np.flatnonzero((part > 0) & ((part + rest) * SLACK >= least))

    def scores(self, item: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of the rows, in integers. ``wanted`` is scratch, all False."""
        wanted[item] = True
        sizes = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        entries = np.arange(ends[-1]) + np.repeat(self.starts[rows] - (ends - sizes), sizes)
        impacts = np.where(wanted[self.terms[entries]], self.impacts[entries], 0)
        wanted[item] = False
        return np.add.reduceat(impacts, ends - sizes)


def _columns(batch: pa.RecordBatch) -> tuple:
    """Offsets, terms and counts of a batch of vectors."""
    terms, counts = batch.column("terms"), batch.column("counts")
    offsets = terms.offsets.to_numpy().astype(np.int64)
    return (
        offsets - offsets[0],
        terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
        counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
    )


def search_bucket(bucket: Bucket, items: Sequence, best: Sequence[Best], wanted: np.ndarray) -> None:
    for item, found in zip(items, best, strict=True):
        rows = bucket.candidates(item, found.least)
        if len(rows):
            scores = bucket.scores(item, rows, wanted)
            good = np.flatnonzero(scores >= found.least)
            found.add(scores[good], [bucket.docs[row] for row in rows[good]])


# ---- over the corpus ---------------------------------------------------------------------


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id``, ``n`` (its terms), and of the vocabulary's terms numbers and ``counts``."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("n", T.LongType()),
            T.StructField("terms", T.ArrayType(T.IntegerType())),
            T.StructField("counts", T.ArrayType(T.IntegerType())),
        ]
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in runs(batches):
            sizes, ends, terms, counts = [], [0], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = terms_of(text)
                sizes.append(len(words))
                for word, count in Counter(words).items():
                    if (at := number.get(word)) is not None:
                        terms.append(at)
                        counts.append(count)
                ends.append(len(terms))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts, pa.int32())),
                ],
                ["doc_id", "n", "terms", "counts"],
            )

    return docs.mapInArrow(counted, schema)


def by_length(counted: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """The vectors that hold any term, with ``m`` and ``norm``, the longest first.

    Ranges of ``norm`` become partitions; a hash of the row parts equal norms as well, so
    that copies and documents of a kind don't meet in one.
    """
    shared = counted.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType(
        [
            counted.schema["doc_id"],
            T.StructField("m", T.LongType()),
            T.StructField("norm", T.DoubleType()),
            T.StructField("spread", T.IntegerType()),
            counted.schema["terms"],
            counted.schema["counts"],
        ]
    )

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, terms, tf = _columns(batch)
            m = length_scale(batch.column("n").to_numpy(), n_docs, n_terms)
            sizes = np.diff(starts)
            impacts = impacts_of(tf, np.repeat(m, sizes), shared.value[terms]).astype(np.float64)
            squares = np.append(impacts * impacts, 0)  # no document here is without a term
            norm = np.sqrt(np.add.reduceat(squares, starts[:-1])) if len(sizes) else m
            # Rows in a batch have different spreads, and so have batches of one length.
            spread = (np.arange(len(m)) * 2654435761 + len(terms)) % (1 << 31)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(m, pa.int64()),
                    pa.array(norm, pa.float64()),
                    pa.array(spread.astype(np.int32)),
                    batch.column("terms"),
                    batch.column("counts"),
                ],
                schema.names,
            )

    vectors = counted.where(F.size("terms") > 0).mapInArrow(measured, schema)
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return vectors.repartitionByRange(parts, F.desc("norm"), "spread").sortWithinPartitions(
        F.desc("norm")
    )


def search(
    vectors: DataFrame, weights: np.ndarray, items: Sequence[np.ndarray], least: Sequence[int], k: int
) -> DataFrame:
    """Per task, the ``k`` best documents of each item with a score of at least ``least``.

    ``item`` is the number of the item. Buckets come in the order of their lengths, so the
    k-th best score soon is high and most of the later ones are passed over.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((weights, list(items), list(least)))
    schema = T.StructType(
        [
            T.StructField("item", T.IntegerType()),
            vectors.schema["doc_id"],
            T.StructField("score", T.LongType()),
        ]
    )

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items, least = shared.value
        best = [Best(k, score) for score in least]
        wanted = np.zeros(len(weights), bool)
        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, BUCKET):
                part = batch.slice(at, BUCKET)
                starts, terms, tf = _columns(part)
                m = np.repeat(part.column("m").to_numpy(), np.diff(starts))
                bucket = Bucket(
                    part.column("doc_id").to_pylist(),
                    starts,
                    terms,
                    impacts_of(tf, m, weights[terms]),
                    part.column("norm").to_numpy(),
                    len(weights),
                )
                search_bucket(bucket, items, best, wanted)
        rows = [(at, doc, -score) for at, found in enumerate(best) for score, _, doc in found.rows]
        if rows:
            numbers, docs, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int32()), pa.array(docs, kind), pa.array(scores, pa.int64())],
                ["item", "doc_id", "score"],
            )

    return vectors.mapInArrow(searched, schema)


def best_of(hits: DataFrame, by: str, k: int) -> DataFrame:
    """Rank from 1 by score, then ascending ``doc_id`` (null last); ranks up to ``k``."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, block: list, id_type: T.DataType, k: int) -> DataFrame:
    spark = docs.sparkSession
    item_terms = [sorted({t for text in row[1] for t in terms_of(text.encode())}) for row in block]
    vocabulary = {t: i for i, t in enumerate(sorted({t for terms in item_terms for t in terms}))}
    items = [np.array([vocabulary[t] for t in terms], np.int64) for terms in item_terms]

    counted = staged(term_counts(docs, vocabulary), "term-counts")
    n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    # At most one row for each term of the block's items.
    for term, rows in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[term] = rows
    weights = np.array([weight(n_docs, int(d)) if d else 0 for d in df], np.int64)

    vectors = staged(by_length(counted, weights, n_docs, max(1, n_terms)), "by-length")
    cut = vectors.agg(F.percentile_approx("norm", 1 - 1 / FIRST_SHARE, 1000)).first()[0]
    long, rest = F.col("norm") >= F.lit(cut), F.col("norm") < F.lit(cut)
    first = staged(search(vectors.where(long), weights, items, [1] * len(items), k), "first-hits")
    least = [1] * len(items)
    for item, score in best_of(first, "item", k).where(F.col("rank") == k).select("item", "score").collect():
        least[item] = score
    hits = first.unionByName(search(vectors.where(rest), weights, items, least, k))
    ids = spark.createDataFrame(
        [(i, row[0]) for i, row in enumerate(block)],
        T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", id_type)]),
    )
    return best_of(hits, "item", k).join(ids, "item").select("item_id", "rank", "doc_id", "score")


def rank(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id``, ``rank``, ``doc_id``, ``score``.

    Items are taken in blocks of ``item_block``; every block is a pass over the documents
    that counts its terms, lays the documents' impact vectors out by length, and searches
    them bucket by bucket. Only a block's terms and items are known to all tasks, and each
    task hands on at most ``k`` documents for an item. Results are exact: what a bound
    leaves out can't score as high as the k-th best, and all others are scored in integers.

    Null text has no terms. Documents with a score of 0 are not returned, so an item may have
    fewer rows, or none. Equal scores rank by ascending ``doc_id``, null last; repeated rows
    are ranked each. Texts of one ``item_id`` (null is one too) are one item. No documents or
    no items give no rows. Other columns are ignored.
    """
    texts = texts_of(docs, id_col, text_col)
    asked = (
        items.select(F.col(item_col).alias("item_id"), F.coalesce(item_text_col, F.lit("")).alias("t"))
        .groupBy("item_id")
        .agg(F.collect_set("t").alias("texts"))
    )
    id_type, rows, found = asked.schema["item_id"].dataType, asked.toLocalIterator(), None
    while block := list(islice(rows, item_block)):
        part = _search_block(texts, block, id_type, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        kinds = [
            T.StructField("item_id", id_type),
            T.StructField("rank", T.IntegerType()),
            texts.schema["doc_id"],
            T.StructField("score", T.LongType()),
        ]
        return docs.sparkSession.createDataFrame([], T.StructType(kinds))
    return found

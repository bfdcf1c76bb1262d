"""Jaccard self-join over word n-grams: a forest of minhash prefixes, then exact counts."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..session import staged
from .common import WordCache, resident, runs, ship, texts_of
from .components import components

#: Trees of the forest, and hashes along the longest prefix of each.
TREES, DEPTH = 10, 6
#: A prefix shared by this few texts is shortened once more than the recall asks for.
SPARSE = 16
#: Texts of one node that are compared in one task, and likewise of one group, and bytes.
NODE_TEXTS, GROUP_TEXTS, GROUP_BYTES = 2048, 1024, 8_000_000
#: How far the share of equal hashes may lie below the threshold, in standard deviations.
SLACK = 4.8

_rng = np.random.default_rng(20)
_MULTIPLIERS = _rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * 2 + 1
_OFFSETS = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def recall(depth: int, threshold: float, trees: int = TREES) -> float:
    """Chance that a pair at the threshold shares a prefix of ``depth`` hashes in some tree."""
    return 1 - (1 - threshold**depth) ** trees


def needed_depth(threshold: float, target: float) -> int:
    """The longest prefix with the target recall: shortened step by step from the full one."""
    depth = DEPTH
    while depth > 1 and recall(depth, threshold) < target:
        depth -= 1
    return depth


def words_of(text: str) -> list[str]:
    return text.lower().split()


def shingles(words: list[str], n: int) -> np.ndarray:
    """64-bit hashes of the runs of ``n`` words; of all words, if there are fewer."""
    known = resident("ngram_join", "words", lambda: WordCache(xxhash.xxh64_intdigest, 150_000))
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    out = np.zeros(len(words) - width + 1 if width else 0, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * _STEP + hashes[k : k + len(out)]
    return (out ^ (out >> np.uint64(32))) * _STEP


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``TREES * DEPTH`` minhashes (32 bits) for each set; none of them empty."""
    every = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), TREES * DEPTH), np.uint32)
    for k, (a, b) in enumerate(zip(_MULTIPLIERS, _OFFSETS, strict=True)):
        out[:, k] = np.minimum.reduceat((every * a + b) >> np.uint64(32), starts)
    return out


def _digest(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _signed(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id``, ``text_hash``, ``digest`` of the words, ``signature`` (null without words), ``chars``."""

    def signed(batches):
        for batch in runs(batches):
            texts = batch.column(1).to_pylist()
            digests, marks, waiting, size = [], [None] * len(texts), [], 0

            def sign():
                for (row, _), mark in zip(waiting, signatures([s for _, s in waiting]), strict=True):
                    marks[row] = mark.tobytes()
                waiting.clear()

            for row, text in enumerate(texts):
                words = words_of(text)
                digests.append(_digest(words))
                if words:
                    waiting.append((row, shingles(words, n)))
                    size += len(words)
                if size > 50_000:
                    sign()
                    size = 0
            if waiting:
                sign()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(digests, pa.binary()),
                    pa.array(marks, pa.binary()),
                    pa.array([len(text) for text in texts], pa.int64()),
                ],
                ["doc_id", "text_hash", "digest", "signature", "chars"],
            )

    schema = "doc_id long, text_hash long, digest binary, signature binary, chars long"
    return _hashed(docs).mapInArrow(signed, schema)


def _hashed(docs: DataFrame) -> DataFrame:
    return texts_of(docs).withColumn("text_hash", F.xxhash64("text"))


def _blocks(n: Column, number: Column) -> Column:
    """The (block, block) pairs that a member of a group of ``n`` blocks takes part in."""
    own = F.pmod(F.xxhash64(number), n).cast("int")
    others = F.sequence(F.lit(0), n.cast("int") - 1)
    return F.transform(others, lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j"), own.alias("own")))


def _candidates(classes: DataFrame, depth: int, threshold: float) -> DataFrame:
    """Edges between classes with similar signatures that meet in a node of some tree.

    The nodes are the prefixes of ``depth`` hashes, or one less where few texts meet. Only
    a spanning forest of a node's similar pairs is given back, never the pairs.
    """
    short, full = 4 * (depth - 1), 4 * depth
    trees = classes.where("signature IS NOT NULL").select(
        "number",
        F.explode(
            F.array(
                *(
                    F.concat(F.lit(bytearray([t])), F.substring("signature", 4 * DEPTH * t + 1, full))
                    for t in range(TREES)
                )
            )
        ).alias("prefix"),
    )
    counts = trees.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    parent = F.substring("prefix", 1, 1 + short)
    parents = counts.groupBy(parent.alias("parent")).agg(F.sum("n").alias("n_parent"))
    few = F.col("n_parent") <= SPARSE
    nodes = (
        counts.withColumn("parent", parent)
        .join(parents.where("n_parent > 1").hint("merge"), "parent")
        .where((F.col("n") > 1) | few)
        .select(
            "prefix",
            F.when(few, F.col("parent")).otherwise(F.col("prefix")).alias("node"),
            F.ceil(F.when(few, 1).otherwise(F.col("n")) / NODE_TEXTS).alias("blocks"),
        )
    )
    members = (
        staged(trees.join(nodes.hint("merge"), "prefix").select("number", "node", "blocks"), "members")
        .join(classes.select("number", "signature").hint("merge"), "number")
        .select("number", "signature", "node", F.explode(_blocks(F.col("blocks"), F.col("number"))).alias("p"))
        .select("number", "signature", "node", "p.*")
    )
    least = threshold - SLACK * np.sqrt(threshold * (1 - threshold) / (TREES * DEPTH))

    def linked(keys, frame: pd.DataFrame) -> Iterator[tuple]:
        marks = np.frombuffer(b"".join(frame["signature"]), np.uint32).reshape(len(frame), -1)
        numbers, own = frame["number"].to_numpy(), frame["own"].to_numpy()
        one, other = np.flatnonzero(own == keys[1]), np.flatnonzero(own == keys[2])
        forest = Forest(numbers)
        rows = max(1, 2_000_000 // max(1, len(other) * marks.shape[1]))
        for at in range(0, len(one), rows):
            part = one[at : at + rows]
            alike = (marks[part][:, None, :] == marks[other][None, :, :]).mean(axis=2) >= least
            for x, y in zip(*np.nonzero(alike), strict=True):
                if part[x] != other[y]:
                    forest.join(part[x], other[y])
        return forest.edges()

    return _grouped(members, ["node", "i", "j"], linked, "a long, b long")


def _grouped(rows: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """``work(key values, frame)`` for every group, its tuples as rows of ``schema``.

    Groups are bounded by their blocks. They are dealt by a hash of the key and walked in
    sorted order, many small ones in one call. The number of tasks is that of the session:
    comparing takes far longer than the size of the rows lets expect.
    """
    names = [part.split()[0] for part in schema.split(",")]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # rows of the last group, which may go on in the next frame
        for frame in frames:
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            found, held = [], frame
            if len(frame):
                columns = [frame[key].to_numpy() for key in keys]
                new = np.zeros(len(frame), bool)
                for column in columns:
                    new[1:] |= column[1:] != column[:-1]
                bounds = [0, *np.flatnonzero(new).tolist()]
                for start, stop in zip(bounds, bounds[1:], strict=False):
                    key = tuple(column[start] for column in columns)
                    found.extend(work(key, frame.iloc[start:stop]))
                held = frame.iloc[bounds[-1] :]
            yield pd.DataFrame(found, columns=names)
        if held is not None and len(held):
            key = tuple(held[name].iloc[0] for name in keys)
            yield pd.DataFrame(list(work(key, held)), columns=names)

    return rows.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInPandas(walk, schema)


class Forest:
    """Union-find over the members of one group."""

    def __init__(self, numbers: np.ndarray):
        self.numbers, self.up = numbers, list(range(len(numbers)))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def edges(self) -> list[tuple[int, int]]:
        pairs = ((x, self.root(x)) for x in range(len(self.up)))
        return [(int(self.numbers[x]), int(self.numbers[y])) for x, y in pairs if x != y]


def overlaps(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``one`` shares with each of ``other`` (sorted, distinct).

    Elements of a single set can't be shared and are left out; the others are columns of
    two small matrices, whose product, some thousand columns at a time, has the counts.
    """
    sets = [*one, *other]
    every = np.concatenate(sets)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, rows = every[order], rows[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    rows, column = rows[shared], column[shared]
    out = np.zeros((len(one), len(other)), np.float64)
    if len(rows) == 0:
        return out
    column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
    for start in range(0, int(column[-1]) + 1, 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        width = int(column[b - 1]) - start + 1
        matrix = np.zeros((len(sets), width), np.float32)
        matrix[rows[a:b], column[a:b] - start] = 1
        out += matrix[: len(one)] @ matrix[len(one) :].T
    return out


def _verified(texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """Exact links inside the candidate groups: per class and block pair its linked rows."""

    def counted(keys, frame: pd.DataFrame) -> Iterator[tuple]:
        frame = frame.drop_duplicates("number").sort_values("number", ignore_index=True)
        if len(frame) < 2:
            return
        numbers, own = frame["number"].to_numpy(), frame["own"].to_numpy()
        sizes = frame["size"].to_numpy()
        sets = [np.unique(shingles(words_of(text), n)) for text in frame["text"]]
        lengths = np.array([len(s) for s in sets])
        one, other = np.flatnonzero(own == keys[1]), np.flatnonzero(own == keys[2])
        if not len(one) or not len(other):
            return
        forest, links = Forest(numbers), np.zeros(len(numbers), np.int64)
        common = overlaps([sets[x] for x in one], [sets[y] for y in other])
        union = lengths[one][:, None] + lengths[other][None, :] - common
        alike = common >= threshold * union - 1e-9
        if keys[1] == keys[2]:
            np.fill_diagonal(alike, False)
            links[one] = alike @ sizes[other]
        else:
            links[one] = alike @ sizes[other]
            links[other] = alike.T @ sizes[one]
        for x, y in zip(*np.nonzero(alike), strict=True):
            forest.join(one[x], other[y])
        for x in np.flatnonzero(links):
            yield int(numbers[x]), int(numbers[forest.root(x)]), int(links[x])

    return _grouped(texts, ["root", "i", "j"], counted, "a long, b long, links long")


def near_copies(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, target_recall: float = 0.999
) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id``, ``class_size``, ``n_links``, ``n_copies``.

    Two documents are linked if the sets of their runs of ``n`` words (lower case, parted by
    white space; all words, if there are fewer) have a Jaccard similarity of ``threshold``.
    ``class_id`` is the smallest ``doc_id`` that links lead to, ``class_size`` how many rows
    they lead to. ``n_links`` counts the linked rows, ``n_copies`` those among them with the
    very same words.

    1. Documents with the same words become one class, counted before anything moves.
    2. Every class has ``TREES`` labels of ``DEPTH`` minhashes. From the full label the
       prefix that must agree is shortened until a pair at the threshold meets in some tree
       with ``target_recall``; where few texts share a prefix, it is shortened once more.
       Frequent prefixes are dealt out in blocks, none is dropped or capped.
    3. Classes that meet with similar signatures form groups, and inside a group every pair
       is counted exactly from the whole texts, in blocks. Pairs are never rows: a task
       gives counts and a spanning forest.

    Work grows with the square of the *different* texts of one group, over ``GROUP_TEXTS``.

    Texts without words are copies of each other and of nothing else. A null ``doc_id`` is
    no ``class_id`` as long as its class has another. Repeated rows are copies. An empty
    table gives no rows, other columns are ignored.
    """
    signed, found = _classes_of(docs, n, threshold, target_recall)
    names = ["digest", "class_id", "class_size", "n_links", "n_copies"]
    named = found.select(*names).hint("merge")
    return signed.select("doc_id", "digest").join(named, "digest").drop("digest")


def _classes_of(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, target_recall: float = 0.999
) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and a row per digest: the columns of ``near_copies``, ``first_id``, ``keeps``.

    ``keeps`` is true for one digest of each class, the one with the smallest ``first_id``
    (null behind all others; of equals, the smallest digest).
    """
    signed = staged(_signed(docs, n), "signatures")
    classes = staged(
        signed.groupBy("digest")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"),
            F.count(F.lit(1)).alias("size"),
            F.first("signature").alias("signature"),
            F.max("chars").alias("chars"),
        )
        .withColumns({"first_id": F.col("first.doc_id"), "first_hash": F.col("first.text_hash")})
        .drop("first")
        .withColumn("number", F.monotonically_increasing_id()),
        "classes",
    )
    edges = _candidates(classes, needed_depth(threshold, target_recall), threshold)
    roots = components(edges, "candidates")
    group = staged(
        roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
        .withColumnRenamed("node", "number")
        .join(classes.drop("signature").hint("merge"), "number"),
        "groups",
    )
    room = F.greatest(F.count(F.lit(1)) / GROUP_TEXTS, F.sum("chars") / GROUP_BYTES)
    blocks = group.groupBy("root").agg(F.greatest(F.ceil(room), F.lit(1)).alias("blocks"))
    wanted = group.join(blocks.hint("merge"), "root").select(
        "root", "number", "size", "digest", "first_id", "first_hash", "blocks"
    )
    same = signed.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    texts = _texts_of_classes(docs, wanted, not same.where("n > 1").isEmpty())
    linked = staged(_verified(texts, n, threshold), "links")
    final = components(linked.select("a", "b"), "classes")
    links = linked.groupBy(F.col("a").alias("number")).agg(F.sum("links").alias("links"))
    placed = (
        classes.select("number", "digest", "first_id", "size")
        .join(final.withColumnRenamed("node", "number").hint("merge"), "number", "left")
        .join(links.hint("merge"), "number", "left")
        .withColumn("root", F.coalesce("root", "number"))
    )
    placed = staged(placed, "placed")
    named = placed.groupBy("root").agg(
        F.min("first_id").alias("class_id"),
        F.sum("size").alias("class_size"),
        F.min(F.struct(F.col("first_id").isNull(), "first_id", "digest"))["digest"].alias("keeper"),
    )
    found = staged(
        placed.join(named.hint("merge"), "root").select(
            "digest",
            "class_id",
            "class_size",
            (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
            (F.col("size") - 1).alias("n_copies"),
            "first_id",
            (F.col("digest") == F.col("keeper")).alias("keeps"),
        ),
        "found",
    )
    return signed, found


def _texts_of_classes(docs: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """The text of each wanted class, in its block pairs.

    Texts are found by ``doc_id`` and hash of the class's first row, so rows that share an
    id, or have none, meet only classes of their own text. Where whole rows are ``repeated``,
    one for each class goes on.
    """
    rows = _hashed(docs).join(
        wanted.hint("merge"),
        (F.col("text_hash") == F.col("first_hash")) & F.col("doc_id").eqNullSafe(F.col("first_id")),
    )
    if repeated:
        kept = [name for name in rows.columns if name != "number"]
        rows = rows.groupBy("number").agg(*(F.first(name).alias(name) for name in kept))

    schema = "root long, number long, size long, blocks long, text string"

    def same_words(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            texts, digests = batch.column(at("text")), batch.column(at("digest"))
            good = [
                _digest(words_of(text)) == digest
                for text, digest in zip(texts.to_pylist(), digests.to_pylist(), strict=True)
            ]
            kept = batch.select([part.split()[0] for part in schema.split(", ")])
            yield kept.filter(pa.array(good, pa.bool_()))

    pairs = F.explode(_blocks(F.col("blocks"), F.col("number"))).alias("p")
    return rows.mapInArrow(same_words, schema).select("*", pairs).select("root", "number", "size", "text", "p.*")


def keep_one_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one row of each class.

    A row with the smallest ``doc_id`` of the class stays (null ranks behind all others).
    Rows are told apart by the digest of their words, and the ``doc_id`` only picks among
    rows with the same words, so repeated and null ids take no other rows with them.
    """
    _, found = _classes_of(docs, **options)
    name = "word digest"
    while name in docs.columns:
        name += "'"
    rows = _with_digest(docs, name)
    copied = found.where("keeps AND n_copies > 0").select(F.col("digest").alias(name), F.col("first_id").alias(f"{name} id"))
    some_copied = not copied.isEmpty()
    apart = found.where("NOT keeps OR n_copies > 0" if some_copied else "NOT keeps")
    kept = rows.join(apart.select(F.col("digest").alias(name)), name, "left_anti")
    if some_copied:
        same = (rows[name] == copied[name]) & rows["doc_id"].eqNullSafe(copied[f"{name} id"])
        kept = kept.unionByName(rows.join(copied, same, "left_semi").dropDuplicates([name]))
    return kept.select(*docs.columns)


def _with_digest(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the digest of each row's words as the column ``name``."""
    ship(docs.sparkSession)

    def digested(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            digests = pa.array([_digest(words_of(text or "")) for text in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, digests], [*batch.schema.names, name])

    return docs.mapInArrow(digested, StructType([*docs.schema.fields, StructField(name, BinaryType())]))

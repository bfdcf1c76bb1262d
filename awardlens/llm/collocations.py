"""Collocations from a prefix-free parse: n-grams are counted inside distinct chunks only.

A text is cut where a hash of its last few words says so, so equal passages are cut alike
wherever they stand. Chunks overlap by those words. The distinct chunks with the number of
their occurrences are the dictionary; an n-gram inside a chunk counts as often as the chunk
occurs, and belongs to the chunk in which its last word is no overlap, so it counts once.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .common import WordCache, runs, ship

#: Longest phrase, in words; chunks overlap by one word less, so that some chunk holds it.
LONGEST = 5
OVERLAP = LONGEST - 1
#: Words in a chunk, on the average, beside the overlap.
CHUNK_WORDS = 48
#: Bits of the filters that tell which words and pairs can be part of a phrase.
FILTER_BITS = 1 << 25
#: Different spans and phrases that a task holds before it hands their counts on.
HELD_SPANS, HELD_PHRASES = 4_000_000, 500_000
#: Chunks that a task counts the phrases of, about 200 MB.
TASK_CHUNKS = 500_000
#: Text whose words are numbered together.
PASSAGE_BYTES = 8_000_000

#: A piece's end as a word of its own; no other word holds this character.
STOP = b"."
TABLE = bytes(
    c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c
    for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 text, A-Z lower-cased, and a ``STOP`` at each end of a piece."""
    return text.translate(TABLE).replace(STOP, b" . ").split()


def hash_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs of hashes."""
    h = (left * MIX) ^ (right + (left >> np.uint64(29)))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


# ---- the dictionary ----------------------------------------------------------------------


def parse(docs: DataFrame, text_col: str, lang_col: str, chunk_words: int) -> DataFrame:
    """The distinct chunks by language, and how often each occurs: the dictionary.

    A chunk begins with ``OVERLAP`` words that belong to the one before; the first of a
    document begins with as many ``STOP``. Copies and common passages end up as one row.
    """
    ship(docs.sparkSession)
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordCache(hash_of)
        for batch in runs(batches):
            words, starts, langs = [], [], []
            for lang, text in zip(
                batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True
            ):
                own = words_of(text.as_py())
                if any(word != STOP for word in own):
                    langs.append(lang)
                    starts.append(len(words))
                    words += [STOP] * OVERLAP
                    words += own
            if not langs:
                continue
            starts.append(len(words))
            h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
            window = h.copy()
            for back in range(1, OVERLAP):
                window[back:] = mixed(window[back:], h[:-back])
            cut = window % np.uint64(chunk_words) == 0
            out_lang, out_chunk = [], []
            for lang, start, end in zip(langs, starts[:-1], starts[1:], strict=True):
                at = start + OVERLAP
                ends = (np.flatnonzero(cut[at : end - 1]) + at + 1).tolist()
                for stop in [*ends, end]:
                    out_lang.append(lang)
                    out_chunk.append(b" ".join(words[at - OVERLAP : stop]))
                    at = stop
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_lang, pa.string()), pa.array(out_chunk, pa.binary())],
                ["lang", "chunk"],
            )

    chunks = texts.mapInArrow(parsed, "lang string, chunk binary")
    return chunks.groupBy("lang", "chunk").agg(F.count(F.lit(1)).alias("times"))


class Passage:
    """Chunks of one language as a row of words, each word a number of its own.

    All but the hashing of different words is done on whole arrays.
    """

    def __init__(self, lang: str, chunks: pa.Array, times: np.ndarray):
        parts = pa.compute.split_pattern(chunks, pattern=" ")
        sizes = parts.value_lengths().to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        self.lang, self.vocabulary = lang, coded.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.times = np.repeat(times, sizes)
        place = np.arange(len(self.codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.inner = place > 0  # has a word of its chunk before it
        self.owned = place >= OVERLAP
        self.is_word = np.array([word != STOP for word in self.vocabulary])[self.codes]

    def hashes(self) -> np.ndarray:
        """A hash of language and word for each number."""
        salt = self.lang.encode() + b"\0"
        return np.array([hash_of(salt + word) for word in self.vocabulary], np.uint64)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[Passage]:
    def passages(held: list[pa.RecordBatch]) -> Iterator[Passage]:
        table = pa.Table.from_batches(held).combine_chunks()
        lang = table["lang"].combine_chunks().dictionary_encode()
        numbers, chunks = lang.indices.to_numpy(), table["text"].combine_chunks()
        times = table["times"].to_numpy()
        for number, name in enumerate(lang.dictionary.to_pylist()):
            own = np.flatnonzero(numbers == number)
            yield Passage(name, chunks.take(pa.array(own)), times[own])

    held, size = [], 0
    for batch in runs(b.rename_columns(["lang", "text", "times"]) for b in batches):
        held.append(batch)
        size += batch.nbytes
        if size >= PASSAGE_BYTES:
            yield from passages(held)
            held, size = [], 0
    if held:
        yield from passages(held)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and the sum of the counts of each."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[order], first)


def word_counts(dictionary: DataFrame) -> DataFrame:
    """``lang``, ``word``, ``count`` of all words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for passage in _passages(batches):
            at = passage.owned & passage.is_word
            counts = np.zeros(len(passage.vocabulary), np.int64)
            found, times = summed(passage.codes[at], passage.times[at])
            counts[found] = times
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([passage.lang] * len(found), pa.string()),
                    pa.array([passage.vocabulary[k] for k in found.tolist()], pa.binary()),
                    pa.array(counts[found], pa.int64()),
                ],
                ["lang", "word", "count"],
            )

    rows = dictionary.mapInArrow(counted, "lang string, word binary, count long")
    return rows.groupBy("lang", "word").agg(F.sum("count").alias("count"))


# ---- filters of a fixed size -------------------------------------------------------------


def bit_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits with those of the hashes set, as bytes.

    Its size doesn't depend on how many there are: they are put into 4 KB maps by Spark, and
    only those come to the driver.
    """
    bit = F.col("hash").bitwiseAND(F.lit(bits - 1))
    maps = (
        hashes.select(F.shiftright(bit, 15).alias("part"), (bit % 32768).alias("place"))
        .groupBy("part")
        .agg(F.bitmap_construct_agg("place").alias("map"))
        .collect()
    )
    filled = np.zeros((bits // 32768, 4096), np.uint8)
    for part, found in maps:
        filled[part] = np.frombuffer(bytes(found), np.uint8)
    return filled.reshape(-1)


def in_filter(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(len(filled) * 8 - 1)
    return (filled[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def spans_of(passage: Passage, filters: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For one word, two, and so on up to one more than there are filters: by last word, the
    hash of the span and whether all the shorter ones in it pass the filters."""
    by_code = passage.hashes()
    word = by_code[passage.codes]
    spans = [(word, passage.is_word)]
    for n, filled in enumerate(filters, 1):
        last, good = spans[-1]
        passing = in_filter(filled, by_code)[passage.codes] if n == 1 else in_filter(filled, last)
        spans[-1] = last, good & passing
        longer, both = np.zeros(len(word), np.uint64), spans[-1][1] & passage.inner
        longer[1:] = mixed(last[:-1], word[1:])
        both[1:] &= spans[-1][1][:-1]
        spans.append((longer, both))
    return spans


def span_counts(dictionary: DataFrame, filters: list[np.ndarray]) -> DataFrame:
    """``hash`` and ``count`` of spans of one more word than there are filters, by language,
    whose shorter spans all pass.

    Spans with equal hashes are counted together: this only says what can't be frequent.
    """
    shared = dictionary.sparkSession.sparkContext.broadcast(filters)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = summed(*map(np.concatenate, zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], ["hash", "count"]
            )

        for passage in _passages(batches):
            span, good = spans_of(passage, shared.value)[-1]
            at = np.flatnonzero(good & passage.owned)
            held.append(summed(span[at], passage.times[at]))
            size += len(held[-1][0])
            if size > HELD_SPANS:
                yield flush()
                size = 0
        if held:
            yield flush()

    rows = dictionary.mapInArrow(counted, "hash long, count long")
    return rows.groupBy("hash").agg(F.sum("count").alias("count"))


def phrases_of(passage: Passage, filters: list[np.ndarray]) -> Iterator[tuple[bytes, int]]:
    """The different phrases whose short spans all pass, and how often each is owned.

    A phrase's number and the word behind it make the number of the next longer one.
    """
    words, codes, vocabulary = len(passage.vocabulary), passage.codes, passage.vocabulary
    spans = [good for _, good in spans_of(passage, filters)[1:]]
    spans = spans[: len(filters) - 1]  # the last has not been looked up
    number, at = codes, np.flatnonzero(spans[0])
    for n in range(2, LONGEST + 1):
        if not len(at):
            return
        keys, first, inverse = np.unique(
            number[at - 1] * words + codes[at], return_index=True, return_inverse=True
        )
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, inverse, np.where(passage.owned[at], passage.times[at], 0))
        spelled = codes[at[first][:, None] + np.arange(1 - n, 1)].tolist()
        for numbers, count in zip(spelled, counts.tolist(), strict=True):
            if count:
                yield b" ".join([vocabulary[k] for k in numbers]), count
        number = np.full(len(codes), -1)
        number[at] = inverse
        at = at[(at + 1 < len(codes))] + 1
        at = at[spans[min(n, len(spans)) - 1][at]]


def phrase_counts(dictionary: DataFrame, filters: list[np.ndarray]) -> DataFrame:
    """``lang``, ``phrase``, ``count`` of the 2- to 5-word phrases whose short spans all pass.

    Nearly every task meets nearly every frequent phrase, so each adds as many rows to the
    shuffle: tasks take ``TASK_CHUNKS`` chunks, unless that leaves cores idle.
    """
    context = dictionary.sparkSession.sparkContext
    shared = context.broadcast(filters)
    tasks = max(context.defaultParallelism, dictionary.count() // TASK_CHUNKS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, dict[bytes, int]] = {}

        def flush() -> pa.RecordBatch:
            names = [lang for lang, c in counters.items() for _ in range(len(c))]
            keys = [key for c in counters.values() for key in c]
            counts = [count for c in counters.values() for count in c.values()]
            counters.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(keys, pa.binary()), pa.array(counts, pa.int64())],
                ["lang", "phrase", "count"],
            )

        for passage in _passages(batches):
            counter = counters.setdefault(passage.lang, {})
            for phrase, count in phrases_of(passage, shared.value):
                counter[phrase] = counter.get(phrase, 0) + count
            if sum(map(len, counters.values())) > HELD_PHRASES:
                yield flush()
        yield flush()

    rows = dictionary.coalesce(tasks).mapInArrow(counted, "lang string, phrase binary, count long")
    return rows.groupBy("lang", "phrase").agg(F.sum("count").alias("count"))


# ---- phrases -----------------------------------------------------------------------------

#: ``floor(1000 * a * n / (l * r))``. Products of counts pass 64 bits: decimals hold them exactly.
SCORE = (
    "cast(cast(a AS decimal(20,0)) * cast(n AS decimal(20,0)) * cast(1000 AS decimal(4,0)) AS decimal(38,0))"
    " div cast(cast(l AS decimal(20,0)) * cast(r AS decimal(20,0)) AS decimal(38,0))"
)


def collocations(
    docs: DataFrame,
    least: int = 100,
    top: int | None = 2000,
    text_col: str = "text",
    lang_col: str = "lang",
    chunk_words: int = CHUNK_WORDS,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``,
    ``l``, ``r``, ``n``, ``score``; all of them without ``top``.

    ``a`` counts the phrase, ``l`` and ``r`` its parts at the cut with the lowest score
    ``floor(1000 * a * n / (l * r))``, ``n`` all words. A phrase of ``least`` or more
    occurrences that stands in a longer one with as many is left out.

    The dictionary of chunks is passed over four times: for words, for hashes of pairs of
    frequent words and of triples of frequent pairs, and for phrases of frequent triples. In
    between, filters of ``filter_bits`` bits tell the tasks what can't be frequent. They never
    grow with the corpus; where they fill up, more is counted in vain and the result is the
    same.
    Counts are combined in each task before they are shuffled.

    Null text is empty, null language ``und``. Repeated rows count each. Texts without words
    and empty tables give no rows. Other columns are ignored.
    """
    dictionary = staged(parse(docs, text_col, lang_col, chunk_words), "chunks")
    words = staged(word_counts(dictionary), "words")
    totals = words.groupBy("lang").agg(F.sum("count").alias("n"))
    frequent = words.where(F.col("count") >= least)
    salted = F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), F.col("word"))
    by_word = bit_filter(frequent.select(F.xxhash64(salted).alias("hash")), filter_bits)
    filters = [by_word]
    for _ in ("pairs", "triples"):
        often = span_counts(dictionary, filters).where(F.col("count") >= least)
        filters.append(bit_filter(often.select("hash"), filter_bits))

    found = (
        phrase_counts(dictionary, filters)
        .where(F.col("count") >= least)
        .select("lang", F.col("phrase").cast("string").alias("phrase"), F.col("count").alias("a"))
    )
    found = staged(found.withColumn("words", F.split("phrase", " ")), "phrases")
    size = F.size("words")
    known = staged(
        found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")).union(
            frequent.select("lang", F.col("word").cast("string"), "count")
        ),
        "parts",
    )
    cuts = found.select(
        "lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    ).select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice("words", 1, F.col("k")), " ").alias("left"),
        F.array_join(F.slice("words", F.col("k") + 1, size - F.col("k")), " ").alias("right"),
    )
    left = known.select("lang", F.col("part").alias("left"), F.col("f").alias("l"))
    right = known.select("lang", F.col("part").alias("right"), F.col("f").alias("r"))
    scored = (
        cuts.join(left, ["lang", "left"])
        .join(right, ["lang", "right"])
        .join(totals, "lang")
        .withColumn("score", F.expr(SCORE))
    )
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    spans = F.expr(
        "explode(flatten(transform(sequence(2, size(words) - 1), s -> transform("
        "sequence(1, size(words) - s + 1), i -> array_join(slice(words, i, s), ' ')))))"
    )
    covered = (
        found.where(size > 2)
        .select("lang", F.col("a").alias("cover"), spans.alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("cover").alias("cover"))
    )
    kept = lowest.join(covered, ["lang", "phrase"], "left").where(
        F.col("cover").isNull() | (F.col("cover") < F.col("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")

"""Toxicity: a small convolutional network over hashed word embeddings, trained in numpy."""

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_scope, session_conf, staged
from .common import bounded_sample, keep_rows, resident, runs, texts_of

WIDTHS = (1, 2, 3)
#: Scale of the embeddings at first: small, so that rare words stay near nothing.
INIT = 0.02
#: Share of the words left out of a text each time it is trained on.
DROP = 0.3
FILTERS = 8
DIM = 8
#: Words are hashed into this many buckets; only buckets met in training have an embedding.
BUCKETS = 1 << 26
#: Lengths of the beginnings of a word that are hashed besides the word.
PREFIXES = (4, 5, 6, 7)
#: A label needs a bucket in this many training documents to learn an embedding for it.
MIN_DOCS = 3
#: In large tables it needs this share of them, so that the network stays as large as it is.
MIN_SHARE = 3 / 2250
#: Documents that train the network on their own between two averages.
PART_DOCS = 3000
#: Parts of long texts hold fewer documents, so many characters on average at most.
PART_CHARS = 64_000_000
#: Averages of the parts' parameters, each after all rows were read once.
ROUNDS = 3
#: Parameters that are added up together.
CHUNK = 8192
#: Scores are counted in so many steps for the thresholds.
SCORE_STEPS = 100_000
#: Score from which a document counts as toxic, in any language.
CUT = 0.3

#: Words of a long text that are looked at together.
SPAN = 20_000

_WORDS = re.compile(r"[^\W\d_]+")

# Frequent function words, which tell the languages of a text apart.
FUNCTION_WORDS = {
    "en": "the of and to is that it for was with as on be by this are from not have",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "le les des et est dans que une du pour qui sur pas plus par au ce il sont avec",
    "es": "el los las y en que del se por con para una su al lo como más pero sus este",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
_LANGUAGE_OF = Counter(word for words in FUNCTION_WORDS.values() for word in words.split())
_LANGUAGE_OF = {
    word: LANGUAGES.index(name)
    for name, words in FUNCTION_WORDS.items()
    for word in words.split()
    if _LANGUAGE_OF[word] == 1
}


#: Of the first 256 characters the letters, in lower case, and a blank for all others.
_LETTERS = "".join(chr(k).lower() if _WORDS.match(chr(k)) else " " for k in range(256)).encode("latin-1")


def words_of(text: str) -> list[str]:
    try:  # most texts have no other characters, and a table is quicker than the pattern
        return text.encode("latin-1").translate(_LETTERS).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORDS.findall(text.lower())


def _bucket(key: str) -> int:
    return zlib.crc32(key.encode()) & (BUCKETS - 1)


def _start_bucket(start: str) -> int:
    return _bucket(f"{len(start)}{start}")


class _Words(dict):
    """Word -> number of a row with the places of its buckets and its language.

    A word has a bucket of its own and one for each of its beginnings, which inflected forms
    share; ``place`` tells where a bucket is found, None for one that adds nothing. Words with
    equal places share a row, so rare words cost little. Row 0 stands for all that add nothing.
    """

    #: Rows that are remembered, and words in each of two generations.
    LIMIT, WORDS = 100_000, 200_000

    def __init__(self, place: Callable[[int], int | None]):
        super().__init__()
        self.place = place
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.old: dict[str, int] = {}
        self.stems: dict[str, tuple] = {}
        self.rows = {(): 0}
        self.new: list[tuple] = []  # rows not handed out yet

    @property
    def count(self) -> int:
        """The highest row."""
        return len(self.rows) - 1

    def full(self) -> bool:
        """Whether to forget the rows; words not met for long are forgotten here."""
        if len(self) > self.WORDS:
            self.old = dict(self)
            self.clear()
        if len(self.stems) > self.WORDS:
            self.stems = {}
        return self.count > self.LIMIT

    def _beginnings(self, stem: str) -> tuple:
        """Places of the stem's beginnings, the stem itself the last; found from the one before it."""
        places = self.stems.get(stem)
        if places is None:
            n = len(stem)
            places = self._beginnings(stem[:-1]) if n > PREFIXES[0] else ()
            if n in PREFIXES and (at := self.place(_start_bucket(stem))) is not None:
                places = (*places, at)
            self.stems[stem] = places
        return places

    def __missing__(self, word: str) -> int:
        row = self.old.get(word)
        if row is None:
            row = self._row(word)
        self[word] = row
        return row

    def _row(self, word: str) -> int:
        n = len(word) - 1
        places = self._beginnings(word[: min(n, PREFIXES[-1])]) if n >= PREFIXES[0] else ()
        own = self.place(_bucket(word))
        if own is not None:
            places = (own, *places)
        language = _LANGUAGE_OF.get(word)
        key = places if language is None else (*places, -2 - language)
        row = self.rows.get(key)
        if row is None:
            row = self.rows[key] = len(self.rows)
            none = [-1] * (1 + len(PREFIXES) - len(places))
            self.new.append((*places, *none, len(LANGUAGES) - 1 if language is None else language))
        return row

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def news(self) -> np.ndarray:
        """The rows made since the last call: the places, -1 where there are fewer, and the language."""
        new = np.array(self.new, np.int32).reshape(-1, len(PREFIXES) + 2)
        self.new = []
        return new


@dataclass
class Network:
    """Embedding rows by bucket, filters by width, a logistic layer over the maxima."""

    rows: dict[int, int]
    embedding: np.ndarray
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    shifts: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: list[float] = field(default_factory=lambda: [0.5] * len(LANGUAGES))

    def __post_init__(self):
        self._forget()

    def __getstate__(self):
        return {name: getattr(self, name) for name in self.__dataclass_fields__}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def fingerprint(self) -> int:
        """Of all that decides a score: the thresholds are set after the network was first read with."""
        return zlib.crc32(pickle.dumps([_flat(self), self.thresholds]))

    def _forget(self) -> None:
        """Start anew with the words met; row 0 stands for all that add nothing."""
        self.adds = None  # by bucket, filter, offset; made when the first text is read
        self.words = _Words(self.rows.get)
        self.table = np.zeros((1, sum(WIDTHS) * FILTERS), np.float32)
        self.language = np.array([len(LANGUAGES) - 1], np.int8)

    def _ids(self, words: list[str]) -> np.ndarray:
        ids = self.words.numbers(words)
        if self.words.new:
            if self.adds is None:
                parts = [f[j] for f in self.filters for j in range(len(f))]
                self.adds = self.embedding @ np.concatenate(parts, axis=1)
            new = self.words.news()
            while self.words.count >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.language = np.concatenate([self.language, np.full_like(self.language, len(LANGUAGES) - 1)])
            at = slice(self.words.count + 1 - len(new), self.words.count + 1)
            self.table[at] = self.adds[new[:, :-1]].sum(axis=1)
            self.language[at] = new[:, -1]
        return ids

    def read(self, texts: list[str]) -> list[tuple[float, int]]:
        """Probability and language of each text; long texts are read in overlapping spans."""
        out = []
        for text in texts:
            if self.words.full():
                self._forget()
            words = words_of(text)
            ids = self._ids(words)
            hits = np.bincount(self.language[ids], minlength=len(LANGUAGES))[:-1]
            language = int(hits.argmax()) if hits.any() else len(LANGUAGES) - 1
            ids = np.concatenate([ids, np.zeros(max(WIDTHS) - 1, np.int32)])
            best = None
            for start in range(0, max(1, len(words)), SPAN):
                top = self._maxima(ids[start : start + SPAN + max(WIDTHS) - 1])
                best = top if best is None else np.maximum(best, top)
            out.append((float(1 / (1 + np.exp(-(best @ self.weights + self.bias)))), language))
        return out

    def _maxima(self, ids: np.ndarray) -> np.ndarray:
        n, at = len(ids) - max(WIDTHS) + 1, 0
        adds, tops = self.table.take(ids, axis=0), []
        for width, shift in zip(WIDTHS, self.shifts, strict=True):
            total = adds[:n, at : at + FILTERS]
            for j in range(1, width):
                total = total + adds[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS]
            at += width * FILTERS
            # Halving along the words is far quicker than one reduction over eight columns.
            while len(total) > 64:
                half = (len(total) + 1) // 2  # an odd middle row is simply compared twice
                total = np.maximum(total[:half], total[-half:])
            tops.append(total.max(axis=0) + shift if n > 0 else shift)
        return np.maximum(np.concatenate(tops), 0)

    def score(self, texts: list[str]) -> list[float]:
        """Probability moved so that the threshold of the text's language falls on ``CUT``."""
        out = []
        for p, language in self.read(texts):
            t = self.thresholds[language]
            out.append(CUT * p / t if p < t else CUT + (1 - CUT) * (p - t) / (1 - t))
        return out


def _fit(net: Network, places: np.ndarray, docs: list[np.ndarray], labels: np.ndarray, epochs: int, rng) -> None:
    """Adam over batches; only the windows that gave the maxima carry a gradient.

    ``docs`` are the words as rows of ``places``, which has the embedding rows of each.
    """
    pad = np.full((max(WIDTHS) - 1, 1 + len(PREFIXES)), len(net.rows), np.int32)
    balance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
    moments: dict = {}
    step = 0

    def adam(key, value, gradient, rate=0.01, at=slice(None)):
        m, v = moments.setdefault(key, (np.zeros_like(value), np.zeros_like(value)))
        m[at] = 0.9 * m[at] + 0.1 * gradient
        v[at] = 0.99 * v[at] + 0.01 * gradient**2
        value[at] -= rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-6)

    bias = np.array([net.bias], np.float32)
    for _ in range(epochs):
        shuffled = rng.permutation(len(docs))
        for start in range(0, len(docs), 32):
            step += 1
            batch = shuffled[start : start + 32]
            g_filters = [np.zeros_like(f) for f in net.filters]
            g_shifts = [np.zeros_like(s) for s in net.shifts]
            g_weights, g_bias = np.zeros_like(net.weights), 0.0
            touched: list[np.ndarray] = []
            pushes: list[np.ndarray] = []
            for i in batch:
                words = docs[i][rng.random(len(docs[i])) >= DROP]
                if (n := len(words)) == 0:
                    continue
                index = np.concatenate([places[words], pad])
                e = net.embedding[index].sum(axis=1)
                tops, wins = [], []
                for f, s in zip(net.filters, net.shifts, strict=True):
                    total = s + sum(e[j : j + n] @ f[j] for j in range(len(f)))
                    win = total.argmax(axis=0)
                    wins.append(win)
                    tops.append(total[win, np.arange(FILTERS)])
                raw = np.concatenate(tops)
                pooled = np.maximum(raw, 0)
                p = 1 / (1 + np.exp(-(pooled @ net.weights + bias[0])))
                delta = (p - labels[i]) * balance[i] / len(batch)
                g_weights += delta * pooled
                g_bias += delta
                back = delta * net.weights * (raw > 0)
                for w, (f, win) in enumerate(zip(net.filters, wins, strict=True)):
                    g = back[w * FILTERS : (w + 1) * FILTERS]
                    g_shifts[w] += g
                    for j in range(len(f)):
                        g_filters[w][j] += e[win + j].T * g
                        touched.append(index[win + j])
                        pushes.append(np.repeat((g * f[j]).T[:, None, :], 1 + len(PREFIXES), axis=1))
            if not touched:
                continue
            at, where = np.unique(np.concatenate(touched).ravel(), return_inverse=True)
            g_rows = np.zeros((len(at), DIM), np.float32)
            np.add.at(g_rows, where, np.concatenate(pushes).reshape(-1, DIM))
            adam("embedding", net.embedding, g_rows, 0.03, at)
            net.embedding[-1] = 0
            for w in range(len(WIDTHS)):
                adam(("f", w), net.filters[w], g_filters[w])
                adam(("s", w), net.shifts[w], g_shifts[w])
            adam("weights", net.weights, g_weights)
            adam("bias", bias, np.array([g_bias], np.float32))
    net.bias = float(bias[0])


def _thresholds(counts: list[tuple[int, int, float, int]]) -> list[float]:
    """Per language the threshold with the best F1, halfway into the gap above the cleaner side.

    ``counts`` are documents by language, label and score. Languages with few toxic documents
    take the threshold of all languages together.
    """

    def best(rows: list[tuple[int, int, float, int]]) -> float:
        by_score: dict[float, list[int]] = {}
        for _, label, score, n in rows:
            at = by_score.setdefault(score, [0, 0])
            at[0] += n
            at[1] += n * label
        order = sorted(by_score, reverse=True)
        total, seen, hits, top, cut = sum(hits for _, hits in by_score.values()), 0, 0, -1.0, 0.5
        for k, score in enumerate(order):
            seen, hits = seen + by_score[score][0], hits + by_score[score][1]
            below = order[k + 1] if k + 1 < len(order) else 0.0
            if (f1 := 2 * hits / (seen + total)) > top:
                top, cut = f1, (score + below) / 2
        return min(max(cut, 0.02), 0.98)

    every = best(counts)
    out = []
    for language in range(len(LANGUAGES)):
        rows = [row for row in counts if row[0] == language]
        out.append(best(rows) if sum(n for _, label, _, n in rows if label) >= 20 else every)
    return out


def _starts(words: set[str]) -> set[str]:
    return {word[:n] for n in PREFIXES for word in words if len(word) > n}


def _documents_by_bucket(docs: list[set[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the documents' words, and the number of documents that have each."""
    words, starts = Counter(), Counter()
    for doc in docs:
        words.update(doc)
        starts.update(_starts(doc))
    # Each word is hashed once, however many of the documents have it.
    hashed = np.array([*map(_bucket, words), *map(_start_bucket, starts)], np.int32)
    found, where, keys = np.unique(hashed, return_inverse=True, return_counts=True)
    times = np.bincount(where, [*words.values(), *starts.values()], len(found)).astype(np.int64)
    if (keys > 1).any():  # a document with two words of one bucket counts once
        names, shared = [*words, *starts], np.flatnonzero(keys[where] > 1)
        of_word = {names[k]: where[k] for k in shared if k < len(words)}
        of_start = {names[k]: where[k] for k in shared if k >= len(words)}
        some, beginnings = set(of_word), set(of_start)
        for doc in docs:
            hit = [of_word[word] for word in doc & some] + [of_start[start] for start in _starts(doc) & beginnings]
            for at, n in Counter(hit).items() if len(hit) > 1 else ():
                times[at] -= n - 1
    return found, times


def _vocabulary(rows: DataFrame, least: int) -> list[int]:
    """Buckets that at least ``least`` of the documents have."""

    def counted(batches):
        seen, times = np.zeros(0, np.int32), np.zeros(0, np.int64)

        def out():
            columns = [pa.array(seen, pa.int32()), pa.array(times, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "n"])

        for batch in runs(batches):
            found, n = _documents_by_bucket([set(words_of(text)) for text in batch.column("text").to_pylist()])
            seen, where = np.unique(np.concatenate([seen, found]), return_inverse=True)
            times = np.bincount(where, np.concatenate([times, n]), len(seen)).astype(np.int64)
            if len(seen) > 1_000_000:
                yield out()
                seen, times = seen[:0], times[:0]
        yield out()

    found = rows.select("text").mapInArrow(counted, "bucket int, n long").groupBy("bucket")
    return sorted(row.bucket for row in found.agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect())


def _parameters(net: Network) -> list[np.ndarray]:
    return [net.embedding, *net.filters, *net.shifts, net.weights]


def _flat(net: Network) -> np.ndarray:
    return np.concatenate([*(p.ravel() for p in _parameters(net)), [net.bias]]).astype(np.float64)


def _put(net: Network, flat: np.ndarray) -> None:
    at = 0
    for p in _parameters(net):
        p[...] = flat[at : at + p.size].reshape(p.shape)
        at += p.size
    net.bias = float(flat[at])
    net._forget()


PREPARED = "part int, docs int, words binary, sizes binary, labels binary, places binary"


def _prepared(learnt: DataFrame, net: Network, parts: int) -> DataFrame:
    """The documents to learn from, a row per part: the words as rows of places, as ``_Words`` has them.

    Texts are cut into words and hashed once, and the rounds read numbers only, a few bytes a word.
    """
    cores = learnt.sparkSession.sparkContext.defaultParallelism
    tasks = min(parts, max(4 * cores, math.ceil(parts / 4)))
    model = learnt.sparkSession.sparkContext.broadcast(net.rows)
    dealt = learnt.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    # In an order of their own, so that the outcome doesn't hang on how rows arrive.
    ordered = dealt.repartitionByRange(tasks, "part").sortWithinPartitions("part", "doc_id")

    def numbered(batches):
        place = model.value.get
        current, words, numbers, labels = None, None, [], []

        def out():
            sizes = np.array([len(n) for n in numbers], np.int64)
            places = np.concatenate([np.full((1, 1 + len(PREFIXES)), -1, np.int32), words.news()[:, :-1]])
            values = [current, len(labels), np.concatenate(numbers).tobytes(), sizes.tobytes()]
            values += [np.array(labels, np.int8).tobytes(), places.tobytes()]
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
            names = [column.split()[0] for column in PREPARED.split(", ")]
            columns = [pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in runs(batches):
            columns = (batch.column(name).to_pylist() for name in ("part", "text", "toxic"))
            for part, text, toxic in zip(*columns, strict=True):
                if part != current:
                    if labels:
                        yield out()
                    current, words, numbers, labels = part, _Words(place), [], []
                numbers.append(words.numbers(words_of(text)))
                labels.append(toxic)
                words.full()  # forgets words, but no rows
        if labels:
            yield out()

    rows = ordered.select("part", "text", "toxic").mapInArrow(numbered, PREPARED)
    return staged(rows, "toxicity-parts", compression="zstd")


def _learnt(parts: DataFrame, net: Network, epochs: int, seed: int) -> np.ndarray:
    """The parameters after ``epochs`` over each of the ``_prepared`` parts, averaged by documents.

    Each part starts from ``net``. Means are formed by task and then by chunk of the parameters,
    so the driver gets one set of parameters, whatever the number of parts.
    """
    spark = parts.sparkSession
    model = spark.sparkContext.broadcast(net)
    columns = ["chunk", "docs", "mean"]

    def trained(batches):
        docs, total = 0, 0.0
        for batch in batches:
            for row in batch.to_pylist():
                own = pickle.loads(pickle.dumps(model.value))
                places = np.frombuffer(row["places"], np.int32).reshape(-1, 1 + len(PREFIXES))
                places = np.where(places < 0, len(own.rows), places)
                ends = np.cumsum(np.frombuffer(row["sizes"], np.int64))[:-1]
                texts = np.split(np.frombuffer(row["words"], np.int32), ends)
                labels = np.frombuffer(row["labels"], np.int8).astype(np.int64)
                _fit(own, places, texts, labels, epochs, np.random.default_rng([seed, row["part"]]))
                docs, total = docs + row["docs"], total + _flat(own) * row["docs"]
        if docs:
            pieces = [total[at : at + CHUNK] for at in range(0, len(total), CHUNK)]
            yield means({at: (docs, piece) for at, piece in enumerate(pieces)})

    def means(sums: dict) -> pa.RecordBatch:
        order = sorted(sums)
        values = [order, [sums[k][0] for k in order], [(sums[k][1] / sums[k][0]).astype(np.float32) for k in order]]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.float32())]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], columns)

    def by_chunk(batches):
        sums: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                n, total = sums.get(row["chunk"], (0, 0.0))
                sums[row["chunk"]] = n + row["docs"], total + np.array(row["mean"], np.float64) * row["docs"]
        if sums:
            yield means(sums)

    schema = "chunk int, docs long, mean array<float>"
    # A file holds few parts, each worth much more than its bytes: one file to a task.
    with session_conf(spark, {"spark.sql.files.openCostInBytes": str(64 << 20)}):
        of_tasks = parts.mapInArrow(trained, schema)
        chunks = of_tasks.repartition("chunk").mapInArrow(by_chunk, schema).orderBy("chunk").collect()
    model.unpersist()
    return np.concatenate([np.array(row.mean) for row in chunks])


def _score_counts(rows: DataFrame, net: Network) -> list[tuple[int, int, float, int]]:
    """Documents by language, label and score, scores in steps of 1 / ``SCORE_STEPS``."""
    model = rows.sparkSession.sparkContext.broadcast(net)

    def read(batches):
        net = resident("toxicity", model.value.fingerprint(), lambda: model.value)
        for batch in runs(batches):
            found = net.read(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([language for _, language in found], pa.int32()),
                    batch.column("toxic"),
                    pa.array([round(p * SCORE_STEPS) for p, _ in found], pa.int32()),
                ],
                ["language", "toxic", "step"],
            )

    steps = rows.select("text", "toxic").mapInArrow(read, "language int, toxic int, step int")
    counts = steps.groupBy("language", "toxic", "step").count().collect()
    model.unpersist()
    return [(row.language, row.toxic, row.step / SCORE_STEPS, row["count"]) for row in counts]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    per_label: int | None = None,
    max_chars: int | None = None,
    seed: int = 11,
) -> Network | None:
    """Train on all labelled documents; None if their labels are all alike.

    ``labels`` has ``doc_id`` and ``toxic`` (0, 1; others teach nothing). Three quarters of the
    documents, by a hash of their text, are learnt from in parts of about ``PART_DOCS``: each
    part trains the network on its own, and after each round the parts' parameters are averaged.
    The rest set the thresholds. Words and thresholds come from counts over all of these rows;
    words that too small a share of them has are not learnt, so the network, all that goes
    through the driver, keeps its size as the tables grow. Only a caller's own ``per_label``
    and ``max_chars`` leave documents out. Rows of either table that repeat, or lack id or text,
    add nothing. Of several labels for an id the largest counts, of several texts the one with
    the smallest hash.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if per_label is not None:
        known = bounded_sample(known, "toxic", per_label)
    texts = texts_of(docs)
    if max_chars is not None:
        texts = texts.where(F.length("text") <= max_chars)
    once = texts.join(known, "doc_id").groupBy("doc_id", "toxic").agg(
        F.min_by("text", F.xxhash64("text")).alias("text")
    )
    with scratch_scope(docs.sparkSession):
        rows = staged(once.withColumn("held", F.pmod(F.crc32("text"), F.lit(4)) == 0), "toxicity-rows")
        sizes = {row.toxic: row["count"] for row in rows.groupBy("toxic").count().collect()}
        if len(sizes) < 2:
            return None
        if sum(sizes.values()) < 200:
            learnt = held = rows
        else:
            learnt, held = rows.where("NOT held"), rows.where("held")
        if learnt.isEmpty() or held.isEmpty():
            learnt = held = rows
        number, chars = learnt.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
        known_buckets = _vocabulary(learnt, max(MIN_DOCS, round(number * MIN_SHARE)))
        rng = np.random.default_rng(seed)
        network = Network(
            {b: at for at, b in enumerate(known_buckets)},
            rng.normal(0, INIT, (len(known_buckets) + 1, DIM)).astype(np.float32),
            [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            rng.normal(0.5, 0.1, len(WIDTHS) * FILTERS).astype(np.float32),
            0.0,
        )
        network.embedding[-1] = 0
        parts = max(1, round(number / PART_DOCS), math.ceil(chars / PART_CHARS))
        prepared = _prepared(learnt, network, parts)
        # Small tables are read more often, in one part and so in one round.
        epochs = min(12, max(4, round(9000 / number)))
        for turn in range(1 if parts == 1 else ROUNDS):
            _put(network, _learnt(prepared, network, epochs if parts == 1 else 1, seed + turn))
        network.thresholds = _thresholds(_score_counts(held, network))
    return network


def scorer(network: Network | None) -> Callable[[list[str]], list[float]]:
    """Scores of texts. The worker keeps the network, and what it has made of the words."""
    if network is None:
        return lambda texts: [0.0] * len(texts)
    return resident("toxicity", network.fingerprint(), lambda: network).score


def score(docs: DataFrame, network: Network | None) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, toxic from ``CUT``) of every whole text.

    Nothing but the text decides; its language is told by its function words. Null and empty
    texts have the score of no words. Without a network (no or one-sided labels) all scores
    are 0. Repeated rows give a row each, a null ``doc_id`` stays null, an empty table gives
    no rows, other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(network)

    def scored(batches):
        read = scorer(model.value)
        for batch in runs(batches):
            found = read(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"]
            )

    return texts_of(docs).mapInArrow(scored, "doc_id long, score double")


def drop_toxic(docs: DataFrame, network: Network | None) -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays below ``CUT``."""
    model = docs.sparkSession.sparkContext.broadcast(network)
    return keep_rows(docs, lambda texts: [s < CUT for s in scorer(model.value)(texts)])

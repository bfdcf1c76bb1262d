"""Quality classifier without labels: heuristic labellers, weighed, teach a linear scorer."""

import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import WordCache, bounded_sample, resident, runs, texts_of
from .quality_rules import STATISTICS, fit_votes, posterior_column, rule_votes, text_statistics

#: Features are hashed into so many columns.
COLUMNS = 2048
_RUNS = re.compile(r"(.)\1+")



class _Kinds(dict):
    """Code point -> its character in a shape, for ``str.translate``."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        return kind


def _column(key: str) -> int:
    return zlib.crc32(key.encode()) % COLUMNS


_KINDS = _Kinds()
#: Shapes and endings are few beside the words; their columns are remembered.
_SHAPES = WordCache(lambda shape: _column("s" + _RUNS.sub(r"\1\1", shape)[:24]), 20_000)
_ENDINGS = WordCache(lambda ending: _column("e" + ending), 20_000)
_LENGTHS = [_column(f"l{n}") for n in range(21)]
_WORD = zlib.crc32(b"w")
_PACK = struct.Struct("<4H").pack


def word_features(word: bytes) -> bytes:
    """Columns of a word as 16-bit numbers: its shape, its last characters, itself, its length."""
    text = word.decode("utf-8", "replace")
    own = zlib.crc32(text.lower().encode(), _WORD) % COLUMNS
    return _PACK(_SHAPES[text.translate(_KINDS)], _ENDINGS[text[-2:]], own, _LENGTHS[min(len(text), 20)])


_REPEATED_LINE = np.array([zlib.crc32(b"repeated line") % COLUMNS], "<u2").tobytes()
_REPEATED_WORD = np.array([zlib.crc32(b"repeated word") % COLUMNS], "<u2").tobytes()


def text_features(text: str, n_repeat_words: int) -> tuple[bytes, bytes]:
    """Distinct columns (16 bits) and their counts (32 bits) over the whole text.

    ``n_repeat_words`` (of the statistics) are the words in windows found twice or more: unlike
    words that merely recur, they don't grow with the length of clean texts.
    """
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    known = resident("quality_classifier", "words", lambda: WordCache(word_features, 150_000))
    data = b"".join(map(known.__getitem__, words))
    data += _REPEATED_LINE * (len(lines) - len(set(lines)))
    data += _REPEATED_WORD * n_repeat_words
    counts = np.bincount(np.frombuffer(data, "<u2"), minlength=COLUMNS)
    columns = np.flatnonzero(counts)
    return columns.astype("<u2").tobytes(), counts[columns].astype("<u4").tobytes()


def _described(docs: DataFrame) -> DataFrame:
    """``doc_id``, the statistics the labellers look at, and the features; one pass."""

    def described(batches):
        for batch in runs(batches):
            texts = batch.column(1).to_pylist()
            found = list(zip(*map(text_statistics, texts), strict=True)) or [()] * len(STATISTICS)
            repeated = found[list(STATISTICS).index("n_repeat_words")]
            features = list(zip(*map(text_features, texts, repeated), strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(column, pa.int64()) for column in found),
                    *(pa.array(column, pa.binary()) for column in features),
                ],
                ["doc_id", *STATISTICS, "columns", "counts"],
            )

    kinds = ", ".join(f"{name} {kind}" for name, kind in STATISTICS.items())
    return texts_of(docs).mapInArrow(described, f"doc_id long, {kinds}, columns binary, counts binary")


def matrix(columns: list[bytes], counts: list[bytes]) -> np.ndarray:
    """A row per text: square roots of the shares of its features, length about 1."""
    out = np.zeros((len(columns), COLUMNS), np.float32)
    for row, (at, n) in enumerate(zip(columns, counts, strict=True)):
        if at:
            values = np.frombuffer(n, "<u4").astype(np.float64)
            out[row, np.frombuffer(at, "<u2")] = np.sqrt(values / values.sum())
    return out


class LinearScorer:
    """Logistic regression on hashed features, for labels that are probabilities."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, x: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int = 300) -> "LinearScorer":
        x = x.astype(np.float64)  # once, not twice in every step
        w, b = np.zeros(x.shape[1], np.float64), 0.0
        share = weight / weight.sum()
        mean = float(np.clip(share @ target, 1e-3, 1 - 1e-3))
        b = math.log(mean / (1 - mean))
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for step in range(1, steps + 1):
            error = (1 / (1 + np.exp(-(x @ w + b))) - target) * share
            g = np.append(x.T @ error + 1e-5 * w, error.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
        return cls(w.astype(np.float32), float(b))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(x @ self.weights + self.bias).astype(np.float64)))


def classify(docs: DataFrame, per_side: int = 2000, min_score: float = 0.5) -> DataFrame:
    """``doc_id``, ``weak_label``, ``score``, ``kept`` for every document; no labels needed.

    1. Every whole text is described once: statistics for the labellers, features for the
       scorer. This is staged, a few hundred bytes a document.
    2. The labellers vote or abstain. Expectation-maximisation over the vote patterns of
       *all* documents estimates how each votes on good and bad ones; ``weak_label`` is the
       posterior probability of good quality.
    3. A linear scorer is trained on at most ``per_side`` documents that the posterior takes
       for good and as many that it takes for bad, weighted by how many those stand for.
       This bound is the only one, and holds at any size; the sample's features (8 MB per
       thousand rows) go through the driver.
    4. All documents are scored from their features; ``kept``: a score of ``min_score``.

    Null and empty texts have no features and get the score of nothing but the bias.
    Repeated rows give a row each, a null ``doc_id`` stays null (and teaches like others),
    an empty table gives no rows, other columns are ignored.
    """
    rows = staged(_described(docs), "described")
    rules = rule_votes()
    names = [f"vote_{name}" for name in rules]
    voted = rows.select("*", *(vote.alias(f"vote_{name}") for name, vote in rules.items()))
    model = fit_votes(voted, names)
    labelled = voted.withColumn("weak_label", posterior_column(model, names)).drop(*names)
    sided = labelled.withColumn("good", (F.col("weak_label") >= 0.5).cast("int"))
    stand_for = {row["good"]: row["count"] for row in sided.groupBy("good").count().collect()}
    sample = bounded_sample(sided, "good", per_side).select("good", "weak_label", "columns", "counts")
    taught = sorted(tuple(row) for row in sample.collect())
    scorer = None
    if taught:
        sides = np.array([row[0] for row in taught])
        weight = np.array([stand_for[side] / (sides == side).sum() for side in sides])
        target = np.array([row[1] for row in taught])
        scorer = LinearScorer.fit(matrix([r[2] for r in taught], [r[3] for r in taught]), target, weight)

    def scored(batches):
        for batch in batches:
            found = batch.column(1).to_numpy(zero_copy_only=False)  # nothing was taught
            if batch.num_rows and scorer is not None:
                parts = [
                    scorer.score(matrix(part.column(2).to_pylist(), part.column(3).to_pylist()))
                    for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000))
                ]
                found = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.float64())],
                ["doc_id", "weak_label", "score"],
            )

    out = labelled.select("doc_id", "weak_label", "columns", "counts").mapInArrow(
        scored, "doc_id long, weak_label double, score double"
    )
    return out.withColumn("kept", F.col("score") >= min_score)

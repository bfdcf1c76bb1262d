"""Quality rules whose votes are weighed by weak supervision instead of all having to pass."""

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import runs, texts_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Per text: what the rules look at.
STATISTICS = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "n_lines": "long",
    "n_letters": "long",
    "n_distinct_words": "long",
    "n_upper": "long",
    "n_unspaced": "long",
}

_WHITE = " \t\n\v\f\r"
_LETTERS = re.compile(r"[^\W\d_]+")
#: Vowel signs, accents and the like, which belong to the letters they stand beside.
_MARKS = re.compile(
    "[" + "".join(c for c in map(chr, range(0x300, 0x11000)) if unicodedata.category(c)[0] == "M") + "]+"
)
#: Thai, Lao, Burmese, Khmer, kana and Han: words are not parted by white space.
_UNSPACED = re.compile(
    "[\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff]+"
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words (a power of two) found twice or more.

    Windows are numbered exactly: equal pairs of equal halves get equal numbers, from one
    word up to the whole window.
    """
    if len(words) <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(word, len(numbers)) for word in words], np.int64)
    width = 1
    while width < window:
        pairs = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        _, ids = np.unique(pairs, return_inverse=True)
        width *= 2
    twice = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def text_statistics(text: str) -> tuple[int, ...]:
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at the six white characters
    spaces = sum(map(text.count, _WHITE))
    lines = [line for line in text.split("\n") if line.strip(_WHITE)]
    letters = _LETTERS.findall(text)
    marks = unspaced = 0
    if not text.isascii():
        marks = sum(map(len, _MARKS.findall(text)))
        unspaced = sum(map(len, _UNSPACED.findall(text)))
    return (
        len(words),
        len(text) - spaces,
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(map(len, letters)) + marks,
        len(set(words)),
        sum(word.isupper() and len(word) > 1 for word in letters),
        unspaced,
    )


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the ``STATISTICS`` of every whole text; one pass, no shuffle."""

    def counted(batches):
        for batch in runs(batches):
            found = [text_statistics(text) for text in batch.column(1).to_pylist()]
            columns = list(zip(*found, strict=True)) or [()] * len(STATISTICS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(column, pa.int64()) for column in columns)],
                ["doc_id", *STATISTICS],
            )

    schema = ", ".join(f"{name} {kind}" for name, kind in STATISTICS.items())
    return texts_of(docs).mapInArrow(counted, f"doc_id long, {schema}")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1)


def rule_votes() -> dict[str, Column]:
    """1: good, 0: bad, null: the rule abstains."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    length = F.col("word_chars") / words
    symbols = F.col("n_symbols") / words
    symbol_chars = F.col("n_symbols") / chars
    letters = F.col("n_letters") / chars
    dup = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    windows = F.col("n_repeat_words") / words
    upper = F.col("n_upper") / words
    distinct = F.col("n_distinct_words") / words
    spaced = 2 * F.col("n_unspaced") <= F.col("n_letters")
    return {
        "length": _vote(F.col("n_words") >= 50, F.col("n_words") < 1),
        "word_length": _vote(length.between(3, 9), spaced & ((length < 2) | (length > 15))),
        "symbols": _vote(symbols < 0.02, symbols > 0.2),
        "symbol_chars": _vote(symbol_chars < 0.005, symbol_chars > 0.04),
        "letters": _vote(letters > 0.93, letters < 0.88),
        "repeated_lines": _vote(dup < 0.05, dup > 0.3),
        "repeated_windows": _vote(windows < 0.05, windows > 0.25),
        "distinct_words": _vote((distinct > 0.3) & (F.col("n_words") >= 50), distinct < 0.1),
        "capitals": _vote(upper < 0.1, upper > 0.4),
    }


class VoteModel:
    """How rules vote on good and on bad documents, by expectation-maximisation.

    Given the hidden quality, rules that don't abstain vote independently, each with a
    chance of its own to be right on good and on bad documents; who abstains says nothing.
    The data are the counts of the vote patterns, at most 3 to the power of the number of
    rules, however many documents there are.
    """

    #: Chance of a right vote on a bad and on a good document, before any data: each rule
    #: looks for one fault, which few bad documents have, and hardly any good one.
    START = (0.3, 0.98)

    def __init__(self, rules: int, prior: float = 0.9, rounds: int = 200):
        self.prior, self.rounds = prior, rounds
        self.right = np.repeat(np.array(self.START)[:, None], rules, axis=1)

    def fit(self, patterns: np.ndarray, counts: np.ndarray) -> "VoteModel":
        """``patterns``: a row per pattern of 0, 1 and -1 (abstains)."""
        if not counts.sum():
            return self
        for _ in range(self.rounds):
            good = self.posterior(patterns)
            for quality, weight in ((0, (1 - good) * counts), (1, good * counts)):
                # As if ten votes had been seen before.
                right = weight @ (patterns == quality) + 10 * self.START[quality]
                self.right[quality] = right / (weight @ (patterns >= 0) + 10)
            self.prior = float(np.clip((good @ counts + 9) / (counts.sum() + 10), 0.5, 0.999))
        return self

    def accuracy(self) -> np.ndarray:
        """Share of right ones among the votes of each rule."""
        return self.prior * self.right[1] + (1 - self.prior) * self.right[0]

    def evidence(self) -> np.ndarray:
        """Log odds for good quality of each rule's votes, (rule, vote): bad, good, none."""
        bad, good = self.right
        votes = [np.log((1 - good) / bad), np.log(good / (1 - bad)), np.zeros_like(good)]
        return np.stack(votes, axis=1)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good quality for each pattern."""
        evidence = self.evidence()
        total = sum(evidence[rule, patterns[:, rule]] for rule in range(patterns.shape[1]))
        return 1 / (1 + np.exp(-(np.log(self.prior / (1 - self.prior)) + total)))


def fit_votes(votes: DataFrame, names: list[str]) -> VoteModel:
    """From all rows of ``votes``: they are counted by pattern before anything moves."""
    found = votes.groupBy(*names).count().collect()
    patterns = np.array([[-1 if v is None else v for v in row[:-1]] for row in found], np.int64)
    counts = np.array([row[-1] for row in found], np.float64)
    return VoteModel(len(names)).fit(patterns.reshape(-1, len(names)), counts)


def posterior_column(model: VoteModel, names: list[str]) -> Column:
    """The model as an expression over the vote columns."""
    total = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for name, (bad, good, none) in zip(names, model.evidence(), strict=True):
        total += F.when(F.col(name) == 0, float(bad)).when(F.col(name) == 1, float(good)).otherwise(float(none))
    return 1 / (1 + F.exp(-total))


def judge(docs: DataFrame, min_posterior: float = 0.5) -> DataFrame:
    """Statistics, votes and verdict for every document.

    Columns: ``doc_id``, the ``STATISTICS``, ``vote_<rule>`` (1, 0 or null), ``posterior``
    (probability of good quality), ``base_failed`` and ``kept``. Documents that fail the
    base rules (fewer than 20 words, or over 30 % of the words in repeated windows) are not
    kept and teach nothing; of the others those with a posterior of ``min_posterior`` stay.

    Texts are read once; the statistics are staged, since the accuracies need all of them
    before the first verdict. Null and empty texts have no words and fail the base rules.
    Repeated rows give a row each, a null ``doc_id`` stays null, an empty table gives no
    rows, other columns are ignored.
    """
    rows = staged(statistics(docs), "statistics")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rules = rule_votes()
    names = [f"vote_{name}" for name in rules]
    voted = rows.withColumn("base_failed", failed).select(
        "*", *(vote.alias(f"vote_{name}") for name, vote in rules.items())
    )
    model = fit_votes(voted.where("NOT base_failed"), names)
    return voted.withColumn("posterior", posterior_column(model, names)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= min_posterior)
    )

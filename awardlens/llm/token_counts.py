"""Token counts per section of a document, from one encoding of the whole document."""

import base64
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident, runs, shared_file, texts_of

RULES = ("first", "last", "most")
#: A section is a line with its line end, the default for ``sections``.
LINES = r"[^\n]*\n|[^\n]+"


class SpanEncoder:
    """Ids of a text and where each token starts and ends, in characters.

    The tokens of a byte-level vocabulary spell the text's bytes without a gap, so the
    lengths of the tokens give the spans. A token that starts inside a character (one of
    several tokens that share it) is said to start at that character.
    """

    def __init__(self, data: bytes, pattern: str):
        import tiktoken

        ranks = {
            base64.b64decode(token): int(rank)
            for token, rank in map(bytes.split, data.splitlines())
        }
        self.encoding = tiktoken.Encoding(
            "corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, first character and end (exclusive) of each token."""
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        if not text.isascii():
            data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            # Character that each byte belongs to: continuation bytes start no character.
            character = np.cumsum((data & 0xC0) != 0x80) - 1
            starts, ends = character[starts], character[ends - 1] + 1
        return ids, starts, ends


def section_bounds(text: str, sections: "re.Pattern") -> np.ndarray:
    """Start of every section and, last, the end of the text; sections cover the text."""
    starts = [match.start() for match in sections.finditer(text) if match.end() > match.start()]
    if not starts or starts[0]:
        starts.insert(0, 0)
    return np.array([*starts, len(text)], np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str):
    """Section of each token, and whether the token reaches over a boundary.

    An interval join of two sorted lists: the sections of a token's first and last
    character are found by bisection. A token in several sections goes to the first, the
    last, or the one with most of its characters (the earlier, if there are several).
    """
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    crossing = last > first
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    most = first.copy()
    for token in np.flatnonzero(crossing):
        held = [
            min(ends[token], bounds[s + 1]) - max(starts[token], bounds[s])
            for s in range(first[token], last[token] + 1)
        ]
        most[token] = first[token] + int(np.argmax(held))
    return most, crossing


SCHEMA = (
    "doc_id long, section long, start long, end long, n_tokens long, n_crossing long,"
    " doc_tokens long"
)


def count_tokens(
    docs: DataFrame, vocabulary: str, pattern: str, sections: str = LINES, rule: str = "most"
) -> DataFrame:
    """Tokens of every section of every document, each token counted once.

    A document is encoded once, as a whole, and its tokens are attributed to the sections
    that the pattern ``sections`` marks (what lies between two belongs to the one before).
    One row per section: ``doc_id``, ``section`` (from 0), ``start`` and ``end`` in
    characters, ``n_tokens``, ``n_crossing`` (those among them that reach into another
    section), ``doc_tokens``. The ``n_tokens`` of a document add up to ``doc_tokens``.

    ``rule`` says who gets a token that crosses a boundary: ``first`` or ``last`` the
    section of its first or last character, ``most`` the one with most of its characters,
    the earlier of equals. Sections without a token of their own have 0.

    Null and empty texts are one empty section without tokens. Rows are independent, so
    nothing is shuffled: repeated rows give their sections each, a null ``doc_id`` stays
    null, an empty table gives no rows, other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    data = shared_file(docs.sparkSession, vocabulary)

    def counted(batches):
        make = partial(SpanEncoder, data.value, pattern)
        encoder = resident("token_counts", (hash(data.value), pattern), make)
        find = re.compile(sections)
        for batch in runs(batches):
            columns: list[list] = [[] for _ in range(7)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, starts, ends = encoder.spans(text)
                bounds = section_bounds(text, find)
                n = len(bounds) - 1
                owner, crossing = attribute(starts, ends, bounds, rule)
                rows = (
                    [doc] * n,
                    range(n),
                    bounds[:-1].tolist(),
                    bounds[1:].tolist(),
                    np.bincount(owner, minlength=n).tolist(),
                    np.bincount(owner[crossing], minlength=n).tolist(),
                    [len(ids)] * n,
                )
                for column, values in zip(columns, rows, strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, pa.int64()) for column in columns],
                [part.split()[0] for part in SCHEMA.split(",")],
            )

    return texts_of(docs).mapInArrow(counted, SCHEMA)


def by_document(counts: DataFrame) -> DataFrame:
    """Sections, tokens and crossing tokens of each document id."""
    return counts.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_sections"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_crossing").alias("n_crossing"),
    )

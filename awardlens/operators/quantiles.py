"""Quantiles of a column, exact at any size.

Spark's exact ``percentile`` functions gather all distinct values in one task, and a
global sort moves the whole column. Here an exact order statistic is found by narrowing:
``approx_percentile`` proposes a small value range around the rank, one aggregate counts
exactly what lies below and inside it, and this repeats until few enough rows are left
to pick from. Every step is a map-side combined aggregate over a single column.
"""

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("nearest", "disc", "approx")


@dataclass(frozen=True)
class Proposal:
    """What is known of a column beforehand: its exact rows and range, and likely quantiles.

    ``likely(q)`` may be wrong by any amount; the exact counts only take longer then.
    """

    rows: int
    low: float | None
    high: float | None
    likely: Callable[[Sequence[float]], list[float]]


@dataclass(frozen=True)
class _Span:
    """The sought row has ``skip`` smaller rows among the ``rows`` in [low, high]."""

    low: float
    high: float
    rows: int
    skip: int

    def holds(self) -> Column:
        return F.col("v").between(F.lit(self.low), F.lit(self.high))

    def is_one_value(self) -> bool:
        both_nan = self.low != self.low and self.high != self.high
        return both_nan or self.low == self.high

    def is_wide(self, pick_limit: int) -> bool:
        return self.rows > pick_limit and not self.is_one_value()


def quantiles(
    df: DataFrame,
    column: str,
    probabilities: Sequence[float],
    method: str = "nearest",
    pick_limit: int = 200_000,
    accuracy: int = 10_000,
    proposal: Proposal | None = None,
) -> list[float | None]:
    """Quantiles of the non-null values.

    ``nearest`` takes the row at ``round(p * (n - 1))``, ``disc`` the first row whose
    cumulative share reaches ``p``, ``approx`` asks for an estimate in one pass. A
    ``proposal`` from summaries that are kept elsewhere saves the first pass of the others.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, got {method!r}")
    values = df.select(F.col(f"`{column}`").alias("v")).filter(F.col("v").isNotNull())
    if method == "approx":
        row = values.agg(F.percentile_approx("v", list(probabilities), accuracy)).first()
        return list(row[0]) if row[0] is not None else [None] * len(probabilities)

    proposal = proposal or _proposal(values, probabilities, accuracy)
    n = proposal.rows
    if n == 0:
        return [None] * len(probabilities)
    spans = [_Span(proposal.low, proposal.high, n, _rank(p, n, method)) for p in probabilities]
    guesses = {i: proposal.likely(_around(p, accuracy)) for i, p in enumerate(probabilities)}
    while wide := [i for i, span in enumerate(spans) if span.is_wide(pick_limit)]:
        guesses = guesses or _guess(values, spans, wide, accuracy)
        spans = _narrow(values, spans, {i: guesses[i] for i in wide})
        guesses = None
    return _pick(values, spans)


def _proposal(values: DataFrame, probabilities: Sequence[float], accuracy: int) -> Proposal:
    """Row count, range and first guesses, all in one pass."""
    first = values.agg(
        F.count("v"),
        F.min("v"),
        F.max("v"),
        *(F.percentile_approx("v", _around(p, accuracy), accuracy) for p in probabilities),
    ).first()
    found = {tuple(_around(p, accuracy)): first[3 + i] for i, p in enumerate(probabilities)}
    return Proposal(*first[:3], lambda around: found[tuple(around)])


def _rank(p: float, n: int, method: str) -> int:
    if method == "nearest":
        return math.floor(p * (n - 1) + 0.5)
    return max(math.ceil(p * n) - 1, 0)


def _around(q: float, accuracy: int) -> list[float]:
    margin = 2.0 / accuracy
    return [max(q - margin, 0.0), q, min(q + margin, 1.0)]


def _guess(
    values: DataFrame, spans: list[_Span], wide: list[int], accuracy: int
) -> dict[int, list[float]]:
    """Values just left of, at and just right of each sought row, approximately."""
    row = values.agg(
        *(
            F.percentile_approx(
                F.when(spans[i].holds(), F.col("v")),
                _around((spans[i].skip + 0.5) / spans[i].rows, accuracy),
                accuracy,
            )
            for i in wide
        )
    ).first()
    return dict(zip(wide, row))


def _narrow(
    values: DataFrame, spans: list[_Span], guesses: dict[int, list[float]]
) -> list[_Span]:
    """Replace each span by the zone between its guesses that holds the sought row."""

    def zones(i: int) -> list[Column]:
        left, middle, right = guesses[i]
        v, inside = F.col("v"), spans[i].holds()
        return [
            inside & (v < left),
            inside & (v >= left) & (v < middle),
            inside & (v == middle),
            inside & (v > middle) & (v <= right),
            inside & (v > right),
        ]

    counted = values.agg(
        *(
            F.struct(
                F.count_if(zone).alias("rows"),
                F.min(F.when(zone, F.col("v"))).alias("low"),
                F.max(F.when(zone, F.col("v"))).alias("high"),
            ).alias(f"z{i}_{k}")
            for i in guesses
            for k, zone in enumerate(zones(i))
        )
    ).first()

    narrowed = list(spans)
    for i in guesses:
        skip = spans[i].skip
        for k in range(5):
            zone = counted[f"z{i}_{k}"]
            if skip < zone["rows"]:
                narrowed[i] = _Span(zone["low"], zone["high"], zone["rows"], skip)
                break
            skip -= zone["rows"]
    return narrowed


def _pick(values: DataFrame, spans: list[_Span]) -> list[float]:
    """Read the sought rows out of spans of at most ``pick_limit`` rows, in one job."""
    found = {i: span.low for i, span in enumerate(spans) if span.is_one_value()}
    picks = [
        values.filter(span.holds())
        .orderBy("v")
        .offset(span.skip)
        .limit(1)
        .select(F.lit(i).alias("i"), "v")
        for i, span in enumerate(spans)
        if i not in found
    ]
    if picks:
        found.update((row["i"], row["v"]) for row in reduce(DataFrame.unionByName, picks).collect())
    return [found[i] for i in range(len(spans))]

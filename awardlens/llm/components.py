"""Connected components of a graph given as edges, without a driver in the way."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang the neighbours of every node on its smallest neighbour (or itself).

    ``larger``: those above the node; otherwise those below it, and the node.
    """
    if larger:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
        out = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("least"))  # here b < a
        out = (
            edges.join(least.hint("merge"), "a")
            .select(F.col("b").alias("a"), F.col("least").alias("b"))
            .union(least.select("a", F.col("least").alias("b")))
        )
    return out.where("a > b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) of all nodes but the roots.

    ``edges`` has columns ``a`` and ``b``; loops and repeated edges are fine. Alternates
    large and small stars until nothing changes: rounds grow with the logarithm of the
    longest path. A node with very many edges is a key of a join that Spark can split;
    every round is written to the shared scratch folder.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = staged(edges.select(a, b).where("a > b").distinct(), name)

    def mark(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    before = mark(now)
    while before[0]:
        now = staged(_stars(staged(_stars(now, True), name), False), name)
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))

"""Seeded samples of an exact size, drawn without collecting a stratum in one place.

Every row gets a draw: the MD5 of the seed and all its cells. The sample of a stratum of
``n`` rows is its ``floor(fraction * n)`` smallest draws. Ranking a stratum would put it
all in one task, so the last draw that is still in (the *cut*) is searched for instead:

1. count rows per stratum and draw prefix (at most 65,536 counters per stratum);
2. the running count tells the prefix in which the cut lies;
3. while many rows share that prefix it is made longer in the same way; then only rows
   with that prefix are counted per draw, which gives the cut itself.

After that, membership is a comparison of a row's draw with its stratum's cut. Copies of
one row share a draw; they are counted, never ranked, so any number of copies is fine.
Strata and draws are staged first, or whole rows with them: the passes read those.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import measured, staged

PREFIX_DIGITS = 4
# Rows of a stratum with one prefix that may be ordered in one task.
EDGE_ROWS = 500_000
COPY_CHUNK = 1 << 16
DRAW_DIGITS = 32


def check_fraction(fraction: float) -> float:
    if fraction is None or not 0 < fraction <= 1:
        raise ValueError(f"sample fraction must be above 0 and at most 1, got {fraction!r}")
    return float(fraction)


def draw_of(df: DataFrame, columns: Sequence[str], seed: int) -> Column:
    """The row's draw over ``columns``. Amounts enter with six decimals."""
    kinds = dict(df.dtypes)

    def text(name: str) -> Column:
        column = F.col(f"`{name}`")
        if kinds[name] in ("double", "float"):
            column = column.try_cast("decimal(38,6)")
        return F.coalesce(column.cast("string"), F.lit("~"))

    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(text(name) for name in columns)))


def same_stratum(left: DataFrame, right: DataFrame, strata: Sequence[str]) -> Column:
    """Null-safe equality on every stratum column."""
    tests = [left[name].eqNullSafe(right[f"_of_{name}"]) for name in strata]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def prefix_counts(drawn: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per values of ``by`` and first digits of the ``_draw``: ``by``, ``_prefix``, ``_n``.

    Counts of parts of the rows add up to those of all, so they can be kept per part.
    """
    prefix = F.substring("_draw", 1, PREFIX_DIGITS).alias("_prefix")
    return drawn.groupBy(*(f"`{name}`" for name in by), prefix).agg(F.count(F.lit(1)).alias("_n"))


def _crossing(counted: DataFrame, names: Sequence[str], order: str) -> DataFrame:
    """The row in which the running count reaches ``_take``; ``_left`` remain in it."""
    stratum = Window.partitionBy(*names)
    upto = F.sum("_n").over(stratum.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return (
        counted.withColumn("_before", upto - F.col("_n"))
        .filter((F.col("_before") < F.col("_take")) & (F.col("_before") + F.col("_n") >= F.col("_take")))
        .withColumn("_left", F.col("_take") - F.col("_before"))
    )


def _edges(counted: DataFrame, names: Sequence[str]) -> DataFrame:
    return measured(
        _crossing(counted, names, "_prefix").select(
            *(F.col(name).alias(f"_edge{name}") for name in names),
            F.col("_prefix").alias("_edge_prefix"),
            F.col("_left").alias("_take"),
            F.col("_n").alias("_rows"),
        )
    )


def first_edges(counts: DataFrame, fraction: float, strata: Sequence[str] = ()) -> DataFrame:
    """Per stratum the prefix in which the cut lies, of ``prefix_counts`` by strata, or of parts."""
    names = [f"_of_{name}" for name in strata]
    whole = counts.groupBy(
        *(F.col(f"`{name}`").alias(alias) for name, alias in zip(strata, names)), "_prefix"
    ).agg(F.sum("_n").alias("_n"))
    rows = F.sum("_n").over(Window.partitionBy(*names))
    return _edges(whole.withColumn("_take", F.floor(F.lit(fraction) * rows).cast("long")), names)


def _met(left: DataFrame, edges: DataFrame, own: Sequence[str], names: Sequence[str], test: Column) -> DataFrame:
    same = [F.col(name).eqNullSafe(F.col(f"_edge{of}")) for name, of in zip(own, names)]
    return left.join(edges, reduce(lambda a, b: a & b, same, test))


def sample_cuts(
    drawn: DataFrame, fraction: float, strata: Sequence[str] = (), edges: DataFrame | None = None
) -> DataFrame:
    """One row per non-empty sample: ``_of_<stratum>``, ``_cut``, ``_at_cut``, ``_copies``.

    ``drawn`` holds the strata and a ``_draw`` per row. ``_copies`` rows have the cut as
    their draw; ``_at_cut`` of them are in the sample. With known ``first_edges`` only
    rows with the edge prefixes have to be there.
    """
    fraction = check_fraction(fraction)
    names = [f"_of_{name}" for name in strata]
    draws = drawn.select(
        *(F.col(f"`{name}`").alias(alias) for name, alias in zip(strata, names)), "_draw"
    )

    def at_edge(edges: DataFrame, digits: int) -> DataFrame:
        """The draws that begin with their stratum's edge prefix."""
        return _met(draws, edges, names, names, F.substring("_draw", 1, digits) == F.col("_edge_prefix"))

    digits = PREFIX_DIGITS
    if edges is None:
        edges = first_edges(prefix_counts(drawn, strata), fraction, strata)
    while digits < DRAW_DIGITS and (edges.agg(F.max("_rows")).first()[0] or 0) > EDGE_ROWS:
        longer = at_edge(edges, digits)
        digits += PREFIX_DIGITS
        prefix = F.substring("_draw", 1, digits).alias("_prefix")
        wider, edges = edges, _edges(
            longer.groupBy(*names, prefix, "_take").agg(F.count(F.lit(1)).alias("_n")), names
        )
        wider.unpersist()
    per_draw = at_edge(edges, digits).groupBy(*names, "_draw", "_take").agg(F.count(F.lit(1)).alias("_n"))
    cuts = measured(
        _crossing(per_draw, names, "_draw").select(
            *names,
            F.col("_draw").alias("_cut"),
            F.col("_left").alias("_at_cut"),
            F.col("_n").alias("_copies"),
        )
    )
    edges.unpersist()
    return cuts


def exact_sample(
    df: DataFrame,
    fraction: float,
    seed: int,
    strata: Sequence[str] = (),
    stage_rows: bool = False,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Exactly ``floor(fraction * n)`` rows of every stratum, without replacement.

    With ``stage_rows`` whole rows are staged with their draws: right for few or narrow rows
    behind joins or a filter, which are then computed once. Otherwise only strata and draws
    are, and the input is read a second time for the result. With ``counts`` known
    (``prefix_counts`` by strata of these rows and draws, or of parts of them) the input is read
    once, and only rows up to the prefix of the cut are staged, hardly more than the sample.
    """
    fraction = check_fraction(fraction)
    columns = df.columns
    drawn = df.withColumn("_draw", draw_of(df, columns, seed))
    narrow = [*(f"`{name}`" for name in strata), "_draw"]
    edges = None
    if counts is not None:
        edges, names = first_edges(counts, fraction, strata), [f"_of_{name}" for name in strata]
        own = [f"`{name}`" for name in strata]
        upto = F.substring("_draw", 1, PREFIX_DIGITS) <= F.col("_edge_prefix")
        if strata:
            near = _met(drawn, edges, own, names, upto)
        else:
            edge = edges.first()
            near = drawn.filter(F.substring("_draw", 1, PREFIX_DIGITS) <= F.lit(edge and edge["_edge_prefix"]))
        near = near.select(*(f"`{name}`" for name in columns), "_draw")
        drawn = staged(near, "drawn-to-the-edge")
    elif stage_rows:
        drawn = staged(drawn, "drawn-rows")
    whole_rows = stage_rows or counts is not None
    facts = drawn.select(*narrow) if whole_rows else staged(drawn.select(*narrow), "draws")
    cuts = sample_cuts(facts, fraction, strata, edges)
    if strata:
        met = drawn.join(cuts, same_stratum(drawn, cuts, strata))
    else:
        only = cuts.first()
        if only is None:
            return df.limit(0)
        met = drawn.withColumns({name: F.lit(only[name]) for name in ("_cut", "_at_cut", "_copies")})
    at_cut = F.col("_draw") == F.col("_cut")
    split = F.col("_at_cut") < F.col("_copies")
    whole = met.filter((F.col("_draw") < F.col("_cut")) | (at_cut & ~split)).select(
        *(f"`{name}`" for name in columns)
    )
    if cuts.filter(split).isEmpty():
        return whole

    # Some stratum takes only a part of the copies at its cut: count the copies and give
    # back as many as are due.
    copies = met.filter(at_cut & split).groupBy(*(f"`{name}`" for name in columns), "_at_cut")
    upto = F.sum("_n").over(
        Window.partitionBy(*strata)
        .orderBy(*(F.asc_nulls_first(f"`{name}`") for name in columns))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    due = (
        copies.agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", upto - F.col("_n"))
        .withColumn("_due", F.least(F.col("_n"), F.col("_at_cut") - F.col("_before")))
        .filter(F.col("_due") > 0)
    )
    return whole.unionByName(_repeated(due, "_due").select(*(f"`{name}`" for name in columns)))


def _repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row ``times`` times. A large number is dealt out to all tasks in chunks."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.floor((F.col(times) - 1) / F.lit(COPY_CHUNK))
    chunked = rows.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    size = F.least(F.lit(COPY_CHUNK).cast("long"), F.col(times) - F.col("_chunk") * COPY_CHUNK)
    return (
        chunked.withColumn("_size", size)
        .repartition(tasks, "_chunk")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_size"))))
    )


def fast_sample(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """One-pass Bernoulli sample: each row with probability ``fraction``, size varies.

    Every stratum is then sampled at about the same fraction too.
    """
    return df.sample(withReplacement=False, fraction=check_fraction(fraction), seed=seed)

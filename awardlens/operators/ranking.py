"""Share of a total and top-n inside each group."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ieee_div


def with_share(groups: DataFrame, per: str, value: str, share: str) -> DataFrame:
    """Add each row's part of the sum of ``value`` over its ``per`` partition.

    Meant for aggregated rows of a small domain (year by award type).
    """
    total = F.sum(value).over(Window.partitionBy(per))
    return groups.withColumn(share, ieee_div(F.col(value), total))


def top_n_with_share(
    groups: DataFrame,
    per: str,
    value: str,
    ties: Sequence[str],
    n: int,
    share: str,
    lanes: int = 64,
) -> DataFrame:
    """The ``n`` largest rows of each ``per`` group, with their share of the whole group.

    The share is of the total *before* the cut to ``n``. A group may have any number of
    rows, so it is first split into hashed lanes: each lane yields its total and its own
    top n, and only those (at most ``n * lanes`` rows per group) meet in one task.
    """
    order = [F.desc(value), *(F.asc_nulls_first(column) for column in ties)]
    lane = Window.partitionBy(per, "_lane")
    whole = Window.partitionBy(per)
    leaders = (
        groups.withColumn("_lane", F.pmod(F.xxhash64(*ties), F.lit(lanes)))
        .withColumns(
            {
                "_lane_total": F.sum(value).over(lane),
                "_lane_rank": F.row_number().over(lane.orderBy(*order)),
            }
        )
        .filter(F.col("_lane_rank") <= n)
    )
    return (
        leaders.withColumns(
            {
                "_total": F.sum(F.when(F.col("_lane_rank") == 1, F.col("_lane_total"))).over(whole),
                "_rank": F.row_number().over(whole.orderBy(*order)),
            }
        )
        .filter(F.col("_rank") <= n)
        .withColumn(share, ieee_div(F.col(value), F.col("_total")))
        .select(*groups.columns, share)
    )

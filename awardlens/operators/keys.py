"""Key-based operators: distinct values, key filters, attaching columns, unions."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, ascending, null first when there is one."""
    return df.select(column).distinct().orderBy(F.asc_nulls_first(column))


def restrict_to_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``keys``; each row once, however often its key occurs."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def attach_totals(
    left: DataFrame, rows: DataFrame, key: str, totals: Sequence[Column]
) -> DataFrame:
    """Left join with one row per key: ``totals`` over all rows of the key.

    The rows are summed up before the join, on the map side first, so each left row stays
    one row however often its key repeats on the right.
    """
    return left.join(rows.groupBy(key).agg(*totals), key, "left")


def attach_by_key(left: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Left join on the key with every column of ``rows`` that ``left`` lacks."""
    missing = [name for name in rows.columns if name not in left.columns]
    return left.join(rows.select(key, *(f"`{name}`" for name in missing)), key, "left")


def union_widened(frames: Sequence[DataFrame], fill_missing: bool = False) -> DataFrame:
    """UNION ALL by column name; numeric types widen, text against another type is text.

    With ``fill_missing`` a column that a frame lacks is null in its rows.
    """
    kinds: dict[str, set[str]] = {}
    for frame in frames:
        for name, kind in frame.dtypes:
            kinds.setdefault(name, set()).add(kind)
    as_text = {name for name, seen in kinds.items() if len(seen) > 1 and "string" in seen}

    def aligned(frame: DataFrame) -> DataFrame:
        casts = {n: F.col(f"`{n}`").cast("string") for n in frame.columns if n in as_text}
        return frame.withColumns(casts) if casts else frame

    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=fill_missing), map(aligned, frames)
    )

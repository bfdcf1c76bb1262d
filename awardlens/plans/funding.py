"""Funding reports over contract transactions.

Each report takes the transactions (or a rollup of them) and returns a small DataFrame.
The only wide shuffle is the first aggregate, which combines on the map side, so a year,
sector or award type holding most of the rows costs no more than any other.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ieee_div, row_count, sum0
from ..functions.sectors import sector_name
from ..operators.ranking import top_n_with_share, with_share

YEAR = "action_date_fiscal_year"

# The columns the reports read.
REPORT_COLUMNS = [
    "action_date_fiscal_year",
    "total_dollars_obligated",
    "total_outlayed_amount_for_overall_award",
    "federal_action_obligation",
    "naics_code",
    "naics_description",
    "award_type",
]

ROLLUP_KEYS = [YEAR, "naics_code", "naics_description", "award_type"]
ROLLUP_ROWS = "transactions"


def funding_rollup(rows: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """Sums and row counts per (year, NAICS code and description, award type).

    Every report below accepts this instead of the transactions, so one stored rollup
    serves all reports under any filter. ``per`` are columns to keep apart besides.
    """
    return rows.groupBy(*per, *ROLLUP_KEYS).agg(
        sum0(F.col("total_dollars_obligated")).alias("total_dollars_obligated"),
        sum0(F.col("total_outlayed_amount_for_overall_award")).alias(
            "total_outlayed_amount_for_overall_award"
        ),
        sum0(F.col("federal_action_obligation")).alias("federal_action_obligation"),
        row_count().alias(ROLLUP_ROWS),
    )


def _transactions(rows: DataFrame) -> Column:
    return F.sum(ROLLUP_ROWS) if ROLLUP_ROWS in rows.columns else row_count()


def _of_years(rows: DataFrame, years: Sequence[int] | None) -> DataFrame:
    return rows if years is None else rows.filter(F.col(YEAR).isin(list(years)))


def funding_trends(rows: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """Funding per fiscal year and its change from the previous year in the data."""
    per_year = (
        _of_years(rows, years)
        .groupBy(YEAR)
        .agg(
            sum0(F.col("total_dollars_obligated")).alias("total_obligated"),
            sum0(F.col("total_outlayed_amount_for_overall_award")).alias("total_outlayed"),
            sum0(F.col("federal_action_obligation")).alias("federal_obligation"),
            _transactions(rows).alias("number_of_awards"),
        )
        .withColumn(
            "average_obligated_per_award", F.col("total_obligated") / F.col("number_of_awards")
        )
    )
    # One row per fiscal year from here on, so a single window over all of them is small.
    in_order = Window.orderBy(F.asc_nulls_first(YEAR))
    previous = F.col("previous_year_obligated")
    return (
        per_year.withColumn("previous_year_obligated", F.lag("total_obligated").over(in_order))
        .withColumn(
            "yoy_change_percent",
            ieee_div(F.col("total_obligated") - previous, previous) * 100,
        )
        .orderBy(F.asc_nulls_first(YEAR))
    )


def sector_funding(
    rows: DataFrame,
    top_n: int = 5,
    years: Sequence[int] | None = None,
    sectors: Sequence[str] | None = None,
) -> DataFrame:
    """The ``top_n`` NAICS groups of each year by funding, with their share of the year.

    The share is of all groups that pass the filters, not only of the top ones.
    """
    kept = _of_years(rows, years)
    if sectors is not None:
        kept = kept.filter(sector_name(F.col("naics_code")).isin(list(sectors)))
    groups = (
        kept.groupBy(YEAR, "naics_code", "naics_description")
        .agg(
            sum0(F.col("total_dollars_obligated")).alias("total_funding"),
            _transactions(rows).alias("number_of_awards"),
        )
        .select(
            YEAR,
            # A function of the code, so it need not be computed per transaction.
            sector_name(F.col("naics_code")).alias("sector_name"),
            "naics_code",
            "naics_description",
            "total_funding",
            "number_of_awards",
            (F.col("total_funding") / F.col("number_of_awards")).alias(
                "average_funding_per_award"
            ),
        )
    )
    return top_n_with_share(
        groups,
        per=YEAR,
        value="total_funding",
        ties=["sector_name", "naics_code", "naics_description"],
        n=top_n,
        share="funding_share",
    ).orderBy(F.asc_nulls_first(YEAR), F.desc("total_funding"))


def award_types(rows: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """Transactions and funding per year and award type, with shares within the year."""
    groups = (
        _of_years(rows, years)
        .groupBy(YEAR, "award_type")
        .agg(
            _transactions(rows).alias("award_count"),
            sum0(F.col("total_dollars_obligated")).alias("total_funding"),
        )
    )
    counted = with_share(groups, YEAR, "award_count", "count_share")
    return with_share(counted, YEAR, "total_funding", "funding_share").orderBy(
        F.asc_nulls_first(YEAR)
    )

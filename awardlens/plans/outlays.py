"""Outlay check: awards that end in one year with a large outlay.

Totals, counts and both breakdowns come out of one aggregate over one scan. The report
is a single row; the breakdowns are read off that row.
"""

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import iso_date, number_sql
from ..functions.compare import EQUAL, GREATER, LESS, compare3
from ..functions.numbers import null_as_zero, sum0
from ..operators.sampling import check_fraction, exact_sample, fast_sample

# The columns read and their short names.
OUTLAY_COLUMNS = {
    "period_of_performance_current_end_date": "end_date",
    "total_outlayed_amount_for_overall_award": "outlay_amount",
    "current_total_value_of_award": "current_award_value",
    "potential_total_value_of_award": "potential_award_value",
    "total_dollars_obligated": "obligated_amount",
}
CATEGORIES = (LESS, EQUAL, GREATER)
AMOUNTS = ["outlay_amount", "current_award_value", "potential_award_value", "obligated_amount"]


def outlay_rows(rows: DataFrame) -> DataFrame:
    """The five columns under their short names, as a date and four doubles.

    Text that is no date or no number, or that spells a missing cell, becomes null. Columns that already have the right
    type pass through untouched, so filters on them still reach the scan.
    """
    kinds = dict(rows.dtypes)

    def typed(name: str) -> Column:
        column = F.col(name)
        if name == "period_of_performance_current_end_date":
            if kinds[name] == "date":
                return column
            return iso_date(name) if kinds[name] == "string" else column.try_cast("date")
        if kinds[name] == "string":
            return F.expr(number_sql(name, "double"))
        return column if kinds[name] == "double" else column.try_cast("double")

    return rows.select(*(typed(name).alias(name) for name in OUTLAY_COLUMNS)).withColumnsRenamed(
        OUTLAY_COLUMNS
    )


def large_outlay(year: int, min_outlay: float) -> Column:
    """End date inside the year (as a range, which Parquet can skip by) and outlay above."""
    return (
        (F.col("end_date") >= F.lit(date(year, 1, 1)))
        & (F.col("end_date") < F.lit(date(year + 1, 1, 1)))
        & (F.col("outlay_amount") > F.lit(float(min_outlay)))
    )


def filter_awards(
    awards: DataFrame, year: int = 2024, min_outlay: float = 1_000_000
) -> DataFrame:
    return awards.filter(large_outlay(year, min_outlay))


def sample_awards(
    filtered: DataFrame, fraction: float, seed: int = 69, exact: bool = True
) -> DataFrame:
    """``floor(fraction * n)`` of the rows, or about as many in one pass."""
    check_fraction(fraction)
    if not exact:
        return fast_sample(filtered, fraction, seed)
    # Few rows with five columns are left of a scan of everything.
    return exact_sample(filtered, fraction, seed, stage_rows=True)


def _measures(kept: Column) -> list[Column]:
    """The result columns, over the rows for which ``kept`` is true."""
    outlay, current, potential, obligated = (F.when(kept, F.col(name)) for name in AMOUNTS)

    def in_category(left: str, category: str) -> Column:
        comparison = compare3(F.col(left), F.col("potential_award_value"))
        return F.count_if(kept & (comparison == category))

    return [
        F.count_if(kept).alias("result_rows"),
        sum0(outlay).alias("total_outlay"),
        sum0(current).alias("total_current_value"),
        sum0(potential).alias("total_potential_value"),
        sum0(obligated).alias("total_obligated"),
        F.count_if(
            kept
            & (null_as_zero(F.col("outlay_amount")) < null_as_zero(F.col("potential_award_value")))
        ).alias("less_than_potential_count"),
        F.count_if(
            kept
            & (null_as_zero(F.col("outlay_amount")) > null_as_zero(F.col("current_award_value")))
        ).alias("exceeds_current_count"),
        *(in_category("outlay_amount", c).alias(f"outlay_{c}") for c in CATEGORIES),
        *(in_category("obligated_amount", c).alias(f"obligated_{c}") for c in CATEGORIES),
    ]


def _percent(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part), F.col(whole)) * 100


def outlay_report(
    awards: DataFrame,
    year: int = 2024,
    min_outlay: float = 1_000_000,
    sample_fraction: float | None = None,
    seed: int = 69,
) -> DataFrame:
    """One row with row counts, dollar totals, comparison counts and percentages."""
    kept = F.coalesce(large_outlay(year, min_outlay), F.lit(False))
    counts = [F.count(F.lit(1)).alias("total_rows"), F.count_if(kept).alias("filtered_rows")]
    if sample_fraction is None:
        report = awards.agg(*counts, *_measures(kept))
    else:
        sample = sample_awards(filter_awards(awards, year, min_outlay), sample_fraction, seed)
        halves = awards.agg(*counts).unionByName(
            sample.agg(*_measures(F.lit(True))), allowMissingColumns=True
        )
        report = halves.agg(*(F.max(name).alias(name) for name in halves.columns))
    return report.withColumns(
        {
            "filtered_percent": _percent("filtered_rows", "total_rows"),
            "exceeds_current_percent": _percent("exceeds_current_count", "result_rows"),
        }
    )


def _breakdown(report: DataFrame, prefix: str) -> DataFrame:
    """(comparison, len, percentage); a category without rows has no line."""
    lines = F.array(
        *(
            F.struct(
                F.lit(category).alias("comparison"),
                F.col(f"{prefix}_{category}").alias("len"),
                _percent(f"{prefix}_{category}", "result_rows").alias("percentage"),
            )
            for category in CATEGORIES
        )
    )
    return report.select(F.inline(lines)).filter(F.col("len") > 0)


def outlay_vs_potential(report: DataFrame) -> DataFrame:
    return _breakdown(report, "outlay")


def obligated_vs_potential(report: DataFrame) -> DataFrame:
    return _breakdown(report, "obligated")


# Category labels of the printed breakdowns.
CATEGORY_SIGNS = {LESS: "<", EQUAL: "=", GREATER: ">"}


def labelled(breakdown: DataFrame, subject: str) -> DataFrame:
    """Add a readable label such as ``Outlays < Potential``."""
    signs = F.create_map(*[F.lit(text) for pair in CATEGORY_SIGNS.items() for text in pair])
    sign = F.element_at(signs, F.col("comparison"))
    return breakdown.withColumn(
        "label", F.concat_ws(" ", F.lit(subject), sign, F.lit("Potential"))
    )


def throughput(files: DataFrame, seconds: float) -> DataFrame:
    """One row: what the check has read, of ``Drop.files``, and how much of it in a second.

    Rates are null when no time has passed.
    """
    per_second = lambda total: F.try_divide(total.cast("double"), F.lit(float(seconds)))
    totals = files.agg(
        F.count(F.lit(1)).alias("files"),
        F.count("error").alias("broken_files"),
        F.coalesce(F.sum("rows_read"), F.lit(0)).alias("rows_read"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("packed_bytes"),
    )
    return totals.withColumns(
        {
            "seconds": F.lit(float(seconds)),
            "rows_per_second": per_second(F.col("rows_read")),
            "bytes_per_second": per_second(F.col("packed_bytes")),
        }
    )

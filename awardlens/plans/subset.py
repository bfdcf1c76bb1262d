"""A reproducible test subset: stratified sample plus the tails of the award values.

Both parts are per-row predicates once three small facts are known (two quantiles and
one cut per award type), so the subset is a filter over the full rows: nothing is
sampled into lists, unioned, deduplicated and re-joined.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import parse_tf
from ..operators.keys import attach_by_key, attach_totals
from ..operators.quantiles import quantiles
from ..operators.sampling import (
    check_fraction,
    draw_of,
    exact_sample,
    same_stratum,
    sample_cuts,
)
from ..session import scratch_scope, staged
from ..sources.by_key import KeyedRows
from ..sources.tables import read_plain_csv, write_csv
from .summaries import Summary, draw_counts, sample_from_counts

KEY = "contract_award_unique_key"
VALUE = "current_total_value_of_award"
STRATUM = "award_type"

# The columns that identify a subset row, in output order.
INITIAL_COLUMNS = [
    "contract_award_unique_key",
    "current_total_value_of_award",
    "award_type",
    "recipient_name",
    "naics_code",
    "awarding_agency_code",
    "national_interest_action_code",
    "minority_owned_business",
    "woman_owned_business",
]
FLAGS = ("minority_owned_business", "woman_owned_business")
FRACTION, SEED, LOW_TAIL, HIGH_TAIL = 0.2, 69, 0.05, 0.95
UINT32_MAX = 2**32 - 1


def clean_awards(rows: DataFrame) -> DataFrame:
    """All columns, the initial ones first and cleaned."""
    cleaned = rows.withColumns(
        {
            STRATUM: F.coalesce(F.col(STRATUM).cast("string"), F.lit("unknown")),
            **{flag: parse_tf(F.col(flag)) for flag in FLAGS},
        }
    )
    return cleaned.select(*INITIAL_COLUMNS, *(f"`{name}`" for name in remaining_columns(rows)))


def remaining_columns(rows: DataFrame) -> list[str]:
    """The columns that are not initial ones, in input order."""
    return [name for name in rows.columns if name not in INITIAL_COLUMNS]


def as_uint32(code: Column) -> Column:
    """The code as an integer; an error for text or a value outside unsigned 32 bits."""
    whole = code.try_cast("long")
    message = F.concat(F.lit("not an unsigned 32-bit number: "), code.cast("string"))
    return F.when(whole.between(0, UINT32_MAX), whole).otherwise(
        F.when(code.isNotNull(), F.raise_error(message))
    )


def value_thresholds(
    awards: DataFrame, probabilities: Sequence[float] = (LOW_TAIL, HIGH_TAIL), method="nearest"
) -> list[float | None]:
    return quantiles(awards, VALUE, probabilities, method)


def in_tails(low: float | None, high: float | None) -> Column:
    """Strictly beyond either threshold; false where the value or thresholds are missing."""
    value = F.col(VALUE)
    beyond = (value > F.lit(high).cast("double")) | (value < F.lit(low).cast("double"))
    return F.coalesce(beyond, F.lit(False))


def edge_cases(awards: DataFrame, low: float | None, high: float | None) -> DataFrame:
    """Distinct rows in the tails."""
    return awards.select(*INITIAL_COLUMNS).filter(in_tails(low, high)).distinct()


def stratified_sample(
    awards: DataFrame, fraction: float = FRACTION, seed: int = SEED
) -> DataFrame:
    """Exactly ``floor(fraction * n)`` rows of every award type."""
    return exact_sample(awards.select(*INITIAL_COLUMNS), fraction, seed, [STRATUM], stage_rows=True)


def sample_counts(seed: int = SEED) -> Summary:
    """What ``summaries.refresh`` keeps per drop file, so that a sample reads a dataset once."""
    counts = draw_counts(INITIAL_COLUMNS, seed, [STRATUM])
    return lambda rows, per: counts(clean_awards(rows), per)


def sample_by_counts(
    awards: DataFrame, counts: DataFrame, fraction: float = FRACTION, seed: int = SEED
) -> DataFrame:
    """``stratified_sample``, its cuts taken from the ``sample_counts`` kept of the dataset."""
    return sample_from_counts(awards.select(*INITIAL_COLUMNS), counts, fraction, seed, [STRATUM])


def build_subset(
    rows: DataFrame,
    fraction: float = FRACTION,
    seed: int = SEED,
    quantile_method: str = "nearest",
    stage_rows: bool = False,
) -> DataFrame:
    """The rows of the subset with all their own columns.

    With ``stage_rows`` the input is computed once and staged as it is, else it is read twice.
    A row belongs to it when its initial columns were sampled or lie in a tail. Rows that
    agree in all initial columns belong together, as they would after a distinct.
    """
    check_fraction(fraction)
    awards = clean_awards(rows)
    drawn = awards.withColumn("_draw", draw_of(awards, INITIAL_COLUMNS, seed))
    # Award type, value and draw are all that finding the thresholds and cuts needs.
    if stage_rows:
        drawn = staged(drawn, "subset-rows", compression="zstd")
    facts = drawn.select(STRATUM, VALUE, "_draw")
    facts = facts if stage_rows else staged(facts, "subset-facts", compression="zstd")
    low, high = value_thresholds(facts, method=quantile_method)
    cuts = sample_cuts(facts, fraction, [STRATUM])
    sampled = F.coalesce(F.col("_draw") <= F.col("_cut"), F.lit(False))
    return (
        drawn.join(cuts, same_stratum(drawn, cuts, [STRATUM]), "left")
        .filter(sampled | in_tails(low, high))
        .select(*(f"`{name}`" for name in awards.columns))
        .withColumn("naics_code", as_uint32(F.col("naics_code")))
    )


def subset_rows(rows: DataFrame, **options) -> DataFrame:
    """The distinct initial columns of the subset: sample and tails as one set."""
    return build_subset(rows.select(*INITIAL_COLUMNS), stage_rows=True, **options).distinct()


def award_totals() -> list[Column]:
    """What is known of a whole award, over all its transactions."""
    return [
        F.count(F.lit(1)).alias("transactions"),
        F.sum("total_dollars_obligated").alias("award_obligated"),
        F.min("action_date_fiscal_year").alias("first_year"),
        F.max("action_date_fiscal_year").alias("last_year"),
    ]


def subset_by_key(rows: DataFrame, **options) -> DataFrame:
    """Subset rows times the transactions of their award: one line per pair.

    Where keys repeat this grows with the product of both; ``subset_with_totals`` does not.
    """
    return attach_by_key(subset_rows(rows, **options), rows, KEY)


def subset_with_totals(rows: DataFrame, **options) -> DataFrame:
    """The distinct subset rows, each with the totals of its award; one line per subset row."""
    return attach_totals(subset_rows(rows, **options), rows, KEY, award_totals())


def subset_by_layout(rows: KeyedRows, columns: Sequence[str], **options) -> DataFrame:
    """All transactions of the awards that the subset holds, with these columns.

    The layout is by award key: only keys are shuffled, no transaction is.
    """
    # Only keys are asked for, so the subset's rows needn't be made distinct before, nor staged.
    chosen = build_subset(rows.rows(INITIAL_COLUMNS), **options)
    keys = staged(chosen.select(KEY).distinct(), "keys")
    return rows.of_keys(keys, columns)


def subset_with_kept_totals(rows: KeyedRows, **options) -> DataFrame:
    """``subset_with_totals`` over a layout by award key."""
    chosen = staged(subset_rows(rows.rows(INITIAL_COLUMNS), **options), "subset")
    summed = ["total_dollars_obligated", "action_date_fiscal_year"]
    return chosen.join(rows.totals(award_totals(), summed, chosen), KEY, "left")


def subset_job(spark: SparkSession, csv_in: str, csv_out: str, **options) -> None:
    """From a CSV file of transactions to a CSV file of their subset.

    The input is parsed once and staged with its draws in the shared scratch folder, which the
    passes read; the folder is removed when the subset is written.
    """
    with scratch_scope(spark):
        rows = read_plain_csv(spark, csv_in)
        write_csv(build_subset(rows, **options | {"stage_rows": True}), csv_out)

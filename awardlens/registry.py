"""Every operator and report as a named query over the test tables, with its SQL twin.

A query takes (spark, sf_dir). The SQL runs on the plain tables in another engine and
must give the same rows. Sums are rounded in both, since the order of floating-point
addition is free: to the decimals the exact sum has, or for large sums to two, and
quotients to so many that no exact value lies half-way.
"""

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .functions import bool_from_words, file_id, null_tokens_to_null, parse_tf
from .functions.sectors import UNKNOWN_SECTOR
from .operators.keys import attach_by_key, restrict_to_keys, union_widened
from .operators.quantiles import quantiles
from .plans import funding, options, outlays, series, subset, summaries
from .plans.ingest import ingest, read_outlay_drops
from .session import scratch_dir, staged
from .sources import snapshots
from .sources.by_key import read_by_key, write_by_key
from .sources.cells import type_cells
from .sources.drops import read_drops, rows_per_file, year_directories
from .sources.schema_json import schema_from_text
from .sources.tables import csv_columns, read_awards, read_plain_csv, write_awards, write_csv
from .sources.vocabulary import bool_vocabulary

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

GAP_YEARS = [1996, 1998, 2001]
FILTER_YEARS = [1997, 1998, 1999]
FILTER_SECTORS = ["Manufacturing", "Utilities", "Construction", UNKNOWN_SECTOR]
END_YEAR, MIN_OUTLAY, SAMPLE = 2000, 50_000, 0.1


def query(name: str, sql: str | None = None):
    """Register a query over the contract rows; ``sql`` may use the CTE ``awards``."""

    def register(build: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(fixtures.awards(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_awards(sql)
        return build

    return register


def with_awards(sql: str) -> str:
    body = sql.strip()
    lead = "WITH awards AS (" + fixtures.awards_sql() + ")"
    return f"{lead}, {body[5:]}" if body.upper().startswith("WITH ") else f"{lead} {body}"


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({name: F.round(name, d) for name, d in digits.items()})


def text_list(values) -> str:
    return ", ".join("'" + str(value).replace("'", "''") + "'" for value in values)


def sql_sector(naics: str) -> str:
    """Written out here, not taken from the table that the queries use."""
    return f"""CASE substr(cast({naics} AS varchar), 1, 2)
       WHEN '11' THEN 'Agriculture, Forestry, Fishing and Hunting'
       WHEN '21' THEN 'Mining, Quarrying, and Oil and Gas Extraction'
       WHEN '22' THEN 'Utilities' WHEN '23' THEN 'Construction'
       WHEN '31' THEN 'Manufacturing' WHEN '32' THEN 'Manufacturing' WHEN '33' THEN 'Manufacturing'
       WHEN '42' THEN 'Wholesale Trade' WHEN '44' THEN 'Retail Trade' WHEN '45' THEN 'Retail Trade'
       WHEN '48' THEN 'Transportation and Warehousing' WHEN '49' THEN 'Transportation and Warehousing'
       WHEN '51' THEN 'Information' WHEN '52' THEN 'Finance and Insurance'
       WHEN '53' THEN 'Real Estate and Rental and Leasing'
       WHEN '54' THEN 'Professional, Scientific, and Technical Services'
       WHEN '55' THEN 'Management of Companies and Enterprises'
       WHEN '56' THEN 'Administrative and Support and Waste Management'
       WHEN '61' THEN 'Educational Services' WHEN '62' THEN 'Health Care and Social Assistance'
       WHEN '71' THEN 'Arts, Entertainment, and Recreation'
       WHEN '72' THEN 'Accommodation and Food Services'
       WHEN '81' THEN 'Other Services (except Public Administration)'
       WHEN '92' THEN 'Public Administration'
       ELSE CASE WHEN {naics} IS NOT NULL THEN 'Unknown Sector' END END"""


# ---- scans and cell functions ----------------------------------------------------------


@query(
    "scan_project",
    """SELECT contract_award_unique_key AS award_key, action_date_fiscal_year AS fiscal_year,
       total_dollars_obligated AS obligated, award_type FROM awards""",
)
def _(awards):
    return awards.select(
        F.col("contract_award_unique_key").alias("award_key"),
        F.col("action_date_fiscal_year").alias("fiscal_year"),
        F.col("total_dollars_obligated").alias("obligated"),
        "award_type",
    )


@query(
    "parse_tf_flags",
    """SELECT woman_owned_business AS flag, minority_owned_business AS other_flag,
       CASE lower(woman_owned_business) WHEN 't' THEN true WHEN 'f' THEN false END AS woman_owned,
       CASE lower(minority_owned_business) WHEN 't' THEN true WHEN 'f' THEN false END AS minority_owned,
       count(*) AS n FROM awards GROUP BY ALL""",
)
def _(awards):
    return (
        awards.select(
            F.col("woman_owned_business").alias("flag"),
            F.col("minority_owned_business").alias("other_flag"),
            parse_tf(F.col("woman_owned_business")).alias("woman_owned"),
            parse_tf(F.col("minority_owned_business")).alias("minority_owned"),
        )
        .groupBy("flag", "other_flag", "woman_owned", "minority_owned")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "bool_vocab",
    """SELECT contract_award_unique_key,
       CASE WHEN woman_owned_business IN ('true', 'TRUE', 'True', 'yes', 'YES', 'Yes', 't', 'T', 'y', 'Y',
              'on', 'ON', 'On') THEN true
            WHEN woman_owned_business IN ('false', 'FALSE', 'False', 'no', 'NO', 'No', 'f', 'F', 'n', 'N',
              'off', 'OFF', 'Off') THEN false
       END AS woman_owned FROM awards""",
)
def _(awards):
    return awards.select(
        "contract_award_unique_key",
        bool_from_words("woman_owned_business", *bool_vocabulary()).alias("woman_owned"),
    )


# A cell text per row: some of the missing-cell spellings, else the recipient's name.
TOKEN_CELL = """CASE awarding_agency_code % 8 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN '#N/A N/A'
 WHEN 3 THEN 'nan' WHEN 4 THEN '-1.#IND' WHEN 5 THEN 'Null' WHEN 6 THEN ' NA' ELSE recipient_name END"""


@query(
    "null_tokens",
    f"""SELECT contract_award_unique_key, CASE WHEN cell NOT IN ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND',
         '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', 'N/A', 'NA', 'NULL', 'NaN', 'n/a', 'nan', 'null')
         THEN cell END AS cell
       FROM (SELECT contract_award_unique_key, {TOKEN_CELL} AS cell FROM awards)""",
)
def _(awards):
    return awards.select(
        "contract_award_unique_key", null_tokens_to_null(f"({TOKEN_CELL})").alias("cell")
    )


# A file name per row, with and without a part number.
FILE_CELL = """concat('FY', cast(action_date_fiscal_year AS string), '_All_',
 CASE WHEN awarding_agency_code % 3 = 0 THEN 'x' ELSE '' END, cast(awarding_agency_code AS string), '.csv.zst')"""


@query(
    "lineage_columns",
    f"""SELECT cast(action_date_fiscal_year AS varchar) AS year,
       CASE WHEN regexp_extract(name, '_(\\d+)\\.csv.zst$', 1) <> '' THEN regexp_extract(name, '_(\\d+)\\.csv.zst$', 1)
            ELSE substr(name, 1, length(name) - 4) END AS file, count(*) AS n
       FROM (SELECT action_date_fiscal_year, {FILE_CELL} AS name FROM awards) GROUP BY 1, 2""",
)
def _(awards):
    return (
        awards.select(
            F.col("action_date_fiscal_year").cast("string").alias("year"),
            file_id(F.expr(FILE_CELL)).alias("file"),
        )
        .groupBy("year", "file")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "union_all_widen",
    """SELECT action_date_fiscal_year AS fiscal_year, total_dollars_obligated AS amount FROM awards
       UNION ALL
       SELECT action_date_fiscal_year, cast(cast(federal_action_obligation AS float) AS double) FROM awards""",
)
def _(awards):
    year = F.col("action_date_fiscal_year").alias("fiscal_year")
    return union_widened(
        [
            awards.select(year, F.col("total_dollars_obligated").alias("amount")),
            awards.select(year, F.col("federal_action_obligation").cast("float").alias("amount")),
        ]
    )


# ---- funding reports -------------------------------------------------------------------


def sql_trends(where: str = "") -> str:
    return f"""WITH y AS (SELECT action_date_fiscal_year, coalesce(sum(total_dollars_obligated), 0) AS o,
         coalesce(sum(total_outlayed_amount_for_overall_award), 0) AS t,
         coalesce(sum(federal_action_obligation), 0) AS f, count(*) AS n
       FROM awards {where} GROUP BY 1),
     l AS (SELECT *, lag(o) OVER (ORDER BY action_date_fiscal_year NULLS FIRST) AS p FROM y)
     SELECT action_date_fiscal_year, round(o, 4) AS total_obligated, round(t, 2) AS total_outlayed,
       round(f, 2) AS federal_obligation, n AS number_of_awards,
       round(o / n, 4) AS average_obligated_per_award, round(p, 4) AS previous_year_obligated,
       round((o - p) / p * 100, 6) AS yoy_change_percent FROM l"""


def sql_in(column: str, values) -> str:
    return f"{column} IN ({', '.join(map(str, values))})"


def round_trends(trends: DataFrame) -> DataFrame:
    return rounded(
        trends,
        total_obligated=4,
        total_outlayed=2,
        federal_obligation=2,
        average_obligated_per_award=4,
        previous_year_obligated=4,
        yoy_change_percent=6,
    )


@query("funding_trends", sql_trends())
def _(awards):
    return round_trends(funding.funding_trends(awards))


@query(
    "funding_trends_gap_years", sql_trends("WHERE " + sql_in("action_date_fiscal_year", GAP_YEARS))
)
def _(awards):
    return round_trends(funding.funding_trends(awards, GAP_YEARS))


def sql_sectors(top_n: int, where: str = "") -> str:
    return f"""WITH g AS (SELECT action_date_fiscal_year, {sql_sector('naics_code')} AS sector_name, naics_code,
         naics_description, coalesce(sum(total_dollars_obligated), 0) AS t, count(*) AS n
       FROM awards {where} GROUP BY 1, 2, 3, 4),
     r AS (SELECT *, t / sum(t) OVER (PARTITION BY action_date_fiscal_year) AS s,
         row_number() OVER (PARTITION BY action_date_fiscal_year ORDER BY t DESC, sector_name NULLS FIRST,
           naics_code NULLS FIRST, naics_description NULLS FIRST) AS k FROM g)
     SELECT action_date_fiscal_year, sector_name, naics_code, naics_description,
       round(t, 4) AS total_funding, n AS number_of_awards,
       round(t / n, 9) AS average_funding_per_award, round(s, 10) AS funding_share
     FROM r WHERE k <= {top_n}"""


def round_sectors(sectors: DataFrame) -> DataFrame:
    return rounded(sectors, total_funding=4, average_funding_per_award=9, funding_share=10)


@query("sector_funding_top5", sql_sectors(5))
def _(awards):
    return round_sectors(funding.sector_funding(awards))


SECTOR_FILTER = (
    "WHERE " + sql_in("action_date_fiscal_year", FILTER_YEARS)
    + f" AND {sql_sector('naics_code')} IN ({text_list(FILTER_SECTORS)})"
)


@query("sector_funding_filtered", sql_sectors(len(FILTER_SECTORS), SECTOR_FILTER))
def _(awards):
    return round_sectors(
        funding.sector_funding(awards, len(FILTER_SECTORS), FILTER_YEARS, FILTER_SECTORS)
    )


def sql_types(where: str = "") -> str:
    return f"""WITH g AS (SELECT action_date_fiscal_year, award_type, count(*) AS n,
         coalesce(sum(total_dollars_obligated), 0) AS t FROM awards {where} GROUP BY 1, 2)
     SELECT action_date_fiscal_year, award_type, n AS award_count, round(t, 4) AS total_funding,
       round(n / sum(n) OVER (PARTITION BY action_date_fiscal_year), 10) AS count_share,
       round(t / sum(t) OVER (PARTITION BY action_date_fiscal_year), 10) AS funding_share FROM g"""


def round_types(types: DataFrame) -> DataFrame:
    return rounded(types, total_funding=4, count_share=10, funding_share=10)


@query("award_types", sql_types())
def _(awards):
    return round_types(funding.award_types(awards))


@query(
    "award_types_filtered", sql_types("WHERE " + sql_in("action_date_fiscal_year", FILTER_YEARS))
)
def _(awards):
    return round_types(funding.award_types(awards, FILTER_YEARS))


@query(
    "funding_rollup",
    """SELECT action_date_fiscal_year, naics_code, naics_description, award_type,
       round(coalesce(sum(total_dollars_obligated), 0), 4) AS total_dollars_obligated,
       round(coalesce(sum(total_outlayed_amount_for_overall_award), 0), 6) AS total_outlayed_amount_for_overall_award,
       round(coalesce(sum(federal_action_obligation), 0), 2) AS federal_action_obligation,
       count(*) AS transactions FROM awards GROUP BY 1, 2, 3, 4""",
)
def _(awards):
    return rounded(
        funding.funding_rollup(awards),
        total_dollars_obligated=4,
        total_outlayed_amount_for_overall_award=6,
        federal_action_obligation=2,
    )


@query("funding_trends_from_rollup", sql_trends())
def _(awards):
    return round_trends(funding.funding_trends(funding.funding_rollup(awards)))


# ---- filter options --------------------------------------------------------------------


@query("year_options", "SELECT DISTINCT action_date_fiscal_year FROM awards")
def _(awards):
    return options.year_options(awards)


@query(
    "sector_lookup",
    f"SELECT DISTINCT naics_code, {sql_sector('naics_code')} AS sector_name FROM awards",
)
def _(awards):
    return options.sector_lookup(awards)


@query(
    "sector_options",
    f"""SELECT DISTINCT {sql_sector('naics_code')} AS sector_name FROM awards
       WHERE naics_code IS NOT NULL""",
)
def _(awards):
    return options.sector_options(awards)


@query(
    "default_sectors",
    f"""WITH c AS (SELECT DISTINCT naics_code FROM awards WHERE naics_code IS NOT NULL
         ORDER BY naics_code LIMIT 5)
     SELECT naics_code, {sql_sector('naics_code')} AS sector_name FROM c""",
)
def _(awards):
    return options.default_sectors(awards)


# ---- outlay check ----------------------------------------------------------------------

SQL_OUTLAYS = f"""WITH o AS (SELECT try_cast(period_of_performance_current_end_date AS date) AS end_date,
   total_outlayed_amount_for_overall_award AS outlay_amount, current_total_value_of_award AS current_award_value,
   potential_total_value_of_award AS potential_award_value, total_dollars_obligated AS obligated_amount FROM awards),
 f AS (SELECT * FROM o WHERE year(end_date) = {END_YEAR} AND outlay_amount > {MIN_OUTLAY})"""


def sql_amount(column: str) -> str:
    return f"coalesce(cast(cast({column} AS decimal(38,6)) AS varchar), '~')"


def sql_text(column: str) -> str:
    return f"coalesce(cast({column} AS varchar), '~')"


SQL_OUTLAY_SAMPLE = f"""{SQL_OUTLAYS},
 d AS (SELECT *, md5(concat_ws('|', '69', {sql_text('end_date')},
     {', '.join(map(sql_amount, outlays.AMOUNTS))})) AS draw FROM f),
 r AS (SELECT *, row_number() OVER (ORDER BY draw, {', '.join(outlays.AMOUNTS)}) AS k,
     count(*) OVER () AS n FROM d),
 s AS (SELECT end_date, {', '.join(outlays.AMOUNTS)} FROM r
   WHERE k <= floor(cast({SAMPLE} AS double) * n))"""


def sql_summary(result: str) -> str:
    o, c, p, b = (f"coalesce({name}, 0)" for name in outlays.AMOUNTS)
    totals = {
        "total_outlay": ("outlay_amount", 2),
        "total_current_value": ("current_award_value", 4),
        "total_potential_value": ("potential_award_value", 2),
        "total_obligated": ("obligated_amount", 4),
    }
    sums = ", ".join(
        f"round(coalesce(sum({column}), 0), {digits}) AS {name}"
        for name, (column, digits) in totals.items()
    )
    kinds = {"less_than": "<", "equal": "=", "greater_than": ">"}
    counts = ", ".join(
        f"count(*) FILTER (WHERE {left} {sign} {p}) AS {prefix}_{kind}"
        for prefix, left in (("outlay", o), ("obligated", b))
        for kind, sign in kinds.items()
    )
    return f"""SELECT (SELECT count(*) FROM o) AS total_rows, (SELECT count(*) FROM f) AS filtered_rows,
      count(*) AS result_rows, {sums},
      count(*) FILTER (WHERE {o} < {p}) AS less_than_potential_count,
      count(*) FILTER (WHERE {o} > {c}) AS exceeds_current_count, {counts},
      round((SELECT count(*) FROM f) / (SELECT count(*) FROM o) * 100, 8) AS filtered_percent,
      round(count(*) FILTER (WHERE {o} > {c}) / count(*) * 100, 8) AS exceeds_current_percent
    FROM {result}"""


def round_report(report: DataFrame) -> DataFrame:
    return rounded(
        report,
        total_outlay=2,
        total_current_value=4,
        total_potential_value=2,
        total_obligated=4,
        filtered_percent=8,
        exceeds_current_percent=8,
    )


@query("outlay_filter", f"{SQL_OUTLAYS} SELECT * FROM f")
def _(awards):
    return outlays.filter_awards(outlays.outlay_rows(awards), END_YEAR, MIN_OUTLAY)


@query("outlay_summary", f"{SQL_OUTLAYS} {sql_summary('f')}")
def _(awards):
    return round_report(outlays.outlay_report(outlays.outlay_rows(awards), END_YEAR, MIN_OUTLAY))


def sql_breakdown(amount: str) -> str:
    return f"""{SQL_OUTLAYS},
     c AS (SELECT CASE WHEN a < p THEN 'less_than' WHEN a = p THEN 'equal' ELSE 'greater_than' END AS comparison
       FROM (SELECT coalesce({amount}, 0) AS a, coalesce(potential_award_value, 0) AS p FROM f))
     SELECT comparison, count(*) AS len, round(count(*) / (SELECT count(*) FROM c) * 100, 8) AS percentage
     FROM c GROUP BY 1"""


def _report_of(awards: DataFrame) -> DataFrame:
    return outlays.outlay_report(outlays.outlay_rows(awards), END_YEAR, MIN_OUTLAY)


@query("outlay_vs_potential", sql_breakdown("outlay_amount"))
def _(awards):
    return rounded(outlays.outlay_vs_potential(_report_of(awards)), percentage=8)


@query("obligated_vs_potential", sql_breakdown("obligated_amount"))
def _(awards):
    return rounded(outlays.obligated_vs_potential(_report_of(awards)), percentage=8)


@query("outlay_sample_exact", f"{SQL_OUTLAY_SAMPLE} SELECT * FROM s")
def _(awards):
    filtered = outlays.filter_awards(outlays.outlay_rows(awards), END_YEAR, MIN_OUTLAY)
    return outlays.sample_awards(filtered, SAMPLE)


@query("outlay_sample_summary", f"{SQL_OUTLAY_SAMPLE} {sql_summary('s')}")
def _(awards):
    return round_report(
        outlays.outlay_report(outlays.outlay_rows(awards), END_YEAR, MIN_OUTLAY, SAMPLE)
    )


# ---- test subset -----------------------------------------------------------------------

INITIAL = ", ".join(subset.INITIAL_COLUMNS)
SQL_CLEAN = """WITH c AS (SELECT contract_award_unique_key, current_total_value_of_award,
   coalesce(award_type, 'unknown') AS award_type, recipient_name, naics_code, awarding_agency_code,
   national_interest_action_code,
   CASE lower(minority_owned_business) WHEN 't' THEN true WHEN 'f' THEN false END AS minority_owned_business,
   CASE lower(woman_owned_business) WHEN 't' THEN true WHEN 'f' THEN false END AS woman_owned_business,
   action_date_fiscal_year, total_dollars_obligated, total_outlayed_amount_for_overall_award,
   federal_action_obligation, potential_total_value_of_award, naics_description,
   period_of_performance_current_end_date FROM awards),
 v AS (SELECT current_total_value_of_award AS v, row_number() OVER (ORDER BY current_total_value_of_award) - 1 AS i,
     count(*) OVER () AS n FROM c WHERE current_total_value_of_award IS NOT NULL),
 q AS (SELECT min(v) FILTER (WHERE i = floor((n - 1) * cast(0.05 AS double) + 0.5)) AS low,
     min(v) FILTER (WHERE i = floor((n - 1) * cast(0.95 AS double) + 0.5)) AS high FROM v)"""
DRAW = "md5(concat_ws('|', '69', " + ", ".join(
    sql_amount(name) if name == subset.VALUE else sql_text(name) for name in subset.INITIAL_COLUMNS
) + "))"
SQL_SAMPLE = f"""{SQL_CLEAN},
 d AS (SELECT {INITIAL}, {DRAW} AS draw FROM c),
 r AS (SELECT *, row_number() OVER (PARTITION BY award_type ORDER BY draw, {INITIAL}) AS k,
     count(*) OVER (PARTITION BY award_type) AS n FROM d),
 s AS (SELECT {INITIAL} FROM r WHERE k <= floor(cast(0.2 AS double) * n))"""
SQL_SUBSET = f"""{SQL_SAMPLE},
 e AS (SELECT DISTINCT {INITIAL} FROM c WHERE current_total_value_of_award > (SELECT high FROM q)
     OR current_total_value_of_award < (SELECT low FROM q)),
 u AS (SELECT * FROM s UNION SELECT * FROM e)"""


def _thresholds_frame(awards: DataFrame, method: str) -> DataFrame:
    values = staged(awards.select(subset.VALUE), "values")
    low, high = subset.value_thresholds(values, method=method)
    return awards.sparkSession.createDataFrame([(low, high)], "low double, high double")


@query("value_quantiles", f"{SQL_CLEAN} SELECT low, high FROM q")
def _(awards):
    return _thresholds_frame(awards, "nearest")


@query(
    "value_quantiles_disc",
    """SELECT percentile_disc(0.05) WITHIN GROUP (ORDER BY current_total_value_of_award) AS low,
       percentile_disc(0.95) WITHIN GROUP (ORDER BY current_total_value_of_award) AS high FROM awards""",
)
def _(awards):
    return _thresholds_frame(awards, "disc")


@query(
    "edge_cases",
    f"{SQL_SUBSET} SELECT * FROM e",
)
def _(awards):
    clean = staged(subset.clean_awards(awards.select(*subset.INITIAL_COLUMNS)), "clean")
    return subset.edge_cases(clean, *subset.value_thresholds(clean))


@query("stratified_sample", f"{SQL_SAMPLE} SELECT * FROM s")
def _(awards):
    return subset.stratified_sample(subset.clean_awards(awards))


@query("subset_union_distinct", f"{SQL_SUBSET} SELECT * FROM u")
def _(awards):
    return subset.subset_rows(awards)


REST = [
    "action_date_fiscal_year",
    "total_dollars_obligated",
    "total_outlayed_amount_for_overall_award",
    "federal_action_obligation",
    "potential_total_value_of_award",
    "naics_description",
    "period_of_performance_current_end_date",
]


@query(
    "subset_own_columns",
    f"""{SQL_SUBSET} SELECT c.* FROM c JOIN u ON
       {' AND '.join(f'c.{name} IS NOT DISTINCT FROM u.{name}' for name in subset.INITIAL_COLUMNS)}""",
)
def _(awards):
    return subset.build_subset(awards)


@query(
    "subset_semi_join",
    f"""{SQL_SUBSET} SELECT contract_award_unique_key, {', '.join(REST)} FROM c
       WHERE contract_award_unique_key IN (SELECT contract_award_unique_key FROM u)""",
)
def _(awards):
    rest = awards.select(subset.KEY, *REST)
    return restrict_to_keys(rest, subset.subset_rows(awards), subset.KEY)


@query(
    "subset_left_join",
    f"""{SQL_SUBSET} SELECT u.*, {', '.join(f'c.{name}' for name in REST)}
       FROM u LEFT JOIN c ON u.contract_award_unique_key = c.contract_award_unique_key""",
)
def _(awards):
    return attach_by_key(subset.subset_rows(awards), awards.select(subset.KEY, *REST), subset.KEY)


# ---- chart series ----------------------------------------------------------------------


def sql_series(report: str, parts: list[tuple[str, str, str]], where: str = "") -> str:
    """UNION ALL of (panel, series expression, value expression) over a report."""
    selects = " UNION ALL ".join(
        f"""SELECT '{panel}' AS panel, {label} AS series, action_date_fiscal_year,
        cast({value} AS double) AS value FROM rep {where}"""
        for panel, label, value in parts
    )
    head, tail = report.rsplit("\n     SELECT", 1)
    return f"{head}, rep AS (SELECT {tail}) {selects}"


@query(
    "funding_series",
    sql_series(
        sql_trends(),
        [(panel, f"'{label}'", name) for name, (panel, label) in series.FUNDING_PANELS.items()],
    ),
)
def _(awards):
    return series.funding_series(round_trends(funding.funding_trends(awards)))


@query(
    "dollar_series",
    sql_series(
        sql_trends(),
        [
            ("", "'Total Obligated'", "total_obligated"),
            ("", "'Total Outlayed'", "total_outlayed"),
            ("", "'Federal Obligation'", "federal_obligation"),
        ],
    ).replace("SELECT '' AS panel,", "SELECT"),
)
def _(awards):
    return series.dollar_series(round_trends(funding.funding_trends(awards)))


def sql_stacked(report: str, column: str, panels: dict[str, tuple[str, int]]) -> str:
    head, tail = report.rsplit("\n     SELECT", 1)
    sums = ", ".join(f"sum({name}) AS {name}" for name in panels)
    selects = " UNION ALL ".join(
        f"""SELECT '{panel}' AS panel, {column} AS series, action_date_fiscal_year,
        round(cast({name} AS double), {digits}) AS value FROM stacked"""
        for name, (panel, digits) in panels.items()
    )
    return f"""{head}, rep AS (SELECT {tail}), stacked AS (SELECT {column}, action_date_fiscal_year, {sums}
       FROM rep WHERE {column} IS NOT NULL GROUP BY 1, 2) {selects}"""


@query(
    "sector_series",
    sql_stacked(
        sql_sectors(5),
        "sector_name",
        {k: (v, 9 if k.startswith("average") else 4) for k, v in series.SECTOR_PANELS.items()},
    ),
)
def _(awards):
    stacked = series.sector_series(round_sectors(funding.sector_funding(awards)))
    averages = F.col("panel").startswith("Average")
    return stacked.withColumn(
        "value", F.when(averages, F.round("value", 9)).otherwise(F.round("value", 4))
    )


@query(
    "award_type_series",
    sql_stacked(
        sql_types(), "award_type", {k: (v, 4) for k, v in series.AWARD_TYPE_PANELS.items()}
    ),
)
def _(awards):
    return rounded(series.award_type_series(round_types(funding.award_types(awards))), value=4)


# ---- files: drops, ingest, plain CSV ---------------------------------------------------

# How the contract rows are spelled in a drop. Some rows get a cell too many or too few
# and must be left out; others get quotes, commas, null tokens and flag spellings.
LONG_ROW = "cast(contract_award_unique_key AS bigint) % 97 = 1"
SHORT_ROW = "cast(contract_award_unique_key AS bigint) % 89 = 1"
QUOTED_ROW = "cast(contract_award_unique_key AS bigint) % 7 = 1"
BLANK_AFTER = "cast(contract_award_unique_key AS bigint) % 101 = 1"
KEYS_PER_FILE = 10_000

DROP_CELLS = {
    "contract_award_unique_key": "contract_award_unique_key",
    "action_date_fiscal_year": "cast(action_date_fiscal_year AS string)",
    "total_dollars_obligated": "coalesce(cast(total_dollars_obligated AS string), 'NaN')",
    "total_outlayed_amount_for_overall_award": "cast(total_outlayed_amount_for_overall_award AS string)",
    "federal_action_obligation": "cast(federal_action_obligation AS string)",
    "current_total_value_of_award": "coalesce(cast(current_total_value_of_award AS string), '#N/A')",
    "potential_total_value_of_award": "cast(potential_total_value_of_award AS string)",
    "naics_code": "coalesce(cast(naics_code AS string), 'NULL')",
    "naics_description": f"""CASE WHEN {QUOTED_ROW} THEN concat('"as said, ""', naics_description, '""', '"')
        ELSE naics_description END""",
    "award_type": "coalesce(award_type, 'n/a')",
    "recipient_name": "recipient_name",
    "woman_owned_business": """CASE woman_owned_business WHEN 't' THEN 'Yes' WHEN 'F' THEN 'OFF' ELSE 'null' END""",
    "period_of_performance_current_end_date": "period_of_performance_current_end_date",
}
DROP_SCHEMA = """{"fields": [
 {"name": "contract_award_unique_key", "type": "string"},
 {"name": "action_date_fiscal_year", "type": "int64"},
 {"name": "total_dollars_obligated", "type": "double"},
 {"name": "total_outlayed_amount_for_overall_award", "type": "double"},
 {"name": "federal_action_obligation", "type": "double"},
 {"name": "current_total_value_of_award", "type": "double"},
 {"name": "potential_total_value_of_award", "type": "double"},
 {"name": "naics_code", "type": "uint32"},
 {"name": "naics_description", "type": "string"},
 {"name": "award_type", "type": {"type": "dictionary", "valueType": "string"}},
 {"name": "recipient_name", "type": "string"},
 {"name": "woman_owned_business", "type": "bool"},
 {"name": "period_of_performance_current_end_date", "type": "date32[day]"}]}"""


def write_drops(
    spark: SparkSession, sf_dir: str, frame_bytes: int | None = None
) -> tuple[str, list[str]]:
    """The contract rows as drops in the shared scratch folder: (root, years)."""
    root = scratch_dir(spark, "drops")
    cells = ", ".join(f"coalesce({cell}, '')" for cell in DROP_CELLS.values())
    lines = fixtures.awards(spark, sf_dir).select(
        F.col("action_date_fiscal_year").cast("string").alias("year"),
        F.expr(
            f"lpad(cast(cast(contract_award_unique_key AS bigint) DIV {KEYS_PER_FILE} AS string), 6, '0')"
        ).alias("file"),
        F.expr(
            f"""concat(CASE WHEN {SHORT_ROW} THEN 'short,row' ELSE concat_ws(',', {cells}) END,
            CASE WHEN {LONG_ROW} THEN ',extra' ELSE '' END,
            CASE WHEN {BLANK_AFTER} THEN '\\n' ELSE '' END)"""
        ).alias("line"),
    )
    return root, fixtures.write_drop_files(lines, ",".join(DROP_CELLS), root, frame_bytes)


SQL_DROP_ROWS = f"""WITH k AS (SELECT *, cast(action_date_fiscal_year AS varchar) AS year,
   lpad(cast(cast(contract_award_unique_key AS bigint) // {KEYS_PER_FILE} AS varchar), 6, '0') AS file,
   CASE WHEN {QUOTED_ROW} THEN 'as said, "' || naics_description || '"' ELSE naics_description END AS described
   FROM awards WHERE NOT ({LONG_ROW}) AND NOT ({SHORT_ROW}))"""


def ingest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, years = write_drops(spark, sf_dir)
    output = scratch_dir(spark, "awards")
    ingest(spark, years, output, schema_from_text(DROP_SCHEMA), root=root, on_bad_value="null")
    return rounded(
        read_awards(spark, output)
        .groupBy("year", "file")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.sum("total_dollars_obligated").alias("obligated"),
            F.sum("total_outlayed_amount_for_overall_award").alias("outlayed"),
            F.sum("naics_code").cast("long").alias("code_sum"),
            F.count_if("woman_owned_business").alias("women_owned"),
            F.count("woman_owned_business").alias("flagged"),
            F.count("award_type").alias("typed"),
            F.count("current_total_value_of_award").alias("valued"),
            F.max("naics_description").alias("last_description"),
            F.min("period_of_performance_current_end_date").alias("first_end"),
            F.count("period_of_performance_current_end_date").alias("dated"),
        ),
        obligated=4,
        outlayed=2,
    )


QUERIES["ingest_roundtrip"] = ingest_roundtrip
ORACLES["ingest_roundtrip"] = with_awards(
    f"""{SQL_DROP_ROWS} SELECT year, file, count(*) AS row_count,
     round(sum(total_dollars_obligated), 4) AS obligated,
     round(sum(total_outlayed_amount_for_overall_award), 2) AS outlayed,
     cast(sum(naics_code) AS bigint) AS code_sum,
     count(*) FILTER (WHERE woman_owned_business = 't') AS women_owned,
     count(*) FILTER (WHERE woman_owned_business IN ('t', 'F')) AS flagged,
     count(award_type) AS typed, count(current_total_value_of_award) AS valued,
     max(described) AS last_description,
     min(try_cast(period_of_performance_current_end_date AS date)) AS first_end,
     count(try_cast(period_of_performance_current_end_date AS date)) AS dated
   FROM k GROUP BY 1, 2"""
)


def drop_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, years = write_drops(spark, sf_dir)
    return rows_per_file(read_drops(spark, year_directories(years, root=root)).rows)


QUERIES["drop_row_counts"] = drop_row_counts
ORACLES["drop_row_counts"] = with_awards(
    f"{SQL_DROP_ROWS} SELECT year, file, count(*) AS rows FROM k GROUP BY 1, 2"
)


def outlay_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, years = write_drops(spark, sf_dir)
    _, awards = read_outlay_drops(spark, year_directories(years, root=root))
    return round_report(outlays.outlay_report(awards, END_YEAR, MIN_OUTLAY))


QUERIES["outlay_drops"] = outlay_drops
ORACLES["outlay_drops"] = with_awards(
    SQL_DROP_ROWS + ", o AS (" + SQL_OUTLAYS.split("o AS (", 1)[1].replace("FROM awards", "FROM k")
    + " " + sql_summary("f")
)


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "csv")
    zip_code = F.lpad(F.col("awarding_agency_code").cast("string"), 9, "0")
    write_csv(
        fixtures.awards(spark, sf_dir).withColumn("recipient_zip_4_code", zip_code), path
    )
    assert csv_columns(spark, path)[-1] == "recipient_zip_4_code"
    rows = read_plain_csv(spark, path)
    return rounded(
        rows.groupBy("award_type", "recipient_zip_4_code").agg(
            F.count(F.lit(1)).alias("row_count"),
            F.sum("current_total_value_of_award").alias("total_value"),
            F.sum("naics_code").alias("code_sum"),
            F.max("period_of_performance_current_end_date").alias("last_end"),
        ),
        total_value=4,
    )


QUERIES["csv_roundtrip"] = csv_roundtrip
ORACLES["csv_roundtrip"] = with_awards(
    """SELECT award_type, lpad(cast(awarding_agency_code AS varchar), 9, '0') AS recipient_zip_4_code,
     count(*) AS row_count, round(sum(current_total_value_of_award), 4) AS total_value,
     cast(sum(naics_code) AS bigint) AS code_sum,
     max(period_of_performance_current_end_date) AS last_end
   FROM awards GROUP BY 1, 2"""
)


# ---- SUBSET as a job, awards with totals -------------------------------------------------


def subset_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = scratch_dir(spark, "transactions-csv"), scratch_dir(spark, "subset-csv")
    # The transactions lie on disk for the whole job: as text they would take the most of it.
    write_csv(fixtures.awards(spark, sf_dir), source, compression="gzip")
    subset.subset_job(spark, source, target)
    rows = read_plain_csv(spark, target)
    return rounded(
        rows.groupBy("award_type").agg(
            F.count(F.lit(1)).alias("row_count"),
            F.countDistinct("contract_award_unique_key").alias("award_count"),
            F.sum("current_total_value_of_award").alias("total_value"),
            F.sum("naics_code").alias("code_sum"),
            F.count_if(F.col("woman_owned_business")).alias("women_owned"),
            F.max("period_of_performance_current_end_date").alias("last_end"),
        ),
        total_value=4,
    )


QUERIES["subset_from_csv"] = subset_from_csv
ORACLES["subset_from_csv"] = with_awards(
    f"""{SQL_SUBSET} SELECT c.award_type, count(*) AS row_count,
     count(DISTINCT c.contract_award_unique_key) AS award_count,
     round(sum(c.current_total_value_of_award), 4) AS total_value,
     cast(sum(c.naics_code) AS bigint) AS code_sum,
     count(*) FILTER (WHERE c.woman_owned_business) AS women_owned,
     max(c.period_of_performance_current_end_date) AS last_end
   FROM c JOIN u ON {' AND '.join(f'c.{name} IS NOT DISTINCT FROM u.{name}' for name in subset.INITIAL_COLUMNS)}
   GROUP BY 1"""
)


@query(
    "award_totals_left_join",
    f"""{SQL_SUBSET}, t AS (SELECT contract_award_unique_key, count(*) AS transactions,
         round(sum(total_dollars_obligated), 4) AS award_obligated,
         min(action_date_fiscal_year) AS first_year, max(action_date_fiscal_year) AS last_year
       FROM awards GROUP BY 1)
       SELECT u.*, t.transactions, t.award_obligated, t.first_year, t.last_year
       FROM u LEFT JOIN t ON u.contract_award_unique_key = t.contract_award_unique_key""",
)
def _(awards):
    return rounded(subset.subset_with_totals(awards), award_obligated=4)


@query("value_quantiles_narrowed", f"{SQL_CLEAN} SELECT low, high FROM q")
def _(awards):
    values = staged(awards.select(subset.VALUE), "values")
    tails = [subset.LOW_TAIL, subset.HIGH_TAIL]
    low, high = quantiles(values, subset.VALUE, tails, pick_limit=500, accuracy=100)
    return awards.sparkSession.createDataFrame([(low, high)], "low double, high double")


@query(
    "outlay_labels",
    f"""WITH b AS ({with_awards(sql_breakdown("outlay_amount"))})
       SELECT *, CASE comparison WHEN 'less_than' THEN 'Outlays < Potential'
         WHEN 'equal' THEN 'Outlays = Potential' ELSE 'Outlays > Potential' END AS label FROM b""",
)
def _(awards):
    breakdown = rounded(outlays.outlay_vs_potential(_report_of(awards)), percentage=8)
    return outlays.labelled(breakdown, "Outlays")


# ---- vocabulary of a dictionary, typed cells ---------------------------------------------

LABELS_JSON = """{"size": {"T": "Small Business", "F": "other than small"},
 "kind": {"A": "one", "B": "two"}, "set": {"Y": " Set Aside ", "N": "open"}}"""
LABEL_CELL = """CASE awarding_agency_code % 8 WHEN 0 THEN 'Small business' WHEN 1 THEN 'SMALL BUSINESS'
 WHEN 2 THEN 'Small Business' WHEN 3 THEN 'Other than small' WHEN 4 THEN 'set aside' WHEN 5 THEN 'OPEN'
 WHEN 6 THEN 'one' ELSE 'Yes' END"""


@query(
    "dictionary_labels",
    f"""SELECT contract_award_unique_key, CASE
         WHEN cell IN ('Small business', 'SMALL BUSINESS', 'small business', 'set aside', 'Set aside', 'SET ASIDE',
           'Yes') THEN true
         WHEN cell IN ('Other than small', 'OTHER THAN SMALL', 'other than small', 'open', 'Open', 'OPEN')
           THEN false END AS flag
       FROM (SELECT contract_award_unique_key, {LABEL_CELL} AS cell FROM awards)""",
)
def _(awards):
    words = bool_vocabulary(json.loads(LABELS_JSON))
    cells = awards.select("contract_award_unique_key", F.expr(LABEL_CELL).alias("cell"))
    return cells.select("contract_award_unique_key", bool_from_words("cell", *words).alias("flag"))


CELL_TEXTS = [" 12 ", "+7", "12d", "0x10", "1e5", "0x1p3", "Infinity", "2020", "2020-01-02", "2020-01-02 03:04:05Z"]
CELL_OF_ROW = (
    "element_at(array(" + ", ".join(f"'{text}'" for text in CELL_TEXTS) + "), cast(awarding_agency_code % 10 + 1 AS int))"
)


@query(
    "typed_cells",
    """SELECT contract_award_unique_key, t.whole, t.number, t.moment FROM awards JOIN (VALUES
         (0, 12, cast(12 AS double), NULL), (1, NULL, NULL, NULL), (2, NULL, NULL, NULL), (3, 16, NULL, NULL),
         (4, NULL, cast(100000 AS double), NULL), (5, NULL, NULL, NULL), (6, NULL, cast('inf' AS double), NULL),
         (7, 2020, cast(2020 AS double), NULL), (8, NULL, NULL, TIMESTAMP '2020-01-02 00:00:00'),
         (9, NULL, NULL, NULL)) t(k, whole, number, moment) ON t.k = awarding_agency_code % 10""",
)
def _(awards):
    cell = F.expr(CELL_OF_ROW)
    kinds = {"whole": "int32", "number": "double", "moment": "timestamp[us]"}
    fields = ", ".join(f'{{"name": "{name}", "type": "{kind}"}}' for name, kind in kinds.items())
    text = awards.select("contract_award_unique_key", *(cell.alias(name) for name in kinds))
    schema = schema_from_text('{"fields": [' + fields + "]}")
    return type_cells(text, schema, bool_vocabulary(), "null")


# ---- INGEST: isolation, refusals, reports over the dataset --------------------------------


def ingest_bad_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each year also has a cut-off file and one with a bad cell, under the id of a clean one."""
    root, years = write_drops(spark, sf_dir)
    fixtures.add_bad_files(spark, root, years, list(DROP_CELLS), "naics_code", "0" * 6)
    output = scratch_dir(spark, "awards")
    # All other columns as text: their spellings of nothing are no bad cells.
    report = ingest(spark, years, output, schema_from_text(LENIENT_SCHEMA), root=root)
    found = report.groupBy("year").agg(
        F.count_if(F.col("error") == "has a bad value").alias("spoiled"),
        F.count_if((F.col("error") != "has a bad value")).alias("broken"),
    )
    rows = read_awards(spark, output, ["year", "file", "naics_code"]).groupBy("year").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.countDistinct("file").alias("file_count"),
        F.sum("naics_code").cast("long").alias("code_sum"),
    )
    return rows.join(found, "year")


LENIENT_SCHEMA = """{"fields": [""" + ", ".join(
    f'{{"name": "{name}", "type": "{"uint32" if name == "naics_code" else "string"}"}}'
    for name in DROP_CELLS
) + "]}"
QUERIES["ingest_bad_files"] = ingest_bad_files
ORACLES["ingest_bad_files"] = with_awards(
    f"""{SQL_DROP_ROWS}, y AS (SELECT year, count(*) AS row_count, count(DISTINCT file) AS file_count,
       cast(sum(naics_code) AS bigint) AS code_sum FROM k GROUP BY 1)
     SELECT *, 1 AS spoiled, 1 AS broken FROM y"""
)


def _ingested(spark: SparkSession, sf_dir: str) -> str:
    root, years = write_drops(spark, sf_dir)
    output = scratch_dir(spark, "awards")
    ingest(spark, years, output, schema_from_text(DROP_SCHEMA), root=root, on_bad_value="null")
    return output


def _from_dataset(report: Callable[[DataFrame], DataFrame]) -> Query:
    """A report over the ingested dataset: seven columns of it, by its stored schema."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(read_awards(spark, _ingested(spark, sf_dir), funding.REPORT_COLUMNS))

    return build


def _over_drops(sql: str) -> str:
    """A report's SQL over the rows that the drops hold."""
    body = sql.strip()[len("WITH ") :].replace("FROM awards", "FROM dropped")
    # ``k`` also names a rank in some reports.
    return with_awards(f"{SQL_DROP_ROWS}, dropped AS (SELECT * REPLACE (described AS naics_description) FROM k), {body}")


QUERIES["trends_from_dataset"] = _from_dataset(lambda rows: round_trends(funding.funding_trends(rows)))
ORACLES["trends_from_dataset"] = _over_drops(sql_trends())
QUERIES["sectors_from_dataset"] = _from_dataset(lambda rows: round_sectors(funding.sector_funding(rows)))
ORACLES["sectors_from_dataset"] = _over_drops(sql_sectors(5))
QUERIES["award_types_from_dataset"] = _from_dataset(lambda rows: round_types(funding.award_types(rows)))
ORACLES["award_types_from_dataset"] = _over_drops(sql_types())


def write_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the writer refuses: rows without lineage, and an output that is there already."""
    rows = fixtures.awards(spark, sf_dir).select(
        "contract_award_unique_key", F.col("action_date_fiscal_year").cast("string").alias("year")
    )
    output, refused = scratch_dir(spark, "awards"), []
    try:
        write_awards(rows, output)
    except ValueError:
        refused.append("no lineage")
    whole = rows.withColumn("file", F.right("contract_award_unique_key", F.lit(1)))
    write_awards(whole, output, overwrite=False)
    try:
        write_awards(whole, output, overwrite=False)
    except AnalysisException:
        refused.append("exists")
    written = read_awards(spark, output)
    return written.groupBy("year", "file").agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "refused", F.lit(", ".join(refused))
    )


QUERIES["write_refusals"] = write_refusals
ORACLES["write_refusals"] = with_awards(
    """SELECT cast(action_date_fiscal_year AS varchar) AS year, right(contract_award_unique_key, 1) AS file,
     count(*) AS row_count, 'no lineage, exists' AS refused FROM awards GROUP BY 1, 2"""
)


# ---- frames, ledger, manifest --------------------------------------------------------------


def drops_by_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of many frames, cut inside lines, unpacked in runs of frames by several tasks."""
    root, years = write_drops(spark, sf_dir, frame_bytes=20_000)
    drop = read_drops(spark, year_directories(years, root=root), range_bytes=10_000)
    found = drop.rows.groupBy("year", "file").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("contract_award_unique_key").alias("awards"),
        F.min("naics_description").alias("first_description"),
        F.max("naics_description").alias("last_description"),
        F.sum(F.col("potential_total_value_of_award").try_cast("double")).alias("potential"),
    )
    read = drop.files.select("year", file_id(F.substring_index("path", "/", -1)).alias("file"), "rows_read")
    return rounded(found.join(read, ["year", "file"]), potential=2)


SQL_READ_ROWS = f"""a AS (SELECT cast(action_date_fiscal_year AS varchar) AS year,
   lpad(cast(cast(contract_award_unique_key AS bigint) // {KEYS_PER_FILE} AS varchar), 6, '0') AS file,
   count(*) AS rows_read FROM awards GROUP BY 1, 2)"""
QUERIES["drops_by_frames"] = drops_by_frames
ORACLES["drops_by_frames"] = with_awards(
    f"""{SQL_DROP_ROWS}, {SQL_READ_ROWS}, r AS (SELECT year, file, count(*) AS rows,
      count(DISTINCT contract_award_unique_key) AS awards, min(described) AS first_description,
      max(described) AS last_description, round(sum(potential_total_value_of_award), 2) AS potential
      FROM k GROUP BY 1, 2)
     SELECT * FROM r JOIN a USING (year, file)"""
)


def ingest_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read, kept and skipped of each file, the ones with a wrong number of cells planted."""
    root, years = write_drops(spark, sf_dir)
    fixtures.add_bad_files(spark, root, years, list(DROP_CELLS), "naics_code", "bad")
    report = ingest(
        spark, years, scratch_dir(spark, "awards"), schema_from_text(LENIENT_SCHEMA), root=root
    )
    name = file_id(F.substring_index("path", "/", -1))
    broken = F.col("error").isNotNull() & (F.col("error") != "has a bad value")
    return report.select(
        "year",
        F.when(F.col("path").endswith("cell_bad.csv.zst"), "cell").when(broken, "cut").otherwise(name).alias("file"),
        "rows_read",
        "rows_kept",
        "rows_skipped",
    )


QUERIES["ingest_ledger"] = ingest_ledger
ORACLES["ingest_ledger"] = with_awards(
    f"""{SQL_DROP_ROWS}, {SQL_READ_ROWS}, r AS (SELECT year, file, count(*) AS kept FROM k GROUP BY 1, 2)
     SELECT year, file, rows_read, coalesce(kept, 0) AS rows_kept, rows_read - coalesce(kept, 0) AS rows_skipped
       FROM a LEFT JOIN r USING (year, file)
     UNION ALL SELECT DISTINCT year, 'cell', 101, 0, 101 FROM a
     UNION ALL SELECT DISTINCT year, 'cut', NULL, 0, NULL FROM a"""
)


def _award_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract rows with lineage: the fiscal year, and the award's file."""
    return fixtures.awards(spark, sf_dir).withColumns(
        {
            "year": F.col("action_date_fiscal_year").cast("string"),
            "file": F.right("contract_award_unique_key", F.lit(1)),
        }
    )


def awards_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset with a manifest, of which a range of fiscal years is read."""
    output = scratch_dir(spark, "awards")
    write_awards(_award_lines(spark, sf_dir), output, atomic=True)
    rows = read_awards(spark, output, between={"action_date_fiscal_year": (1997, 1998)})
    read = rows.groupBy("year", "file").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("federal_action_obligation").alias("obligation")
    )
    manifest = snapshots.current(spark, output)
    chosen = snapshots.folders(spark, manifest, between={"action_date_fiscal_year": (1997, 1998)})
    return rounded(read.join(chosen.select("year", "file", F.col("rows").alias("listed")), ["year", "file"], "full"), obligation=2)


QUERIES["awards_by_range"] = awards_by_range
ORACLES["awards_by_range"] = with_awards(
    """SELECT cast(action_date_fiscal_year AS varchar) AS year, right(contract_award_unique_key, 1) AS file,
     count(*) AS row_count, round(sum(federal_action_obligation), 2) AS obligation, count(*) AS listed
   FROM awards WHERE action_date_fiscal_year BETWEEN 1997 AND 1998 GROUP BY 1, 2"""
)


def atomic_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits, the second replacing the files of one year, and one that dies on its way."""
    # All three commits read the rows: their joins run once.
    rows = staged(_award_lines(spark, sf_dir), "award-lines", compression="zstd")
    output = scratch_dir(spark, "awards")
    write_awards(rows, output, atomic=True)
    again = rows.filter("year = '1997'").withColumn("award_type", F.lit("again"))
    write_awards(again, output, atomic=True)
    dying = rows.withColumn(
        "award_type",
        F.when(F.col("file") == "7", F.raise_error(F.lit("lost"))).otherwise(F.lit("lost")),
    )
    died = False
    try:
        write_awards(dying, output, atomic=True)
    except Exception:
        died = True
    return (
        read_awards(spark, output)
        .groupBy("year", "file", "award_type")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .withColumn("died", F.lit(died))
    )


QUERIES["atomic_commits"] = atomic_commits
ORACLES["atomic_commits"] = with_awards(
    """SELECT cast(action_date_fiscal_year AS varchar) AS year, right(contract_award_unique_key, 1) AS file,
     CASE WHEN action_date_fiscal_year = 1997 THEN 'again' ELSE award_type END AS award_type,
     count(*) AS row_count, true AS died FROM awards GROUP BY 1, 2, 3"""
)


# ---- summaries kept per drop file ----------------------------------------------------------


def _changed_dataset(spark: SparkSession, sf_dir: str, summary: str, summarise) -> tuple[str, DataFrame]:
    """A dataset summed up, then with the files of one year replaced, and summed up again."""
    rows, output = _award_lines(spark, sf_dir), scratch_dir(spark, "awards")
    write_awards(rows, output, atomic=True)
    summaries.refresh(spark, output, summary, summarise)
    again = rows.filter("year = '1997'").withColumns(
        {name: 2 * F.col(name) for name in ("total_dollars_obligated", subset.VALUE)}
    )
    write_awards(again, output, atomic=True)
    return output, summaries.refresh(spark, output, summary, summarise)


def _with_changed_awards(sql: str) -> str:
    doubled = ", ".join(
        f"CASE WHEN action_date_fiscal_year = 1997 THEN 2 * {name} ELSE {name} END AS {name}"
        for name in ("total_dollars_obligated", subset.VALUE)
    )
    body = sql.strip()[len("WITH ") :].replace("FROM awards", "FROM changed")
    return with_awards(f"WITH changed AS (SELECT * REPLACE ({doubled}) FROM awards), {body}")


def trends_from_kept_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funding per year from a rollup kept per file, after some files were replaced."""
    summary = scratch_dir(spark, "rollup")
    output, _ = _changed_dataset(spark, sf_dir, summary, funding.funding_rollup)
    return round_trends(funding.funding_trends(summaries.read_summary(spark, output, summary)))


QUERIES["trends_from_kept_rollup"] = trends_from_kept_rollup
ORACLES["trends_from_kept_rollup"] = _with_changed_awards(sql_trends())


def rollup_refreshed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that a refresh reads after some were replaced, with their rollup rows."""
    return _changed_dataset(spark, sf_dir, scratch_dir(spark, "rollup"), funding.funding_rollup)[1]


QUERIES["rollup_refreshed_files"] = rollup_refreshed_files
ORACLES["rollup_refreshed_files"] = with_awards(
    """SELECT '1997' AS year, file, count(*) AS rows FROM (
     SELECT DISTINCT right(contract_award_unique_key, 1) AS file, naics_code, naics_description, award_type
     FROM awards WHERE action_date_fiscal_year = 1997) GROUP BY file"""
)


def quantiles_from_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact thresholds whose first guesses come from sketches kept per file."""
    summary = scratch_dir(spark, "sketches")
    output, _ = _changed_dataset(spark, sf_dir, summary, summaries.value_sketches([subset.VALUE]))
    known = summaries.proposal(summaries.read_summary(spark, output, summary), subset.VALUE)
    rows = read_awards(spark, output, [subset.VALUE])
    tails = [subset.LOW_TAIL, subset.HIGH_TAIL]
    low, high = quantiles(rows, subset.VALUE, tails, pick_limit=500, proposal=known)
    return spark.createDataFrame([(low, high)], "low double, high double")


QUERIES["quantiles_from_sketches"] = quantiles_from_sketches
ORACLES["quantiles_from_sketches"] = _with_changed_awards(f"{SQL_CLEAN} SELECT low, high FROM q")


def sample_from_kept_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stratified sample, its cuts from counts kept per file, after some files were replaced."""
    summary = scratch_dir(spark, "draws")
    output, _ = _changed_dataset(spark, sf_dir, summary, subset.sample_counts())
    counts = summaries.read_summary(spark, output, summary)
    return subset.sample_by_counts(subset.clean_awards(read_awards(spark, output)), counts)


QUERIES["sample_from_kept_counts"] = sample_from_kept_counts
ORACLES["sample_from_kept_counts"] = _with_changed_awards(f"{SQL_SAMPLE} SELECT * FROM s")


# ---- a layout by award key -----------------------------------------------------------------


def _by_award(spark: SparkSession, sf_dir: str, **options):
    """A dataset laid out by award key, opened again as another job would."""
    dataset, path = scratch_dir(spark, "awards"), scratch_dir(spark, "by-award")
    write_awards(_award_lines(spark, sf_dir), dataset, atomic=True)
    commit = snapshots.current(spark, dataset)
    write_by_key(read_awards(spark, dataset), path, subset.KEY, of_commit=commit, **options)
    return read_by_key(spark, path, dataset)


def subset_by_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions of the awards in the subset, without a shuffle of transactions."""
    return subset.subset_by_layout(_by_award(spark, sf_dir), [subset.KEY, *REST])


QUERIES["subset_by_layout"] = subset_by_layout
ORACLES["subset_by_layout"] = ORACLES["subset_semi_join"]


def award_totals_by_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subset rows with the totals of their awards, those of the longest awards apart."""
    rows = _by_award(spark, sf_dir, buckets=16, heavy_rows=6)
    return rounded(subset.subset_with_kept_totals(rows), award_obligated=4)


QUERIES["award_totals_by_layout"] = award_totals_by_layout
ORACLES["award_totals_by_layout"] = ORACLES["award_totals_left_join"]

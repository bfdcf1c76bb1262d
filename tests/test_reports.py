import math

import pytest
from pyspark.sql import functions as F

from awardlens.plans import funding, options, outlays, series, subset

REPORT_SCHEMA = (
    "action_date_fiscal_year long, total_dollars_obligated double,"
    "total_outlayed_amount_for_overall_award double, federal_action_obligation double,"
    "naics_code long, naics_description string, award_type string"
)


def report_rows(spark, rows):
    """Rows of (year, obligated, naics code, award type)."""
    full = [(y, o, o, o, c, None if c is None else f"d{c}", t) for y, o, c, t in rows]
    return spark.createDataFrame(full, REPORT_SCHEMA)


# ---- funding ---------------------------------------------------------------------------


def test_trends_compare_with_the_previous_row_present(spark):
    rows = report_rows(
        spark,
        [
            (None, 5.0, None, None),
            (2001, None, None, None),
            (2003, 10.0, None, None),
            (2003, None, None, None),
            (2004, -5.0, None, None),
            (2009, 5.0, None, None),
        ],
    )
    got = funding.funding_trends(rows).collect()
    assert [r["action_date_fiscal_year"] for r in got] == [None, 2001, 2003, 2004, 2009]
    assert [r["total_obligated"] for r in got] == [5.0, 0.0, 10.0, -5.0, 5.0]
    assert [r["previous_year_obligated"] for r in got] == [None, 5.0, 0.0, 10.0, -5.0]
    assert [r["average_obligated_per_award"] for r in got] == [5.0, 0.0, 5.0, -5.0, 5.0]
    yoy = [r["yoy_change_percent"] for r in got]
    assert yoy == [None, -100.0, math.inf, -150.0, -200.0]


def test_trends_year_filter_never_matches_null(spark):
    rows = report_rows(spark, [(None, 1.0, None, None), (2001, 2.0, None, None)])
    got = funding.funding_trends(rows, [2001, None]).collect()
    assert [r["action_date_fiscal_year"] for r in got] == [2001]


def test_sector_share_is_of_the_filtered_year_before_the_cut(spark):
    rows = report_rows(
        spark,
        [
            (2001, 60.0, 541512, "A"),
            (2001, 30.0, 541511, "A"),
            (2001, 10.0, 236220, "A"),
            (2001, 100.0, None, "A"),
            (2001, 7.0, 3, "A"),
            (2002, None, 541512, "A"),
        ],
    )
    top = funding.sector_funding(rows, top_n=2).filter("action_date_fiscal_year = 2001").collect()
    assert [(r["naics_code"], r["sector_name"]) for r in top] == [
        (None, None),
        (541512, "Professional, Scientific, and Technical Services"),
    ]
    assert top[1]["funding_share"] == pytest.approx(60 / 207)

    names = ["Professional, Scientific, and Technical Services", "Construction"]
    kept = funding.sector_funding(rows, 5, [2001], names).collect()
    assert [r["naics_code"] for r in kept] == [541512, 541511, 236220]
    assert [r["funding_share"] for r in kept] == pytest.approx([0.6, 0.3, 0.1])

    zero = funding.sector_funding(rows).filter("action_date_fiscal_year = 2002").first()
    assert zero["total_funding"] == 0.0 and math.isnan(zero["funding_share"])


def test_award_types_keep_the_null_type_and_shares_sum_to_one(spark):
    rows = report_rows(
        spark, [(2001, 1.0, 1, None), (2001, 3.0, 1, "A"), (2002, 2.0, 1, "A"), (None, 2.0, 1, "B")]
    )
    types = funding.award_types(rows)
    assert types.filter("award_type is null").first()["count_share"] == 0.5
    sums = types.groupBy("action_date_fiscal_year").agg(F.sum("count_share"), F.sum("funding_share"))
    assert all(r[1] == 1.0 and r[2] == 1.0 for r in sums.collect())


def test_reports_agree_on_rollup_and_rows(spark):
    rows = report_rows(
        spark,
        [(2000 + i % 3, float(i) if i % 5 else None, 110000 + i % 4, "ABC"[i % 3]) for i in range(60)],
    )
    rollup = funding.funding_rollup(rows)
    assert rollup.agg(F.sum("transactions")).first()[0] == 60
    for report in (funding.funding_trends, funding.sector_funding, funding.award_types):
        assert sorted(report(rows).collect()) == sorted(report(rollup).collect())


def test_filter_options(spark):
    rows = report_rows(
        spark,
        [(2002, 1.0, 236220, "A"), (2001, 1.0, 236221, "A"), (None, 1.0, None, "A"), (2001, 1.0, 3, "A")],
    )
    assert [r[0] for r in options.year_options(rows).collect()] == [None, 2001, 2002]
    assert [r[0] for r in options.sector_options(rows).collect()] == ["Construction", "Unknown Sector"]
    assert [r["sector_name"] for r in options.default_sectors(rows, 3).collect()] == [
        "Unknown Sector", "Construction", "Construction",
    ]
    lookup = {r["naics_code"]: r["sector_name"] for r in options.sector_lookup(rows).collect()}
    assert lookup[None] is None and lookup[236220] == "Construction"


def test_series_stack_groups_of_one_sector_and_drop_the_null_type(spark):
    rows = report_rows(
        spark, [(2001, 1.0, 236220, None), (2001, 2.0, 236221, "A"), (2001, 4.0, None, "A")]
    )
    sector = series.sector_series(funding.sector_funding(rows))
    got = {(r["panel"], r["series"]): r["value"] for r in sector.collect()}
    assert got == {
        ("Total Funding by Sector", "Construction"): 3.0,
        ("Number of Awards by Sector", "Construction"): 2.0,
        ("Average Funding per Award", "Construction"): 3.0,
    }
    types = series.award_type_series(funding.award_types(rows))
    assert {r["series"] for r in types.collect()} == {"A"}
    dollars = series.dollar_series(funding.funding_trends(rows))
    assert {r["series"] for r in dollars.collect()} == {
        "Total Obligated", "Total Outlayed", "Federal Obligation",
    }
    panels = series.funding_series(funding.funding_trends(rows))
    assert panels.count() == 6 and panels.filter("value is null").count() == 1


# ---- outlays ---------------------------------------------------------------------------


def outlay_input(spark):
    rows = [
        ("2024-01-01", 2e6, 1e6, 3e6, 3e6),
        ("2024-12-31", 3e6, 4e6, 3e6, None),
        ("2025-01-01", 9e6, 1.0, 1.0, 1.0),
        ("2023-12-31", 9e6, 1.0, 1.0, 1.0),
        ("2024-06-01", 1e6, 1.0, 1.0, 1.0),
        ("2024-06-01", 5e6, None, None, 1.0),
        ("not a date", 9e6, 1.0, 1.0, 1.0),
        (None, 9e6, 1.0, 1.0, 1.0),
        ("2024-06-01", None, 1.0, 1.0, 1.0),
    ]
    names = list(outlays.OUTLAY_COLUMNS)
    kinds = ["string"] + ["double"] * 4
    return spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def test_outlay_report(spark):
    awards = outlays.outlay_rows(outlay_input(spark))
    assert outlays.filter_awards(awards).count() == 3
    report = outlays.outlay_report(awards)
    row = report.first()
    assert (row["total_rows"], row["filtered_rows"], row["result_rows"]) == (9, 3, 3)
    assert row["total_outlay"] == 10e6 and row["total_current_value"] == 5e6
    assert row["less_than_potential_count"] == 1 and row["exceeds_current_count"] == 2
    assert row["filtered_percent"] == pytest.approx(100 / 3)
    outlay = {r["comparison"]: r["len"] for r in outlays.outlay_vs_potential(report).collect()}
    assert outlay == {"less_than": 1, "equal": 1, "greater_than": 1}
    obligated = outlays.obligated_vs_potential(report)
    assert {r["comparison"]: r["len"] for r in obligated.collect()} == {
        "less_than": 1, "equal": 1, "greater_than": 1,
    }
    assert obligated.agg(F.sum("percentage")).first()[0] == pytest.approx(100)
    labels = outlays.labelled(obligated, "Obligated").select("label").collect()
    assert {r[0] for r in labels} == {f"Obligated {s} Potential" for s in "<=>"}


def test_outlay_report_without_matching_rows(spark):
    awards = outlays.outlay_rows(outlay_input(spark))
    row = outlays.outlay_report(awards, year=1990).first()
    assert row["result_rows"] == 0 and row["total_outlay"] == 0.0
    assert row["exceeds_current_percent"] is None and row["filtered_percent"] == 0.0
    assert outlays.outlay_vs_potential(outlays.outlay_report(awards, 1990)).count() == 0


def test_outlay_report_over_a_sample(spark):
    awards = outlays.outlay_rows(outlay_input(spark))
    row = outlays.outlay_report(awards, sample_fraction=0.7).first()
    assert (row["total_rows"], row["filtered_rows"], row["result_rows"]) == (9, 3, 2)
    with pytest.raises(ValueError):
        outlays.outlay_report(awards, sample_fraction=1.5)


def test_outlay_text_columns_are_read_leniently(spark):
    rows = [("2024-05-05", "2000000", "NaN", "oops", "N/A")]
    text = spark.createDataFrame(rows, list(outlays.OUTLAY_COLUMNS))
    row = outlays.outlay_rows(text).first()
    assert tuple(row)[1:] == (2e6, None, None, None)


def test_date_and_amount_filters_reach_a_parquet_scan(spark, tmp_path, capsys):
    typed = outlay_input(spark).filter("period_of_performance_current_end_date like '20%'")
    end = "period_of_performance_current_end_date"
    typed.withColumn(end, F.col(end).cast("date")).write.parquet(f"{tmp_path}/p")
    awards = outlays.outlay_rows(spark.read.parquet(f"{tmp_path}/p"))
    outlays.filter_awards(awards).explain("formatted")
    plan = capsys.readouterr().out
    assert f"GreaterThanOrEqual({end},2024-01-01)" in plan and f"LessThan({end},2025-01-01)" in plan


# ---- subset ----------------------------------------------------------------------------


def subset_input(spark, n=400):
    rows = []
    for i in range(n):
        rows.append(
            (
                f"extra{i}", f"k{i // 2}", None if i % 9 == 0 else float(i), "AB"[i % 2] if i % 5 else None,
                f"r{i}", 541500 + i % 7, i % 3, "n", "T" if i % 2 else "true", "f" if i % 3 else None, i,
            )
        )
    names = ["first_extra", *subset.INITIAL_COLUMNS, "last_extra"]
    return spark.createDataFrame(rows, names)


def test_subset_is_sample_and_tails_with_own_columns(spark):
    rows = subset_input(spark)
    full = subset.build_subset(rows)
    assert full.columns == [*subset.INITIAL_COLUMNS, "first_extra", "last_extra"]
    clean = subset.clean_awards(rows)
    low, high = subset.value_thresholds(clean)
    sample = subset.stratified_sample(clean)
    edges = subset.edge_cases(clean, low, high)
    union = sample.unionByName(edges).distinct()
    assert sorted(map(str, full.select(*subset.INITIAL_COLUMNS).collect())) == sorted(
        map(str, union.collect())
    )
    source = {r["first_extra"]: r["recipient_name"] for r in rows.collect()}
    assert all(source[r["first_extra"]] == r["recipient_name"] for r in full.collect())
    assert {r["award_type"] for r in full.collect()} == {"A", "B", "unknown"}
    assert {r["minority_owned_business"] for r in full.collect()} == {True, None}


def test_sample_sizes_per_award_type(spark):
    clean = subset.clean_awards(subset_input(spark))
    n = {r["award_type"]: r["count"] for r in clean.groupBy("award_type").count().collect()}
    got = subset.stratified_sample(clean).groupBy("award_type").count().collect()
    assert {r["award_type"]: r["count"] for r in got} == {t: math.floor(0.2 * c) for t, c in n.items()}


def test_subset_by_key_pairs_rows_of_one_award(spark):
    rows = subset_input(spark, 60)
    small = subset.subset_rows(rows)
    by_key = subset.subset_by_key(rows)
    assert by_key.count() == 2 * small.count()
    assert by_key.columns == [*subset.INITIAL_COLUMNS, "first_extra", "last_extra"]


def test_tails_are_strict_and_missing_values_are_in_none(spark):
    rows = subset_input(spark, 40)
    clean = subset.clean_awards(rows)
    got = {r[subset.VALUE] for r in subset.edge_cases(clean, 2.0, 37.0).collect()}
    assert got == {1.0, 38.0, 39.0}
    assert subset.edge_cases(clean, None, None).count() == 0


@pytest.mark.parametrize("code", ["-1", "4294967296", "54A"])
def test_codes_outside_unsigned_32_bits_fail(spark, code):
    df = spark.createDataFrame([(code,)], "naics_code string")
    with pytest.raises(Exception, match="unsigned 32-bit"):
        df.select(subset.as_uint32(F.col("naics_code"))).collect()


def test_codes_inside_unsigned_32_bits_pass(spark):
    df = spark.createDataFrame([(2**32 - 1,), (None,), (0,)], "naics_code long")
    got = [r[0] for r in df.select(subset.as_uint32(F.col("naics_code"))).collect()]
    assert got == [2**32 - 1, None, 0]


def test_the_subset_job_stages_its_input_once(spark, tmp_path, monkeypatch):
    columns = [*subset.INITIAL_COLUMNS, "note"]
    rows = [(str(k), float(k), "AB"[k % 2], "r", k, k, None, "t", None, f"n{k}") for k in range(40)]
    kinds = "a string, b double, c string, d string, e long, f long, g string, h string, i string, j string"
    spark.createDataFrame(rows, kinds).toDF(*columns).write.option("header", True).csv(str(tmp_path / "in"))
    staged, names = subset.staged, []
    monkeypatch.setattr(subset, "staged", lambda df, name, *more, **how: names.append(name) or staged(df, name, *more, **how))
    subset.subset_job(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert len(names) == 1
    found = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert all(row["note"] == f"n{row[subset.KEY]}" for row in found)
    assert {"0", "1", "38", "39"} <= {row[subset.KEY] for row in found}
    assert len(found) >= 8


def test_whole_rows_are_staged_small(spark, monkeypatch):
    staged, how_staged = subset.staged, []
    monkeypatch.setattr(subset, "staged", lambda df, name, **how: how_staged.append(how) or staged(df, name, **how))
    assert subset.build_subset(subset_input(spark, 40), stage_rows=True).count() >= 8
    assert [how["compression"] for how in how_staged] == ["zstd"]

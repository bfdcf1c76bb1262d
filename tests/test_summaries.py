"""Summaries kept per drop file: what a refresh reads, and that nothing else changes."""

import pytest
from pyspark.sql import functions as F

from awardlens.operators.quantiles import Proposal, quantiles
from awardlens.operators.sampling import exact_sample
from awardlens.plans import funding, summaries
from awardlens.sources import snapshots
from awardlens.sources.tables import read_awards, write_awards


def rows(spark, *years, files=("01", "a b"), scale=1.0):
    whole = spark.range(400).select(
        F.element_at(F.array(*map(F.lit, map(str, years))), (F.col("id") % len(years) + 1).cast("int")).alias("year"),
        F.element_at(F.array(*map(F.lit, files)), (F.col("id") % 7 % len(files) + 1).cast("int")).alias("file"),
        (2000 + F.col("id") % 4).alias("action_date_fiscal_year"),
        *((scale * (F.col("id") % k - 3)).alias(name) for name, k in AMOUNTS.items()),
        F.when(F.col("id") % 5 > 0, F.col("id") % 3).cast("string").alias("naics_code"),
        F.lit("d").alias("naics_description"),
        F.when(F.col("id") % 11 > 0, F.lit("t")).alias("award_type"),
    )
    return whole.withColumn("naics_code", F.concat(F.lit("11"), "naics_code"))


AMOUNTS = {
    "total_dollars_obligated": 17,
    "total_outlayed_amount_for_overall_award": 13,
    "federal_action_obligation": 101,
}


def trends(df):
    return sorted(map(tuple, funding.funding_trends(df).collect()))


@pytest.fixture
def paths(tmp_path):
    return str(tmp_path / "dataset"), str(tmp_path / "summary")


def test_rollup_follows_the_dataset(spark, paths):
    dataset, summary = paths
    write_awards(rows(spark, 2001, 2002), dataset, atomic=True)
    assert summaries.refresh(spark, dataset, summary).count() == 4
    assert trends(summaries.read_summary(spark, dataset, summary)) == trends(rows(spark, 2001, 2002))
    assert summaries.refresh(spark, dataset, summary).count() == 0  # nothing to do
    write_awards(rows(spark, 2002, files=("01",), scale=3.0), dataset, atomic=True)
    write_awards(rows(spark, 2003), dataset, atomic=True)
    with pytest.raises(ValueError, match="behind"):
        summaries.read_summary(spark, dataset, summary)
    found = summaries.refresh(spark, dataset, summary).collect()
    assert {(r["year"], r["file"]) for r in found} == {("2002", "01"), ("2003", "01"), ("2003", "a b")}
    left = rows(spark, 2001, 2002).filter("NOT (year = '2002' AND file = '01')")
    whole = left.union(rows(spark, 2002, files=("01",), scale=3.0)).union(rows(spark, 2003))
    kept = summaries.read_summary(spark, dataset, summary)
    assert trends(kept) == trends(whole)
    assert kept.count() < whole.count()


def test_a_refresh_that_dies_changes_nothing(spark, paths):
    dataset, summary = paths
    write_awards(rows(spark, 2001), dataset, atomic=True)
    summaries.refresh(spark, dataset, summary)
    before = snapshots.current(spark, summary)
    write_awards(rows(spark, 2001, scale=2.0), dataset, atomic=True)

    def dying(df, per):
        lost = F.when(F.col("file") == "01", F.raise_error(F.lit("lost"))).otherwise(F.col("award_type"))
        return funding.funding_rollup(df, per).withColumn("award_type", lost)

    with pytest.raises(Exception, match="lost"):
        summaries.refresh(spark, dataset, summary, dying)
    assert snapshots.current(spark, summary) == before
    assert summaries.refresh(spark, dataset, summary).count() == 2
    assert trends(summaries.read_summary(spark, dataset, summary)) == trends(rows(spark, 2001, scale=2.0))


def test_a_dataset_without_manifest_is_refused(spark, paths):
    write_awards(rows(spark, 2001), paths[0])
    with pytest.raises(ValueError, match="no manifest"):
        summaries.refresh(spark, *paths)


@pytest.mark.parametrize("odd", [None, float("nan"), float("inf"), float("-inf")])
def test_sketches_of_odd_values(spark, paths, odd):
    name = "total_dollars_obligated"
    mixed = rows(spark, 2001).withColumn(
        name, F.when(F.col("action_date_fiscal_year") == 2000, F.lit(odd).cast("double")).otherwise(F.col(name))
    )
    none = rows(spark, 2002).withColumn(name, F.lit(odd).cast("double"))
    for df in (mixed, none, mixed.union(none)):
        dataset, summary = (f"{path}-{df.semanticHash()}" for path in paths)
        write_awards(df, dataset, atomic=True)
        summaries.refresh(spark, dataset, summary, summaries.value_sketches([name, "federal_action_obligation"]))
        known = summaries.proposal(summaries.read_summary(spark, dataset, summary), name)
        for method in ("nearest", "disc"):
            asked = [0.0, 0.05, 0.5, 0.95, 1.0]
            expected = quantiles(df, name, asked, method)
            assert str(quantiles(df, name, asked, method, pick_limit=10, proposal=known)) == str(expected)


def test_wrong_guesses_only_take_longer(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    wild = Proposal(1000, 0.0, 999.0, lambda shares: [-5.0, 2000.0, 1.0])
    assert quantiles(df, "v", [0.3], pick_limit=5, proposal=wild) == quantiles(df, "v", [0.3])


SAMPLED = ["award_type", "naics_code", "federal_action_obligation"]


@pytest.mark.parametrize("strata", [[], ["award_type", "naics_code"]])
def test_sample_from_counts_of_two_drops_is_that_of_their_union(spark, paths, strata):
    dataset, summary = paths
    counts_of = summaries.draw_counts(SAMPLED, 5, strata)
    write_awards(rows(spark, 2001, 2002), dataset, atomic=True)
    summaries.refresh(spark, dataset, summary, counts_of)
    write_awards(rows(spark, 2002, 2003, scale=3.0), dataset, atomic=True)
    assert summaries.refresh(spark, dataset, summary, counts_of).count() == 4
    whole = rows(spark, 2001, 2002).filter("year = '2001'").union(rows(spark, 2002, 2003, scale=3.0)).select(*SAMPLED)
    counts = summaries.read_summary(spark, dataset, summary)
    for fraction in (0.0005, 0.37, 1.0):
        kept = summaries.sample_from_counts(read_awards(spark, dataset, SAMPLED), counts, fraction, 5, strata)
        expected = exact_sample(whole, fraction, 5, strata)
        assert sorted(map(repr, kept.collect())) == sorted(map(repr, expected.collect()))


def test_counts_with_long_edges(spark, paths, monkeypatch):
    monkeypatch.setattr("awardlens.operators.sampling.EDGE_ROWS", 1)
    monkeypatch.setattr("awardlens.operators.sampling.PREFIX_DIGITS", 1)
    dataset, summary = paths
    write_awards(rows(spark, 2001), dataset, atomic=True)
    summaries.refresh(spark, dataset, summary, summaries.draw_counts(SAMPLED, 5, ["award_type"]))
    counts = summaries.read_summary(spark, dataset, summary)
    kept = summaries.sample_from_counts(read_awards(spark, dataset, SAMPLED), counts, 0.3, 5, ["award_type"])
    expected = exact_sample(rows(spark, 2001).select(*SAMPLED), 0.3, 5, ["award_type"])
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, expected.collect()))


def test_counts_of_other_draws_are_refused(spark, paths):
    dataset, summary = paths
    write_awards(rows(spark, 2001), dataset, atomic=True)
    summaries.refresh(spark, dataset, summary, summaries.draw_counts(SAMPLED, 5))
    counts = summaries.read_summary(spark, dataset, summary)
    whole = read_awards(spark, dataset, SAMPLED)
    for other in (whole.select(SAMPLED[0]), whole.withColumn("naics_code", F.col("naics_code").cast("int"))):
        with pytest.raises(ValueError, match="draws"):
            summaries.sample_from_counts(other, counts, 0.1, 5)
    with pytest.raises(ValueError, match="draws"):
        summaries.sample_from_counts(whole, counts, 0.1, 6)


def test_sample_of_a_dataset_without_rows(spark, paths):
    dataset, summary = paths
    write_awards(rows(spark, 2001), dataset, atomic=True)
    summaries.refresh(spark, dataset, summary, summaries.draw_counts(SAMPLED, 5))
    none = summaries.read_summary(spark, dataset, summary).limit(0)
    assert summaries.sample_from_counts(read_awards(spark, dataset, SAMPLED).limit(0), none, 0.1, 5).isEmpty()

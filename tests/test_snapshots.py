"""Datasets with a manifest: commits, folders chosen by range, what stays after a failure."""

import pytest
from pyspark.sql import functions as F

from awardlens.sources import snapshots
from awardlens.sources.tables import read_awards, write_awards

SCHEMA = "year string, file string, action_date_fiscal_year long, award string, period_of_performance_current_end_date date"


def rows(spark, *years, award="a", files=("01", "a b+c=%41")):
    out = [(str(y), f, y + k, award, None) for y in years for f in files for k in (0, 1)]
    return spark.createDataFrame(out, SCHEMA).withColumn(
        "period_of_performance_current_end_date", F.make_date("action_date_fiscal_year", F.lit(6), F.lit(1))
    )


def content(df):
    return sorted((r["year"], r["file"], r["action_date_fiscal_year"], r["award"]) for r in df.collect())


def test_commits_replace_folders_and_keep_others(spark, tmp_path):
    path = str(tmp_path / "d")
    first, second = rows(spark, 2001, 2002), rows(spark, 2002, award="b", files=("01",))
    write_awards(first, path, atomic=True)
    assert content(read_awards(spark, path)) == content(first)
    write_awards(second, path, atomic=True)
    expected = first.filter("NOT (year = '2002' AND file = '01')").union(second)
    found = read_awards(spark, path)
    assert content(found) == content(expected)
    assert found.columns[-2:] == ["year", "file"] and dict(found.dtypes)["file"] == "string"
    assert content(read_awards(spark, path, drop_years=["2002"])) == content(expected.filter("year = '2002'"))
    assert read_awards(spark, path, ["award", "file"]).columns == ["award", "file"]
    assert content(read_awards(spark, path, drop_years=["1999"])) == []


def test_ranges_choose_folders(spark, tmp_path):
    path = str(tmp_path / "d")
    whole = rows(spark, 2001, 2003, 2005)
    write_awards(whole, path, atomic=True)
    for between, condition, folders in [
        ({"action_date_fiscal_year": (2004, 2005)}, "action_date_fiscal_year BETWEEN 2004 AND 2005", 4),
        ({"action_date_fiscal_year": (None, 2001)}, "action_date_fiscal_year <= 2001", 2),
        ({"action_date_fiscal_year": (2006, None)}, "action_date_fiscal_year >= 2006", 2),
        ({"period_of_performance_current_end_date": ("2002-01-01", "2003-12-31")}, "action_date_fiscal_year IN (2002, 2003)", 4),
        ({"award": ("a", "a")}, "true", 6),  # not a column with ranges
        ({"action_date_fiscal_year": (2020, 2030)}, "false", 0),
    ]:
        found = read_awards(spark, path, between=between)
        assert content(found) == content(whole.filter(condition))
        assert len({f.rpartition("/")[0] for f in opened(found)}) == folders
    plain = str(tmp_path / "plain")
    write_awards(whole, plain)
    between = {"action_date_fiscal_year": (2004, 2005)}
    assert content(read_awards(spark, plain, between=between)) == content(read_awards(spark, path, between=between))


def opened(df):
    """Files that the scans of the plan open, whether or not their rows are wanted."""
    df.collect()
    names = []
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.nodeName().startswith("Scan parquet"):
            parts = leaf.inputRDD().getPartitions() if hasattr(leaf, "inputRDD") else []
            for part in parts:
                names += [file.urlEncodedPath() for file in part.files()]
    return names


def test_a_folder_of_nulls_is_read(spark, tmp_path):
    path = str(tmp_path / "d")
    nulls = rows(spark, 2001).withColumn("action_date_fiscal_year", F.lit(None).cast("long"))
    write_awards(nulls.unionByName(rows(spark, 2009)), path, atomic=True)
    manifest = snapshots.current(spark, path)
    live = snapshots.folders(spark, manifest, between={"action_date_fiscal_year": (2001, 2002)})
    assert {r["year"] for r in live.collect()} == {"2001"}


def failing(spark):
    lost = F.when(F.col("file") == "01", F.raise_error(F.lit("lost"))).otherwise(F.lit("lost"))
    return rows(spark, 2001, 2002).withColumn("award", lost)


def test_a_job_that_dies_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "d")
    with pytest.raises(Exception, match="lost"):
        write_awards(failing(spark), path, atomic=True)
    assert snapshots.current(spark, path) is None
    first = rows(spark, 2001)
    write_awards(first, path, atomic=True)
    before = snapshots.current(spark, path)
    reader = read_awards(spark, path)
    with pytest.raises(Exception, match="lost"):
        write_awards(failing(spark), path, atomic=True)
    assert snapshots.current(spark, path) == before
    assert content(read_awards(spark, path)) == content(first) == content(reader)


def test_a_manifest_that_was_not_finished_does_not_count(spark, tmp_path):
    path = str(tmp_path / "d")
    first = rows(spark, 2001)
    write_awards(first, path, atomic=True)
    write_awards(rows(spark, 2001, award="b"), path, atomic=True)
    manifest = snapshots.current(spark, path)
    (tmp_path / "d" / "_manifests" / manifest.rpartition("/")[2] / "_SUCCESS").unlink()
    assert content(read_awards(spark, path)) == content(first)
    write_awards(rows(spark, 2002), path, atomic=True)
    assert content(read_awards(spark, path)) == content(first.union(rows(spark, 2002)))


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "d")
    write_awards(rows(spark, 2001), path, atomic=True)
    stored = snapshots.store_schema

    def meanwhile(*args):
        monkeypatch.setattr(snapshots, "store_schema", stored)
        write_awards(rows(spark, 2002), path, atomic=True)
        stored(*args)

    monkeypatch.setattr(snapshots, "store_schema", meanwhile)
    with pytest.raises(RuntimeError, match="another job"):
        write_awards(rows(spark, 2003), path, atomic=True)
    assert {r["year"] for r in read_awards(spark, path).collect()} == {"2001", "2002"}


def test_new_and_changed_columns(spark, tmp_path):
    path = str(tmp_path / "d")
    write_awards(rows(spark, 2001), path, atomic=True)
    more = rows(spark, 2002).withColumn("more", F.lit(1.5)).drop("award")
    write_awards(more, path, atomic=True)
    found = read_awards(spark, path)
    assert found.columns[:2] == ["action_date_fiscal_year", "award"] and "more" in found.columns
    assert found.filter("more = 1.5").count() == 4 and found.filter("award = 'a'").count() == 4


def test_refusals(spark, tmp_path):
    path = str(tmp_path / "d")
    write_awards(rows(spark, 2001), path, atomic=True)
    with pytest.raises(FileExistsError):
        write_awards(rows(spark, 2001), path, overwrite=False, atomic=True)
    with pytest.raises(ValueError, match="manifest"):
        write_awards(rows(spark, 2001), path)
    plain = str(tmp_path / "plain")
    write_awards(rows(spark, 2001), plain)
    with pytest.raises(FileExistsError, match="without a manifest"):
        write_awards(rows(spark, 2001), plain, atomic=True)


def test_unreferenced_data_is_removed(spark, tmp_path):
    path = str(tmp_path / "d")
    for award in "abc":
        write_awards(rows(spark, 2001, award=award), path, atomic=True)
    with pytest.raises(Exception, match="lost"):
        write_awards(failing(spark), path, atomic=True)
    expected = content(rows(spark, 2001, award="c"))
    assert len(snapshots.remove_unreferenced(spark, path)) == 2 + 1 + 2
    assert content(read_awards(spark, path)) == expected
    assert len(list((tmp_path / "d" / "_data").iterdir())) == 1
    assert snapshots.remove_unreferenced(spark, path) == []
    assert snapshots.remove_unreferenced(spark, str(tmp_path / "none")) == []

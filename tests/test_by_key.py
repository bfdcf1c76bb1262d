"""Rows laid out by a key: same results as joins, no shuffle of the wide rows, hot and null keys."""

import time

import pytest
from pyspark.sql import functions as F

from awardlens.fixtures import write_drop_files
from awardlens.operators.keys import restrict_to_keys
from awardlens.session import session_conf, staged, writing
from awardlens.sources import by_key, snapshots
from awardlens.sources.by_key import forget, read_by_key, write_by_key
from awardlens.sources.tables import read_awards, write_awards


def rows(spark, count=3000):
    """A third of the rows has one key, a tenth none; names that need quoting; repeated rows."""
    key = F.when(F.col("id") % 10 == 9, None).when(F.col("id") % 3 == 0, "hot's").otherwise(F.concat(F.lit("k "), F.col("id") % 200))
    return spark.range(count).select(
        key.alias("award key"),
        (F.col("id") % 7).alias("a`b"),
        F.lit("wide" * 5).alias("Rest"),
        F.when(F.col("id") % 4 > 0, F.col("id") % 13).alias("amount"),
    )


def in_order(df):
    return sorted(map(tuple, df.collect()), key=repr)


def keys_of(spark, *keys):
    return spark.createDataFrame([(key,) for key in keys], "`award key` string")


def sums():
    return [F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"), F.min("amount").alias("least")]


@pytest.fixture
def layout(spark, tmp_path):
    yield write_by_key(rows(spark), str(tmp_path / "by-key"), "award key", buckets=8, heavy_rows=100)
    forget(spark, str(tmp_path / "by-key"))


def test_all_rows_are_held_once(spark, layout):
    assert in_order(layout.rows()) == in_order(rows(spark))
    assert [r[0] for r in layout.heavy_keys.collect()] == ["hot's"]
    assert layout.light.filter("`award key` IS NULL").isEmpty()


@pytest.mark.parametrize("keys", [(), ("k 1",), ("hot's",), ("k 1", "k 1", "hot's", None, "absent"), (None,)])
def test_key_filter_and_totals(spark, layout, keys):
    wanted = keys_of(spark, *keys)
    expected = restrict_to_keys(rows(spark), wanted, "award key")
    assert in_order(layout.of_keys(wanted)) == in_order(expected)
    assert in_order(layout.of_keys(wanted, ["amount"])) == in_order(expected.select("amount"))
    summed = layout.totals(sums(), ["amount"], wanted)
    assert in_order(summed) == in_order(expected.groupBy("award key").agg(*sums()))


def test_totals_of_all_keys(spark, layout):
    assert in_order(layout.totals(sums(), ["amount"])) == in_order(rows(spark).groupBy("award key").agg(*sums()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wide_rows_are_not_shuffled(spark, layout, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        light = layout.light.join(keys_of(spark, "k 1").distinct(), "award key", "left_semi")
        joined, summed = plan(light), plan(layout.light.groupBy("`award key`").agg(*sums()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The one exchange is that of the keys, which follow the layout's buckets.
    assert joined.count("Exchange hashpartitioning") <= 2 and "Bucketed: true" in joined
    wide = joined[: joined.index("Bucketed: true")]
    assert "Exchange" not in wide
    assert "Exchange" not in summed


def test_only_asked_columns_are_read(spark, layout):
    assert "Rest" not in plan(layout.of_keys(keys_of(spark, "k 1", "hot's"), ["amount"]))


def test_no_rows(spark, tmp_path):
    empty = write_by_key(rows(spark, 0), str(tmp_path / "none"), "award key", buckets=2)
    assert empty.rows().isEmpty()
    assert empty.of_keys(keys_of(spark, "k 1")).isEmpty()
    assert empty.totals(sums(), ["amount"]).isEmpty()


def test_only_rows_without_a_key(spark, tmp_path):
    none = rows(spark).withColumn("award key", F.lit(None).cast("string"))
    layout = write_by_key(none, str(tmp_path / "nulls"), "award key", buckets=2)
    assert layout.rows().count() == 3000
    assert layout.of_keys(keys_of(spark, "k 1", None)).isEmpty()


def test_opened_by_another_session(spark, tmp_path, layout):
    path = str(tmp_path / "by-key")
    forget(spark, path)
    again = read_by_key(spark, path)
    assert in_order(again.rows()) == in_order(rows(spark))
    assert "Exchange" not in plan(again.light.groupBy("`award key`").count())


def test_refusals(spark, tmp_path, layout):
    with pytest.raises(FileExistsError):
        write_by_key(rows(spark), str(tmp_path / "by-key"), "award key")
    with pytest.raises(FileNotFoundError):
        read_by_key(spark, str(tmp_path / "absent"))
    with pytest.raises(ValueError, match="at least 1"):
        write_by_key(rows(spark), str(tmp_path / "other"), "award key", buckets=0)


def test_a_layout_that_is_behind_is_refused(spark, tmp_path):
    dataset, path = str(tmp_path / "dataset"), str(tmp_path / "by-key")
    with_lineage = rows(spark, 50).withColumnsRenamed({"a`b": "b"}).withColumns({"year": F.lit("1"), "file": F.lit("x")})
    write_awards(with_lineage, dataset, atomic=True)
    write_by_key(read_awards(spark, dataset), path, "award key", 2, of_commit=snapshots.current(spark, dataset))
    assert read_by_key(spark, path, dataset).rows().count() == 50
    write_awards(with_lineage, dataset, atomic=True)
    with pytest.raises(ValueError, match="behind"):
        read_by_key(spark, path, dataset)


def test_wide_rows_are_shuffled_once_to_be_laid_out(spark):
    """Also where heavy keys are too many to be known to all tasks."""
    wide, many = rows(spark), keys_of(spark, *(f"k {at}" for at in range(100))).distinct()
    with writing(spark, by_key._one_shuffle(16) | {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        light = plan(by_key._light_rows(wide, many, "award key", 16))
    # That of the wide rows and those of the keys, which are made distinct here.
    assert light.count("hashpartitioning(award key") == light.count(", 16)") == 2
    assert "REPARTITION" not in light


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_many_heavy_keys(spark, tmp_path, threshold):
    path, once = str(tmp_path / "many"), rows(spark)
    wide = once.unionByName(once.filter(F.col("award key").endswith("1")))
    with session_conf(spark, {"spark.sql.autoBroadcastJoinThreshold": threshold}):
        layout = write_by_key(wide, path, "award key", buckets=4, heavy_rows=12)
    often = {r[0] for r in wide.groupBy("award key").count().filter("count > 12").collect()} - {None}
    assert 10 < len(often) < wide.select("award key").distinct().count() - 1
    assert {r[0] for r in layout.heavy_keys.collect()} == often
    assert {r[0] for r in layout.heavy.select("award key").distinct().collect()} == often | {None}
    assert not often & {r[0] for r in layout.light.select("award key").distinct().collect()}
    assert in_order(layout.rows()) == in_order(wide)
    assert layout.light.columns == layout.heavy.columns == wide.columns
    assert in_order(layout.totals(sums(), ["amount"])) == in_order(wide.groupBy("award key").agg(*sums()))
    forget(spark, path)


def test_what_a_write_has_shuffled_goes_with_its_end(spark, tmp_path):
    def shuffled():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        files = blocks.getAllFiles()
        return {files.apply(at).getName() for at in range(files.size()) if files.apply(at).getName().startswith("shuffle_")}

    before, path = shuffled(), str(tmp_path / "by-key")
    staged(rows(spark).repartition(4, "amount"), "dealt")
    with session_conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        write_by_key(rows(spark), path, "award key", buckets=4, heavy_rows=100)
    lines = rows(spark).select(F.lit("2001").alias("year"), F.col("`a``b`").cast("string").alias("file"), F.lit("x,1").alias("line"))
    assert write_drop_files(lines, "key,amount", str(tmp_path / "drops")) == ["2001"]
    until = time.time() + 20
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    forget(spark, path)

import math

import pytest
from pyspark.sql import functions as F

from awardlens.functions import (
    bool_from_words,
    compare3,
    file_id,
    ieee_div,
    iso_date,
    mean_over_rows,
    null_tokens_to_null,
    parse_tf,
    sector_code,
    sector_name,
    sum0,
)
from awardlens.functions.cleaning import NULL_TOKENS
from awardlens.sources.vocabulary import bool_vocabulary


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row[0] for row in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_division_follows_floating_point_rules(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (3.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = [r[0] for r in df.select(ieee_div(F.col("a"), F.col("b"))).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2])
    assert got[3:] == [None, None, 1.5]


def test_division_of_integers_and_nan(spark):
    df = spark.createDataFrame([(1, 4)], "a long, b long")
    assert df.select(ieee_div(F.col("a"), F.col("b"))).first()[0] == 0.25
    nan = spark.createDataFrame([(float("nan"), 0.0)], "a double, b double")
    assert math.isnan(nan.select(ieee_div(F.col("a"), F.col("b"))).first()[0])


def test_sum_of_nulls_is_zero_and_mean_counts_them(spark):
    df = spark.createDataFrame([("a", None), ("b", 3.0), ("b", None)], "k string, v double")
    got = df.groupBy("k").agg(sum0("v"), mean_over_rows("v")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [("a", 0.0, 0.0), ("b", 3.0, 1.5)]


def test_sectors(spark):
    codes = [111110, 3, 99, 541512, None, 44]
    assert column(spark, codes, "long", sector_code) == ["11", "3", "99", "54", None, "44"]
    assert column(spark, codes, "long", sector_name) == [
        "Agriculture, Forestry, Fishing and Hunting",
        "Unknown Sector",
        "Unknown Sector",
        "Professional, Scientific, and Technical Services",
        None,
        "Retail Trade",
    ]


def test_flags_accept_single_letters_only(spark):
    flags = ["t", "T", "f", "F", "true", "Y", "", None]
    assert column(spark, flags, "string", parse_tf) == [True, True, False, False] + [None] * 4


def test_vocabulary_matches_exact_spellings(spark):
    words = bool_vocabulary()
    texts = ["true", "TRUE", "True", "tRUE", "oN", "On", "no", "OFF", None]
    assert column(spark, texts, "string", lambda _: bool_from_words("v", *words)) == [
        True, True, True, None, None, True, False, False, None,
    ]


def test_null_tokens(spark):
    assert len(NULL_TOKENS) == 17
    texts = NULL_TOKENS + ["None", " NA", "Null", None]
    expected = [None] * 17 + ["None", " NA", "Null", None]
    assert column(spark, texts, "string", lambda _: null_tokens_to_null("v")) == expected


def test_dates_are_strict(spark):
    texts = ["2024-01-05", "2024-1-5", "2024", "2024-02-30", "x", "2024-01-05T00:00:00", None]
    got = column(spark, texts, "string", lambda _: iso_date("v"))
    assert str(got[0]) == "2024-01-05" and got[1:] == [None] * 6


def test_comparison_counts_null_as_zero(spark):
    rows = [(1.0, 2.0), (2.0, 2.0), (3.0, 2.0), (None, 0.0), (None, None), (1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = [r[0] for r in df.select(compare3(F.col("a"), F.col("b"))).collect()]
    assert got == ["less_than", "equal", "greater_than", "equal", "equal", "greater_than"]


@pytest.mark.parametrize(
    "name, expected",
    [
        ("x_All_1.csv.zst", "1"),
        ("x_All_01.csv.zst", "01"),
        ("nofileno.csv.zst", "nofileno.csv"),
        ("x_12.csvXzst", "12"),
        ("x_12.csv.zst.bak.zst", "x_12.csv.zst.bak"),
        ("part_3b.csv.zst", "part_3b.csv"),
    ],
)
def test_file_id(spark, name, expected):
    assert column(spark, [name], "string", file_id) == [expected]

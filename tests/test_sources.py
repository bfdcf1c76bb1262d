import json

import pytest
from pyspark.sql import types as T

from awardlens.session import scratch_dir, session_conf
from awardlens.sources.schema_json import load_schema, schema_from_text, schema_metadata
from awardlens.sources.tables import csv_columns, read_plain_csv, write_csv
from awardlens.sources.vocabulary import bool_vocabulary, case_variations

SIMPLE = {
    "string": "string", "large_string": "string",
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint",
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
    "float16": "float", "float32": "float", "float": "float", "float64": "double", "double": "double",
    "bool": "boolean", "boolean": "boolean", "date32[day]": "date", "date64[ms]": "date",
    "timestamp[s]": "timestamp_ntz", "timestamp[ms]": "timestamp_ntz",
    "timestamp[us]": "timestamp_ntz", "timestamp[ns]": "timestamp_ntz",
    "binary": "binary", "large_binary": "binary",
}


def schema_of(*fields, **rest):
    return schema_from_text(json.dumps({"fields": list(fields), **rest}))


def test_simple_types():
    schema = schema_of(*({"name": f"c{i}", "type": name} for i, name in enumerate(SIMPLE)))
    assert [f.dataType.simpleString() for f in schema] == list(SIMPLE.values())
    assert all(f.nullable for f in schema)


def test_complex_types_and_metadata():
    schema = schema_of(
        {"name": "d", "type": {"type": "dictionary", "valueType": "string", "indexType": "int16", "ordered": True}},
        {"name": "l", "type": {"type": "list", "valueType": "int64"}},
        {"name": "s", "type": {"type": "struct", "fields": [{"name": "x", "type": {"type": "list", "valueType": "bool"}}]}},
        {"name": "n", "type": "uint8", "nullable": False, "metadata": {"width": 3}},
    )
    assert schema["d"].dataType == T.StringType()
    assert schema["d"].metadata["dictionary_index"] == "int16" and schema["d"].metadata["dictionary_ordered"]
    assert schema["l"].dataType == T.ArrayType(T.LongType())
    assert schema["s"].dataType.simpleString() == "struct<x:array<boolean>>"
    assert not schema["n"].nullable and schema["n"].metadata == {"width": "3", "declared": "uint8"}
    assert schema_metadata('{"fields": [], "metadata": {"version": 2}}') == {"version": "2"}


@pytest.mark.parametrize(
    "text",
    [
        "{",
        "[]",
        "{}",
        '{"fields": [{"type": "string"}]}',
        '{"fields": [{"name": "a"}]}',
        '{"fields": [{"name": "a", "type": "decimal"}]}',
        '{"fields": [{"name": "a", "type": 3}]}',
        '{"fields": [{"name": "a", "type": ["string"]}]}',
        '{"fields": [{"name": "a", "type": {"type": "dictionary"}}]}',
        '{"fields": [{"name": "a", "type": {"type": "dictionary", "valueType": "x"}}]}',
        '{"fields": [{"name": "a", "type": {"type": "list"}}]}',
        '{"fields": [{"name": "a", "type": {"type": "struct", "fields": []}}]}',
        '{"fields": [{"name": "a", "type": {"type": "map"}}]}',
        '{"fields": [{"name": "a", "type": {"valueType": "string"}}]}',
    ],
)
def test_schema_errors(text):
    with pytest.raises(ValueError):
        schema_from_text(text)


def test_schema_file(tmp_path):
    with pytest.raises(FileNotFoundError):
        load_schema(tmp_path / "none.json")
    (tmp_path / "s.json").write_text('{"fields": [{"name": "1862_college", "type": "bool"}]}')
    assert load_schema(tmp_path / "s.json").fieldNames() == ["1862_college"]


def test_vocabulary(tmp_path):
    assert case_variations("YeS") == {"yes", "YES", "Yes"}
    base = bool_vocabulary()
    assert len(base.true_words) == 13 and len(base.false_words) == 13  # t/T, y/Y, f/F, n/N
    labels = {
        "small": {"T": " Small business ", "F": "OTHER than small"},
        "multi": {"Y": "Yes indeed", "N": "Nope", "X": "?"},
        "text": "free",
        "veteran": {"Y": "Veteran", "N": 0},
    }
    (tmp_path / "d.json").write_text(json.dumps(labels))
    words = bool_vocabulary(tmp_path / "d.json")
    assert {"small business", "SMALL BUSINESS", "Small business", "veteran"} <= set(words.true_words)
    assert {"other than small", "Other than small", "0"} <= set(words.false_words)
    assert "Yes indeed" not in words.true_words


def test_unreadable_dictionary_falls_back_to_base_words(tmp_path):
    (tmp_path / "bad.json").write_text("{")
    assert bool_vocabulary(tmp_path / "bad.json") == bool_vocabulary()
    assert bool_vocabulary(tmp_path / "none.json") == bool_vocabulary()


def test_plain_csv(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    text = 'id,recipient_zip_4_code,amount,day,flag,note\n1,00123,1.5,2024-01-05,true,"a ""b"", c"\n2,,,,,NA\n'
    (tmp_path / "in.csv").write_text(text)
    assert csv_columns(spark, path)[:2] == ["id", "recipient_zip_4_code"]
    rows = read_plain_csv(spark, path)
    assert [kind for _, kind in rows.dtypes] == ["bigint", "string", "double", "string", "boolean", "string"]
    first, second = rows.orderBy("id").collect()
    assert first["recipient_zip_4_code"] == "00123" and first["note"] == 'a "b", c'
    assert second["note"] == "NA" and second["amount"] is None

    write_csv(rows, str(tmp_path / "out"), single_file=True)
    assert len(list((tmp_path / "out").glob("*.csv"))) == 1
    again = read_plain_csv(spark, str(tmp_path / "out"), schema=rows.schema)
    assert sorted(again.collect()) == sorted(rows.collect())


def test_settings_are_put_back(spark):
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    with session_conf(spark, {key: "7"}):
        assert spark.conf.get(key) == "7"
    assert spark.conf.get(key) == before


def test_scratch_folders_are_new_and_shared(spark):
    first, second = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert first != second
    base = spark.conf.get("spark.checkpoint.dir", None)
    assert base is None or first.startswith(base)


def test_csv_may_be_compressed(spark, tmp_path):
    rows = spark.createDataFrame([("a,\"b\"", 1), (None, 2), ("c", None)], "name string, n long")
    for kind, end in (("none", ".csv"), ("gzip", ".csv.gz")):
        path = str(tmp_path / kind)
        write_csv(rows, path, compression=kind)
        assert all(str(p).endswith(end) for p in (tmp_path / kind).glob("part-*"))
        assert sorted(map(str, read_plain_csv(spark, path).collect())) == sorted(map(str, rows.collect()))

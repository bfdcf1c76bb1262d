import io
from pathlib import Path

import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from awardlens import session
from awardlens.plans import ingest as plans_ingest
from awardlens.plans.ingest import ingest, read_outlay_drops
from awardlens.plans.outlays import outlay_report
from awardlens.sources import drops
from awardlens.functions.cleaning import NULL_TOKENS
from awardlens.sources.cells import infer_fields, type_cells
from awardlens.sources import drops
from awardlens.sources.drops import read_drops, rows_per_file, year_directories
from awardlens.sources.schema_json import schema_from_text
from awardlens.sources.tables import read_awards, write_awards
from awardlens.sources.vocabulary import Vocabulary, bool_vocabulary

SCHEMA = schema_from_text(
    """{"fields": [
    {"name": "key", "type": "string"}, {"name": "amount", "type": "double"},
    {"name": "code", "type": "uint16"}, {"name": "small", "type": "bool"},
    {"name": "day", "type": "date32[day]"}, {"name": "COVID-19_amount", "type": "float64"},
    {"name": "not_in_files", "type": "string"}]}"""
)
HEADER = "key,amount,code,small,day,COVID-19_amount"


def put(path, text, **options):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(zstandard.ZstdCompressor(**options).compress(text.encode()))


def put_wide_window(path, text):
    """One frame whose window is beyond what Spark's own reader accepts."""
    parameters = zstandard.ZstdCompressionParameters.from_level(3, window_log=28)
    path.parent.mkdir(parents=True, exist_ok=True)
    out = io.BytesIO()
    compressor = zstandard.ZstdCompressor(compression_params=parameters)
    with compressor.stream_writer(out, closefd=False) as writer:
        writer.write(text.encode())
    path.write_bytes(out.getvalue())


@pytest.fixture
def raw(tmp_path):
    root = tmp_path / "raw"
    put(
        root / "2023_awards" / "x_All_01.csv.zst",
        HEADER + '\na,1.5,7,T,2023-01-02,\nshort,1\n"q ""z"", y",N/A,NULL,no,,3\n\nlong,1,2,t,,4,5\nNA,2,3,,,\n',
    )
    # Another order of columns, one of them undeclared, and no part number in the name.
    put(root / "2024_awards" / "nofileno.csv.zst", "extra,amount,key\n10,4,b\n,5,c\n")
    put_wide_window(root / "2024_awards" / "w_2.csv.zst", HEADER + '\r\n"w ""1""",8,9,Yes,2024-02-03,1\r\nshort\r\n')
    return root


def scan(spark, root, years=("2023", "2024"), **options):
    return read_drops(spark, year_directories(years, root=str(root)), **options)


def test_rows_are_read_by_name_and_ragged_rows_left_out(spark, raw):
    drop = scan(spark, raw)
    got = {(r["year"], r["file"]): r["rows"] for r in rows_per_file(drop.rows).collect()}
    assert got == {("2023", "01"): 3, ("2024", "nofileno.csv"): 2, ("2024", "2"): 1}
    assert drop.rows.count() == 6
    keys = {r["key"]: r["amount"] for r in drop.rows.collect()}
    assert keys == {"a": "1.5", 'q "z", y': "N/A", "NA": "2", "b": "4", "c": "5", 'w "1"': "8"}
    windows = {r["path"].rsplit("/", 1)[-1]: r["window_bytes"] for r in drop.files.collect()}
    assert windows["w_2.csv.zst"] == 256 << 20


def test_ingest_types_cleans_and_partitions(spark, raw, tmp_path):
    output = str(tmp_path / "out")
    ingest(spark, ["2023", "2024"], output, SCHEMA, root=str(raw))
    rows = read_awards(spark, output)
    kinds = dict(rows.dtypes)
    assert kinds["amount"] == "double" and kinds["code"] == "int" and kinds["small"] == "boolean"
    assert kinds["day"] == "date" and kinds["extra"] == "bigint" and "not_in_files" not in kinds
    assert kinds["year"] == "string" and kinds["file"] == "string"
    got = {r["amount"]: r for r in rows.collect()}
    assert got[1.5]["file"] == "01" and got[1.5]["small"] is True and str(got[1.5]["day"]) == "2023-01-02"
    assert got[None]["small"] is False and got[None]["code"] is None and got[None]["COVID-19_amount"] == 3.0
    assert got[2.0]["key"] is None and got[4.0]["extra"] == 10 and got[8.0]["small"] is True
    assert (tmp_path / "out" / "year=2023" / "file=01").is_dir()
    assert read_awards(spark, output, ["COVID-19_amount", "file"]).columns == ["COVID-19_amount", "file"]
    assert sorted(map(str, read_awards(spark, output, schema=rows.schema).collect())) == sorted(
        map(str, rows.collect())
    )


def test_a_second_run_changes_nothing_and_leaves_other_partitions(spark, raw, tmp_path):
    output = str(tmp_path / "out")
    ingest(spark, ["2023", "2024"], output, SCHEMA, root=str(raw))
    before = sorted(map(str, read_awards(spark, output).collect()))
    ingest(spark, ["2023"], output, SCHEMA, root=str(raw))
    assert sorted(map(str, read_awards(spark, output).collect())) == before
    with pytest.raises(Exception, match="already exists"):
        ingest(spark, ["2023"], output, SCHEMA, root=str(raw), overwrite=False)


def test_missing_and_empty_directories_are_skipped(spark, raw, tmp_path):
    (raw / "2025_awards").mkdir()
    drop = scan(spark, raw, ["2023", "2025", "2026"])
    assert {r["year"] for r in drop.files.collect()} == {"2023"}
    nothing = scan(spark, raw, ["2025", "2026"])
    assert nothing.rows is None and nothing.files.count() == 0
    assert ingest(spark, ["2026"], str(tmp_path / "o"), SCHEMA, root=str(raw)).count() == 0


def test_years_and_directories_must_match():
    assert year_directories(["2023"]) == [("2023", "data/raw/2023_awards")]
    assert year_directories([2023], ["d"]) == [("2023", "d")]
    with pytest.raises(ValueError):
        year_directories(["2023", "2024"], ["d"])
    with pytest.raises(ValueError):
        year_directories(["2023", "2024"], ["d", "d"])


def test_a_broken_file_contributes_no_row(spark, raw):
    good = (raw / "2023_awards" / "x_All_01.csv.zst").read_bytes()
    big = HEADER + "\n" + "".join(f"k{i},{i * 7919 % 10007},1,t,,\n" for i in range(200_000))
    cut = zstandard.ZstdCompressor().compress(big.encode())
    (raw / "2023_awards" / "cut_5.csv.zst").write_bytes(cut[: len(cut) // 2])
    (raw / "2023_awards" / "junk_6.csv.zst").write_bytes(b"no zstd at all, just some text")
    (raw / "2023_awards" / "empty_7.csv.zst").write_bytes(zstandard.ZstdCompressor().compress(b""))
    put(raw / "2023_awards" / "twice_8.csv.zst", "a,a\n1,2\n")
    put(raw / "2023_awards" / "year_9.csv.zst", "year,key\n1,2\n")
    (raw / "2023_awards" / "more_10.csv.zst").write_bytes(good + good)
    drop = scan(spark, raw, ["2023"])
    got = {r["file"]: r["rows"] for r in rows_per_file(drop.rows).collect()}
    # Two frames in one file are both read; the second header line is an ordinary row.
    assert got == {"01": 3, "10": 7}
    errors = {r["path"].rsplit("/", 1)[-1] for r in drop.files.filter("error is not null").collect()}
    assert errors == {f"{n}.csv.zst" for n in ("cut_5", "junk_6", "empty_7", "twice_8", "year_9")}
    with pytest.raises(ValueError):
        scan(spark, raw, ["2023"], on_corrupt="fail")


def test_bad_values(spark, raw, tmp_path):
    put(raw / "2023_awards" / "bad_3.csv.zst", HEADER + "\nz,1,70000,t,,\n")
    put(raw / "2023_awards" / "bad_4.csv.zst", HEADER + "\nz,1,7,maybe,,\n")
    put(raw / "2023_awards" / "bad_5.csv.zst", HEADER + "\nz,1x,7,t,2023-1-1,\n")
    with pytest.raises(Exception, match="column (code|small|amount|day): not a"):
        ingest(spark, ["2023"], str(tmp_path / "a"), SCHEMA, root=str(raw), on_bad_value="fail")

    ingest(spark, ["2023"], str(tmp_path / "b"), SCHEMA, root=str(raw), on_bad_value="null")
    rows = {r["file"]: r for r in read_awards(spark, str(tmp_path / "b")).filter("key = 'z'").collect()}
    assert rows["3"]["code"] is None and rows["4"]["small"] is None
    assert rows["5"]["amount"] is None and rows["5"]["day"] is None and rows["5"]["code"] == 7

    report = ingest(spark, ["2023"], str(tmp_path / "c"), SCHEMA, root=str(raw), on_bad_value="skip_file")
    assert {r["file"] for r in read_awards(spark, str(tmp_path / "c")).select("file").distinct().collect()} == {"01"}
    assert report.filter("error = 'has a bad value'").count() == 3
    with pytest.raises(ValueError):
        ingest(spark, ["2023"], str(tmp_path / "d"), SCHEMA, root=str(raw), on_bad_value="ignore")


def test_vocabulary_from_a_dictionary_reaches_the_cells(spark, tmp_path):
    root = tmp_path / "raw"
    put(root / "2020_awards" / "x_1.csv.zst", "key,small\na,SMALL\nb,Other\n")
    (tmp_path / "dict.json").write_text('{"size": {"T": "small", "F": "other"}}')
    output = str(tmp_path / "o")
    ingest(spark, ["2020"], output, SCHEMA, root=str(root), data_dict=tmp_path / "dict.json")
    assert {r["key"]: r["small"] for r in read_awards(spark, output).collect()} == {"a": True, "b": False}


def test_lineage_columns_are_required(spark, tmp_path):
    with pytest.raises(ValueError, match="lineage"):
        write_awards(spark.range(1).withColumn("year", F.lit("1")), str(tmp_path / "o"))


def test_a_file_is_parsed_by_many_tasks(spark, tmp_path, monkeypatch):
    root = tmp_path / "raw"
    text = HEADER + "\n" + "".join(f'"k ""{i}""",{i},1,t,,\n\n' for i in range(5000)) + "short,row\n"
    put(root / "2020_awards" / "big_1.csv.zst", text)
    put(root / "2020_awards" / "tiny_2.csv.zst", HEADER + "\nz,1,1,t,,\n")
    plain = sorted(map(str, scan(spark, root, ["2020"]).rows.collect()))
    monkeypatch.setattr(drops, "TEXT_CHUNK", 4096)
    rows = scan(spark, root, ["2020"]).rows
    assert sorted(map(str, rows.collect())) == plain and len(plain) == 5001
    ingest(spark, ["2020"], str(tmp_path / "o"), SCHEMA, root=str(root))
    assert read_awards(spark, str(tmp_path / "o")).agg(F.sum("amount")).first()[0] == sum(range(5000)) + 1


def test_equal_bytes_give_equal_rows_in_one_chunk_and_in_many(spark, tmp_path, monkeypatch):
    lines = ["a,1", "x\ry,2", "\t", "", " ", "caf\u00e9,3", '"q, ""z""",4', "b,5\r", "c,6\r\n", "last,7"]
    put(tmp_path / "d" / "x_1.csv.zst", "\ufeffkey,amount\r\n" + "\n".join(lines))
    put(tmp_path / "d" / "one_3.csv.zst", "key\ra\r \r\r\nb\n\n")
    put_wide_window(tmp_path / "d" / "w_2.csv.zst", "key,amount\n" + "\n".join(lines) + "\n")
    latin = zstandard.ZstdCompressor().compress(b"key,amount\n" + b"x,1\n" * 5000 + b"caf\xe9,1\n")
    (tmp_path / "d" / "latin_4.csv.zst").write_bytes(latin)

    def read():
        drop = read_drops(spark, [("2001", str(tmp_path / "d"))])
        errors = {r["path"].rsplit("/", 1)[-1]: r["error"] for r in drop.files.collect() if r["error"]}
        return sorted((r["file"], r["key"], r["amount"]) for r in drop.rows.fillna("").collect()), errors

    once, errors = read()
    assert errors == {"latin_4.csv.zst": "not UTF-8 at byte 20014"}
    two = [("a", "1"), ("b", "5"), ("c", "6"), ("caf\u00e9", "3"), ("last", "7"), ('q, "z"', "4"), ("y", "2")]
    assert [row[1:] for row in once if row[0] == "1"] == two == [row[1:] for row in once if row[0] == "2"]
    assert [row[1] for row in once if row[0] == "3"] == [" ", "a", "b"]
    for size in (2, 7, 64, 1000):
        monkeypatch.setattr(drops, "TEXT_CHUNK", size)
        monkeypatch.setattr(drops, "PACKED_CHUNK", size)
        assert read() == (once, errors)


def test_a_bad_file_does_not_take_its_namesake_along(spark, tmp_path):
    root = tmp_path / "raw"
    put(root / "2020_awards" / "x_2.csv.zst", HEADER + "\nclean,1,1,t,,\n")
    put(root / "2020_awards" / "y_2.csv.zst", HEADER + "\nbad,1,70000,t,,\n")
    report = ingest(spark, ["2020"], str(tmp_path / "o"), SCHEMA, root=str(root))
    assert [r["key"] for r in read_awards(spark, str(tmp_path / "o")).collect()] == ["clean"]
    assert [r["path"].rsplit("/", 1)[-1] for r in report.filter("error is not null").collect()] == ["y_2.csv.zst"]


def test_ingest_leaves_nothing_but_its_report(spark, raw, tmp_path, monkeypatch):
    made = []
    scratch = session.scratch_dir
    for module in (session, plans_ingest):
        monkeypatch.setattr(
            module, "scratch_dir", lambda *a, **k: made.append(scratch(*a, **k)) or made[-1]
        )
    ingest(spark, ["2023", "2024"], str(tmp_path / "o"), SCHEMA, root=str(raw)).collect()
    left = [Path(path).name.split("-")[0] for path in made if Path(path).exists()]
    assert left == ["files"] and len(made) > 2


def test_cells_of_each_kind(spark):
    def read(kind, *cells):
        schema = schema_from_text('{"fields": [{"name": "c", "type": "%s"}]}' % kind)
        text = spark.createDataFrame([(cell,) for cell in cells], "c string")
        return [row[0] for row in type_cells(text, schema, bool_vocabulary(), "null").collect()]

    assert read("int32", " 12 ", "-3", "0x10", "+7", "12d", "1.0", "1e2") == [12, -3, 16] + [None] * 4
    assert read("uint8", "0xff", "-0x1", "256") == [255, None, None]
    assert read("double", "1e5", "Infinity", "-inf", ".5", "5.", " 2 ")[:5] == [1e5, float("inf"), float("-inf"), 0.5, 5.0]
    assert read("double", "12d", "0x1p3", "+1", "1f", "1,0", "") == [None] * 6
    assert [str(t) for t in read("timestamp[us]", "2020-01-02", "2020-01-02 03:04", "2020-01-02T03:04:05.5")] == [
        "2020-01-02 00:00:00", "2020-01-02 03:04:00", "2020-01-02 03:04:05.500000",
    ]
    assert read("timestamp[us]", "2020", "2020-01", "2020-01-02 03:04:05Z", "2020-01-02 03:04:05+01:00") == [None] * 4


def test_undeclared_columns_are_inferred(spark):
    rows = spark.createDataFrame(
        [("1", "t", "2024-01-02", "2024-01-02 03:04:05", "1e3", "x", None, "1"), ("2", "no", None, None, "2", "1", None, "a")],
        "i string, b string, d string, t string, f string, s string, n string, m string",
    )
    fields = infer_fields(rows, rows.columns, bool_vocabulary())
    assert [f.dataType.simpleString() for f in fields] == [
        "bigint", "boolean", "date", "timestamp_ntz", "double", "string", "string", "string",
    ]


def test_every_declared_type_is_read_from_text(spark):
    kinds = {
        "int8": "-128", "int16": "5", "int32": "5", "int64": "5", "uint8": "255", "uint32": "4294967295",
        "uint64": "18446744073709551615", "float16": "0.5", "float": "0.5", "double": "1e3",
        "timestamp[ns]": "2024-01-02 03:04:05", "date64[ms]": "2024-01-02", "binary": "ab", "string": " s ",
    }
    entries = ", ".join(f'{{"name": "{k}", "type": "{k}"}}' for k in kinds)
    schema = schema_from_text('{"fields": [' + entries + "]}")
    text = spark.createDataFrame([tuple(kinds.values())], list(kinds))
    row = type_cells(text, schema, bool_vocabulary()).first()
    assert row["int8"] == -128 and row["uint8"] == 255 and row["uint32"] == 4294967295
    assert int(row["uint64"]) == 2**64 - 1 and row["binary"] == bytearray(b"ab") and row["string"] == " s "
    over = spark.createDataFrame([("256", "-1", "18446744073709551616", "1.5")], ["uint8", "uint32", "uint64", "int64"])
    assert tuple(type_cells(over, schema, bool_vocabulary(), "null").first()) == (None,) * 4
    nested = schema_from_text('{"fields": [{"name": "l", "type": {"type": "list", "valueType": "string"}}]}')
    with pytest.raises(ValueError):
        type_cells(spark.createDataFrame([("x",)], "l string"), nested, bool_vocabulary())


def test_a_row_as_wide_as_the_real_schema(spark, tmp_path):
    kinds = ["string", "double", "bool", "int64", "date32[day]"]
    names = [f"column-{i}" for i in range(297)]
    entries = ", ".join(f'{{"name": "{n}", "type": "{kinds[i % 5]}"}}' for i, n in enumerate(names))
    cells = ["text", "1.5", "Yes", "7", "2024-01-02"]
    root = tmp_path / "raw"
    lines = "\n".join(",".join(cells[i % 5] if (i + r) % 3 else "" for i in range(297)) for r in range(50))
    for year in range(2001, 2009):
        put(root / f"{year}_awards" / "x_1.csv.zst", ",".join(names) + "\n" + lines + "\n")
    output = str(tmp_path / "o")
    ingest(spark, range(2001, 2009), output, schema_from_text('{"fields": [' + entries + "]}"), root=str(root))
    rows = read_awards(spark, output)
    assert rows.count() == 400 and len(rows.columns) == 299


def test_missing_cells_are_null_in_every_type(spark):
    kinds = ["string", "double", "int64", "bool", "date32[day]", "binary", "uint64"]
    entries = ", ".join(f'{{"name": "{k}", "type": "{k}"}}' for k in kinds)
    schema = schema_from_text('{"fields": [' + entries + "]}")
    # A dictionary may use a missing-cell spelling as a label; the cell is missing all the same.
    words = Vocabulary(["t"], ["f", "N/A"])
    text = spark.createDataFrame([(token,) * len(kinds) for token in NULL_TOKENS], kinds)
    for mode in ("fail", "null", "flag"):
        got = type_cells(text, schema, words, mode).drop("_bad_values").distinct().collect()
        assert [tuple(r) for r in got] == [(None,) * len(kinds)]
    assert type_cells(text, schema, words, "flag").filter("_bad_values").count() == 0
    passing = spark.createDataFrame([("a NA", "NA")], "string string, other string")
    assert tuple(type_cells(passing, schema, words).first()) == ("a NA", "NA")


def test_outlay_drops(spark, tmp_path):
    root = tmp_path / "raw"
    header = (
        "other,period_of_performance_current_end_date,total_outlayed_amount_for_overall_award,"
        "current_total_value_of_award,potential_total_value_of_award,total_dollars_obligated"
    )
    put(root / "2024_awards" / "a_1.csv.zst", header + "\nx,2024-05-01,2000000,1,3000000,5\ny,bad\nz,,1,1,1,1\n")
    put(root / "2024_awards" / "b_2.csv.zst", "other,total_dollars_obligated\nx,1\n")
    (root / "2024_awards" / "c_3.csv.zst").write_bytes(b"junk")
    drop, awards = read_outlay_drops(spark, year_directories(["2024"], root=str(root)))
    row = outlay_report(awards).first()
    assert row["total_rows"] == 2 and row["result_rows"] == 1 and row["total_obligated"] == 5.0
    assert drop.files.filter("error is not null").count() == 2
    assert read_outlay_drops(spark, [("2030", str(root / "none"))])[1] is None


def test_paths_with_blanks_and_plus_signs(spark, tmp_path):
    put(tmp_path / "my raw" / "d+1" / "a b+c_x.csv.zst", "key\n1\n")
    put_wide_window(tmp_path / "my raw" / "d+1" / "w %41_4.csv.zst", "key\n2\n")
    drop = read_drops(spark, [("2001", str(tmp_path / "my raw" / "d+1"))])
    got = {(r["year"], r["file"]): r["key"] for r in drop.rows.collect()}
    assert got == {("2001", "a b+c_x.csv"): "1", ("2001", "4"): "2"}


def test_windows_beyond_the_limit_are_reported(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(drops, "MAX_WINDOW", 64 << 20)
    put_wide_window(tmp_path / "d" / "w_1.csv.zst", "key\n1\n")
    drop = read_drops(spark, [("2001", str(tmp_path / "d"))])
    assert drop.rows is None and "ZstdError" in drop.files.first()["error"]


def test_only_lines_with_a_quote_need_the_parser(spark):
    text = "\ufeffa, b \r\n,\n\nx\ny,z,\n1,#2\r \t,'q'\r\"a,b\",c\n\"a\"\"b\",\n\"open,1\nlast\0,1"
    expected = [("\ufeffa", " b "), (None, None), ("1", "#2"), (" \t", "'q'"), ("a,b", "c"), ('a"b', None), ("last\0", "1")]
    header = ["k", "v"]
    chunks = spark.createDataFrame(
        [(drops.layout_of(header), "2001", "u", text)], "layout string, year string, uri string, text string"
    )
    rows = drops._parse(chunks, header)
    assert sorted(map(str, (tuple(row)[:2] for row in rows.collect()))) == sorted(map(str, expected))


def test_staged_text_lies_in_small_groups_and_pages(spark, tmp_path):
    """To write or read a group takes memory of its size, however long the file of a task is."""
    line = F.concat_ws(",", *(F.sha2(F.concat(F.col("id").cast("string"), F.lit(end)), 512) for end in "ab"))
    lines = "\n".join(row[0] for row in spark.range(150_000).select(line).collect())
    put(tmp_path / "d" / "x_1.csv.zst", f"key,amount\n{lines}\n", level=1)
    files, chunks = drops.unpack(drops.list_drop(spark, str(tmp_path / "d")).withColumn("year", F.lit("2001")))
    assert files.first()["rows_read"] == 150_000
    assert drops.read_drops(spark, [("2001", str(tmp_path / "d"))]).rows.count() == 150_000
    text = chunks.filter(F.col("layout") == drops.layout_of(["key", "amount"]))
    assert text.agg(F.max(F.length("text"))).first()[0] <= 1 << 20
    groups = []
    for file in text.inputFiles():
        about = pq.ParquetFile(file.removeprefix("file://")).metadata
        groups += [about.row_group(at).total_byte_size for at in range(about.num_row_groups)]
    assert sum(groups) > 30 << 20 and max(groups) < 20 << 20

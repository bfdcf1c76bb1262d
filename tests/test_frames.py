"""Frames of packed files, runs of frames, and what is written of them."""

import io
import os
import random
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from awardlens.plans.ingest import ingest
from awardlens.plans.outlays import throughput
from awardlens.session import session_conf
from awardlens.sources import drops, frames
from awardlens.sources.drops import RANGE_BYTES, read_drops, run_tasks
from awardlens.sources.schema_json import schema_from_text
from awardlens.sources.tables import read_awards

HEADER = "key,amount\n"
SCHEMA = schema_from_text('{"fields": [{"name": "key", "type": "string"}, {"name": "amount", "type": "double"}]}')


def packed(data, sizes, rng=None, seekable=False):
    """Frames of the given sizes of text, with and without checksum and content size."""
    out, table, at = [], [], 0
    for k, size in enumerate([*sizes, len(data)]):
        part, at = data[at : at + size], at + size
        if not part and k:
            break
        compressor = zstandard.ZstdCompressor(write_checksum=bool(k % 2), write_content_size=bool(k % 3))
        out.append(compressor.compress(part))
        table.append((len(out[-1]), len(part)))
        if rng and rng.random() < 0.3:
            out.append(struct.pack("<II", frames.SKIPPABLE + k % 16, 5) + b"extra")
            table.append((len(out[-1]), 0))
    if seekable:
        entries = b"".join(struct.pack("<II", *entry) for entry in table)
        body = entries + struct.pack("<IBI", len(table), 0, frames.SEEK_FOOTER)
        out.append(struct.pack("<II", frames.SEEK_TABLE, len(body)) + body)
    return out


def offsets(parts):
    at, out = 0, []
    for part in parts:
        out.append((at, len(part)))
        at += len(part)
    return out


def test_frames_are_found_by_their_headers():
    rng = random.Random(1)
    data = bytes(rng.choices(b"abcdef\n", k=2_000_000)) + b"\0" * 600_000 + rng.randbytes(300_000)
    for sizes in ([], [1], [10, 0, 500_000, 1_000_000], [1000] * 300):
        parts = packed(data, sizes, rng)
        assert list(frames.walk_frames(io.BytesIO(b"".join(parts)))) == offsets(parts)
    assert list(frames.walk_frames(io.BytesIO(b""))) == []
    whole = b"".join(packed(data, [500_000]))
    for cut in (1, 7, 17, 100_000, len(whole) - 1):
        with pytest.raises(frames.NoFrame, match="ends inside"):
            list(frames.walk_frames(io.BytesIO(whole[:cut])))
    with pytest.raises(frames.NoFrame, match="no zstd frame"):
        list(frames.walk_frames(io.BytesIO(whole + b"some more text behind it")))


def test_frames_are_found_by_the_seek_table():
    data = os.urandom(50_000)
    parts = packed(data, [20_000, 20_000], seekable=True)
    whole = b"".join(parts)
    assert frames.seek_table(io.BytesIO(whole), len(whole)) == offsets(parts)
    assert list(frames.walk_frames(io.BytesIO(whole))) == offsets(parts)
    assert frames.seek_table(io.BytesIO(whole[9:]), len(whole) - 9) is None  # does not add up
    plain = b"".join(packed(data, []))
    assert frames.seek_table(io.BytesIO(plain), len(plain)) is None
    assert frames.seek_table(io.BytesIO(b"short"), 5) is None


def test_runs_of_frames():
    found = [(0, 10), (10, 10), (20, 30), (50, 5)]
    assert frames.runs_of(found, 1) == found
    assert frames.runs_of(found, 20) == [(0, 20), (20, 30), (50, 5)]
    assert frames.runs_of(found, 1, least=15) == [(0, 20), (20, 30), (50, 5)]
    assert frames.runs_of(found, 1000) == [(0, 55)] and frames.runs_of([], 5) == []


def text_of(rng, lines):
    ends = ["\n", "\r\n", "\r", "\n\n"]
    cells = ["a", "é漢😀", '"q, ""z"""', "x" * 300, ""]
    rows = [f"{rng.choice(cells)}{k},{rng.choice(['1', '2.5', '', '3,4'])}{rng.choice(ends)}" for k in range(lines)]
    return (HEADER + "".join(rows)).encode()


def read(spark, folder, **options):
    drop = read_drops(spark, [("2001", str(folder))], **options)
    rows = sorted(map(str, drop.rows.collect())) if drop.rows is not None else None
    files = {r["path"].rsplit("/", 1)[-1]: (r["error"], r["rows_read"], r["window_bytes"]) for r in drop.files.collect()}
    return rows, files


@pytest.mark.parametrize("chunk", [drops.TEXT_CHUNK, 50])
def test_runs_give_the_same_rows_as_whole_files(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(drops, "TEXT_CHUNK", chunk)
    monkeypatch.setattr(drops, "PACKED_CHUNK", 64)
    rng = random.Random(7)
    for k in range(4):
        text = text_of(rng, 150)
        sizes = [rng.choice([1, 2, 3, 20, 300]) for _ in range(60)]
        (tmp_path / f"x_{k}.csv.zst").write_bytes(b"".join(packed(text, sizes, rng, seekable=k == 3)))
    (tmp_path / "one_8.csv.zst").write_bytes(b"".join(packed(text_of(rng, 400), [])))
    (tmp_path / "long_9.csv.zst").write_bytes(b"".join(packed(HEADER.encode() + b"k" * 5000 + b",1", [40] * 100)))
    rows, files = read(spark, tmp_path)
    assert not any(error for error, _, _ in files.values()) and len(rows) > 500
    for size in (1, 100, 2000):
        assert read(spark, tmp_path, range_bytes=size) == (rows, files)


def test_one_file_is_unpacked_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(drops, "PACKED_CHUNK", 64)  # else the first run takes in all of so small a file
    text = text_of(random.Random(3), 4000)
    (tmp_path / "x_1.csv.zst").write_bytes(b"".join(packed(text, [len(text) // 8 + 1] * 8)))
    drop = read_drops(spark, [("2001", str(tmp_path))], range_bytes=1)
    chunks = drop.rows.inputFiles()
    assert len([f for f in chunks if drops.layout_of(["key", "amount"]) in f]) >= 6


def test_a_bad_frame_keeps_the_whole_file_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(drops, "PACKED_CHUNK", 64)
    text = text_of(random.Random(5), 500)
    parts = packed(text, [len(text) // 5] * 4)
    spoilt = bytearray(parts[2])
    spoilt[len(spoilt) // 2] ^= 0xFF
    parts_bad = [*parts[:1], parts[1], bytes(spoilt), *parts[3:]]
    (tmp_path / "bad_1.csv.zst").write_bytes(b"".join(parts_bad))
    (tmp_path / "good_2.csv.zst").write_bytes(b"".join(parts))
    (tmp_path / "cut_3.csv.zst").write_bytes(b"".join(parts)[:-5])
    (tmp_path / "junk_4.csv.zst").write_bytes(b"no zstd at all, but a text of some length" * 5)
    latin = text + b"caf\xe9,1\n" + text[len(HEADER) :]
    (tmp_path / "latin_5.csv.zst").write_bytes(b"".join(packed(latin, [len(text) // 5] * 9)))
    # The first run may take in the frame behind it, for the header was read in steps.
    seam = packed(text, [len(text) // 2]) + packed(b"x,1\ncaf", []) + packed(b"\xe9,1\nx,2\n", [])
    (tmp_path / "seam_6.csv.zst").write_bytes(b"".join(seam))
    drop = read_drops(spark, [("2001", str(tmp_path))], range_bytes=1)
    assert {r["file"] for r in drop.rows.select("file").distinct().collect()} == {"2"}
    errors = {r["path"].rsplit("_", 1)[-1][0]: r["error"] for r in drop.files.collect()}
    assert errors.pop("2") is None and all(errors.values()) and len(errors) == 5
    assert "not UTF-8" in errors["5"] and "meet" in errors["6"] and "ends inside" in errors["3"]
    with pytest.raises(ValueError):
        read_drops(spark, [("2001", str(tmp_path))], on_corrupt="fail", range_bytes=1)


def last_write_plan(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    plans = [runs.apply(k).physicalPlanDescription() for k in range(runs.size())]
    return next(plan for plan in reversed(plans) if "WriteFiles" in plan)


def test_text_is_staged_without_a_sort(spark, tmp_path):
    (tmp_path / "x_1.csv.zst").write_bytes(b"".join(packed(text_of(random.Random(1), 50), [])))
    read_drops(spark, [("2001", str(tmp_path))])
    plan = last_write_plan(spark)
    assert "MapInArrow" in plan and "Sort" not in plan


def test_ledger_of_an_ingest(spark, tmp_path):
    folder = tmp_path / "2001_awards"
    folder.mkdir()
    put = lambda name, text: (folder / name).write_bytes(zstandard.compress((HEADER + text).encode()))
    put("a_1.csv.zst", "x,1\n\nshort\ny,2\nlong,1,2\n")
    put("b_2.csv.zst", "x,no number\ny,1\n")
    put("c_3.csv.zst", "x,1\n")
    put("d_3.csv.zst", "x,1\ny,2\nshort\n")
    (folder / "e_4.csv.zst").write_bytes(b"junk")
    put("f_5.csv.zst", "")

    def ledger(**options):
        output = str(tmp_path / f"out-{len(list(tmp_path.iterdir()))}")
        report = ingest(spark, ["2001"], output, SCHEMA, root=str(tmp_path), **options)
        rows = {r["path"].rsplit("/", 1)[-1][0]: (r["rows_read"], r["rows_kept"], r["rows_skipped"]) for r in report.collect()}
        assert read_awards(spark, output).count() == sum(kept for _, kept, _ in rows.values())
        return rows

    common = {"a": (4, 2, 2), "c": (1, 1, 0), "d": (3, 2, 1), "e": (None, 0, None), "f": (0, 0, 0)}
    assert ledger() == common | {"b": (2, 0, 2)}
    assert ledger(on_bad_value="null") == common | {"b": (2, 2, 0)}
    assert ledger(on_bad_value="null", atomic=True) == common | {"b": (2, 2, 0)}


def test_throughput_of_a_drop(spark, tmp_path):
    (tmp_path / "x_1.csv.zst").write_bytes(zstandard.compress((HEADER + "a,1\nb,2\n").encode()))
    (tmp_path / "y_2.csv.zst").write_bytes(b"junk")
    files = read_drops(spark, [("2001", str(tmp_path))]).files
    size = sum(f.stat().st_size for f in tmp_path.iterdir())
    row = throughput(files, 0.5).first()
    assert (row["files"], row["broken_files"], row["rows_read"], row["packed_bytes"]) == (2, 1, 2, size)
    assert row["rows_per_second"] == 4 and row["bytes_per_second"] == 2 * size
    assert throughput(files, 0.0).first()["rows_per_second"] is None
    none = throughput(files.filter(F.lit(False)), 1.0).first()
    assert none["rows_read"] == 0 and none["bytes_per_second"] == 0


def test_short_runs_share_tasks(spark):
    runs = spark.range(5000).select(F.lit(10_000).cast("long").alias("length"))
    few = run_tasks(runs, 10_000)
    assert few == 4 * spark.sparkContext.defaultParallelism
    assert run_tasks(spark.range(3).select(F.lit(RANGE_BYTES).alias("length")), RANGE_BYTES) == 3
    large = spark.range(500).select(F.lit(RANGE_BYTES).cast("long").alias("length"))
    assert run_tasks(large, RANGE_BYTES) == 500


@pytest.mark.parametrize("text", [b"", b"\n", b"a", b"a\n", b"a\nb", b"\na\n", b"a\n\nb\n", b"a\r\nb", b"a\rb\r", b"\n\n"])
def test_lines_are_counted(text):
    assert drops._lines_in(text) == len([line for line in text.replace(b"\r", b"\n").split(b"\n") if line])


def test_text_is_not_shuffled_for_a_broken_file(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"x_{k}.csv.zst").write_bytes(b"".join(packed(text_of(random.Random(k), 3000), [])))
    (tmp_path / "cut_4.csv.zst").write_bytes((tmp_path / "x_0.csv.zst").read_bytes()[:-9])
    with session_conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "2000"}):
        drop = read_drops(spark, [("2001", str(tmp_path))])
        plan = drop.located._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {row[0] for row in drop.rows.select("file").distinct().collect()} == {"0", "1", "2"}

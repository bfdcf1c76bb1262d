"""Yearly drops of zstd-compressed CSV files.

A drop is a directory of ``*.zst`` files. One job unpacks every file once: it checks the
header, that the file is intact and that it is UTF-8, counts its rows, and writes the text to
the shared scratch folder in chunks that end at a line end. What is left of a compressed
file's shape ends there: its chunks are dealt to tasks in proportion to their length, and
split into lines and cells by Spark. All files go this way, so equal bytes give equal rows.

A file of up to ``RANGE_BYTES`` is unpacked by one task. Of a larger one the frames are
looked up first, and runs of frames are unpacked by as many tasks; the lines that are cut
where two runs meet are put together afterwards. A large file of one frame is one run.

Files with equal headers are parsed together, by name, so drops may differ in columns and
order. A file that turns out broken takes its chunks with it, whatever was written before.
"""

import csv
import hashlib
import io
import logging
import math
import re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import uri_file_id, uri_name
from ..operators.keys import union_widened
from ..session import measured, staged
from .frames import runs_of, seek_table, walk_frames

log = logging.getLogger(__name__)

# Fixed value: the largest compression window that is accepted.
MAX_WINDOW = 2 << 30

PACKED_CHUNK = 16 << 10
# Packed bytes that one task unpacks; files up to this size are not looked into before.
RANGE_BYTES = 64 << 20
# Unpacked text is handed on in chunks of about this many bytes, cut at line ends.
TEXT_CHUNK = 256 << 10
# Staged text is long in a row: sizes are looked at after each one, not after a hundred as Parquet
# does, and groups are small, since Spark holds the text of a whole group at once to read it.
TEXT_FILES = {
    "parquet.block.size": str(16 << 20),
    "parquet.block.size.row.check.min": "1",
    "parquet.page.size.row.check.min": "1",
}

YEAR, FILE = "year", "file"
LINEAGE = [YEAR, FILE]
ROW_BAD, FILE_URI = "_bad_row", "_file_uri"

FILES_SCHEMA = (
    "year string, path string, uri string, length long,"
    "window_bytes long, header array<string>, error string, rows_read long"
)
# One table for all results of unpacking: a row per file in the layout "files", one per run of
# frames in "runs", cut lines in "seams", and the text of a file in the layout of its header.
FILE_COLUMNS = [part.split()[0] for part in FILES_SCHEMA.replace(",", ", ").split(", ")]
FILES_LAYOUT, RUNS_LAYOUT, SEAMS_LAYOUT = "files", "runs", "seams"
UNPACKED_SCHEMA = f"layout string, {FILES_SCHEMA}, text string, run int, seam int, raw binary"
UNPACKED_ARROW = pa.schema(
    [
        ("layout", pa.string()),
        ("year", pa.string()),
        ("path", pa.string()),
        ("uri", pa.string()),
        ("length", pa.int64()),
        ("window_bytes", pa.int64()),
        ("header", pa.list_(pa.string())),
        ("error", pa.string()),
        ("rows_read", pa.int64()),
        ("text", pa.string()),
        ("run", pa.int32()),
        ("seam", pa.int32()),
        ("raw", pa.binary()),
    ]
)
RANGES_SCHEMA = f"{FILES_SCHEMA}, skip long, ranges array<struct<offset: long, length: long>>"
RANGES_ARROW = pa.schema(
    [
        *(field for field in UNPACKED_ARROW if field.name in FILE_COLUMNS),
        ("skip", pa.int64()),
        ("ranges", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))),
    ]
)

# Tasks get the functions below by value, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def year_directories(
    years: Sequence[str], dirs: Sequence[str] | None = None, root: str = "data/raw"
) -> list[tuple[str, str]]:
    """Pair each year with its directory, by default ``<root>/<year>_awards``."""
    years = [str(year) for year in years]
    if dirs:
        if len(dirs) != len(years):
            raise ValueError(f"{len(years)} years but {len(dirs)} directories")
        if len(set(map(str, dirs))) < len(dirs):
            raise ValueError("a directory is given for two years")
        return list(zip(years, map(str, dirs)))
    return [(year, f"{root.rstrip('/')}/{year}_awards") for year in years]


def list_drop(spark: SparkSession, directory: str, pattern: str = "*.zst") -> DataFrame | None:
    """(path, uri, length) of the directory's files; None when it does not exist."""
    try:
        # Only names and lengths are selected, so no content is read.
        files = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", pattern)
            .load(directory)
            .select("path", F.input_file_name().alias("uri"), "length")
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("directory %s does not exist, skipped", directory)
        return None
    return files


def _located(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class _Decompressed(io.RawIOBase):
    """The decompressed bytes of a file on any file system Arrow knows, or of a run of frames.

    All frames are read, and a file that ends inside a frame is an error.
    """

    def __init__(self, uri: str, offset: int = 0, length: int | None = None):
        import zstandard

        system, name = _located(uri)
        self.window, self.taken, self._left = None, 0, length
        if length is None:
            with system.open_input_stream(name, compression=None) as start:
                self.window = zstandard.get_frame_parameters(start.read(18)).window_size
            self._source = system.open_input_stream(name, compression=None)
        else:
            self._source = system.open_input_file(name)
            self._source.seek(offset)
        self._decompressor = zstandard.ZstdDecompressor(max_window_size=MAX_WINDOW)
        self._frame = None
        self._pending = b""

    def readable(self):
        return True

    def readinto(self, buffer):
        while not self._pending:
            size = PACKED_CHUNK if self._left is None else min(PACKED_CHUNK, self._left - self.taken)
            packed = self._source.read(size) if size else b""
            self.taken += len(packed)
            if not packed:
                if self._frame is not None:
                    raise EOFError("file ends inside a compressed frame")
                return 0
            self._pending = self._unpack(packed)
        n = min(len(buffer), len(self._pending))
        buffer[:n] = self._pending[:n]
        self._pending = self._pending[n:]
        return n

    def _unpack(self, packed: bytes) -> memoryview:
        parts = []
        while packed:
            if self._frame is None:
                self._frame = self._decompressor.decompressobj()
            parts.append(self._frame.decompress(packed))
            packed = b""
            if self._frame.eof:
                packed, self._frame = self._frame.unused_data, None
        return memoryview(b"".join(parts))


def layout_of(header: Sequence[str]) -> str:
    """Name of the folder that holds the text of the files with this header."""
    return hashlib.sha1("\0".join(header).encode()).hexdigest()


_LINE_END = re.compile(b"[\r\n]")


def _first_line(source: io.RawIOBase) -> tuple[bytes, bytes]:
    """The bytes up to the first line end, and those read beyond it."""
    data = b""
    while True:
        more = source.read(PACKED_CHUNK)
        data += more or b""
        end = _LINE_END.search(data)
        if end:
            return data[: end.start()], data[end.end() :]
        if not more:
            return data, b""


def _header(line: bytes, required: Sequence[str]) -> tuple[list[str], str | None]:
    header = next(csv.reader([line.decode("utf-8-sig")]), [])
    lacking = [name for name in required if name not in header]
    if not header:
        return header, "no header line"
    if len(set(header)) < len(header):
        return header, "repeated column name"
    if lacking:
        return header, f"lacks {', '.join(lacking)}"
    if set(header) & set(LINEAGE):
        return header, "has its own year or file column"
    return header, None


_LINE = re.compile(b"[^\r\n]+")


def _lines_in(text: bytes) -> int:
    """Lines that are not empty. Counting line ends will do where none of them can be empty."""
    if b"\r" in text or b"\n\n" in text or text[:1] == b"\n":
        return len(_LINE.findall(text))
    return text.count(b"\n") + (text[-1:] not in (b"", b"\n"))


def _chunks(source: io.RawIOBase, held: bytes) -> Iterator[tuple[bytes, bool]]:
    """The text in chunks that end at a line end, and at last what is left."""
    more = True
    while more:
        more = source.read(TEXT_CHUNK)
        held += more or b""
        # A line end of two bytes may be cut: that makes an empty line, which is none.
        end = max(held.rfind(b"\n"), held.rfind(b"\r")) + 1
        if end and (not more or end >= TEXT_CHUNK // 2):
            yield held[:end], False
            held = held[end:]
    yield held, True


def _opened(file: dict, required: Sequence[str]) -> tuple[dict, "_Decompressed", bytes, int]:
    """What the start of a file tells: the file's row, its text behind the header, its place."""
    source = _Decompressed(file["uri"])
    line, held = _first_line(source)
    found = {"window_bytes": source.window}
    found["header"], found["error"] = _header(line, required)
    return found, source, held, len(line) + 1


def _unpack(file: dict, required: Sequence[str]) -> Iterator[dict]:
    """Rows of the unpacked table: chunks of text, and at the end the file itself."""
    found, offset, rows = {"window_bytes": None, "header": None, "error": None}, 0, 0
    try:
        found, source, held, offset = _opened(file, required)
        if not found["error"]:
            here = {"layout": layout_of(found["header"]), "year": file["year"], "uri": file["uri"]}
            for chunk, _ in _chunks(source, held):
                rows += _lines_in(chunk)
                if chunk:
                    yield here | {"text": chunk.decode("utf-8")}
                offset += len(chunk)
    except UnicodeDecodeError as error:
        found["error"] = f"not UTF-8 at byte {offset + error.start}"
    except Exception as error:  # reported with the file; the caller decides what follows
        found["error"] = f"{type(error).__name__}: {error}"
    yield file | found | {"layout": FILES_LAYOUT, "rows_read": None if found["error"] else rows}


def _look_up(file: dict, required: Sequence[str], range_bytes: int) -> dict:
    """The row of a large file, with the runs of frames to unpack."""
    found, runs, skip = {"window_bytes": None, "header": None, "error": None}, [], 0
    try:
        found, source, _, skip = _opened(file, required)
        if not found["error"]:
            system, name = _located(file["uri"])
            with system.open_input_file(name) as whole:
                places = seek_table(whole, file["length"])
            if places is None:
                with system.open_input_stream(name, compression=None) as packed:
                    places = list(walk_frames(packed))
            # The header must end in the first run.
            runs = runs_of(places, range_bytes, source.taken)
    except Exception as error:  # reported with the file
        found["error"] = f"{type(error).__name__}: {error}"
    runs = [{"offset": offset, "length": length} for offset, length in runs]
    return file | found | {"rows_read": None, "skip": skip, "ranges": runs}


def _unpack_run(run: dict) -> Iterator[dict]:
    """Chunks of whole lines of a run of frames, what is cut at its ends, and a row for it.

    The line that reaches into the run from before, up to its line end, belongs to the seam
    with the run's number, and the line that reaches out of it to the next. A run without a
    line end is a piece of the seam as a whole. Pieces are bytes: a seam may cut a character.
    """
    here = {"year": run["year"], "uri": run["uri"], "run": run["run"]}
    text = here | {"layout": run["layout"]}
    rows, error, ends, first = 0, None, False, run["run"] == 0
    try:
        source = _Decompressed(run["uri"], run["offset"], run["length"])
        held = b""
        if first:
            while len(held) < run["skip"] and (more := source.read(TEXT_CHUNK)):
                held += more
            held = held[run["skip"] :]
        for chunk, last in _chunks(source, held):
            if not first and not last and not ends:
                cut = _LINE_END.search(chunk).end()
                yield here | {"layout": SEAMS_LAYOUT, "seam": 0, "raw": chunk[:cut]}
                chunk = chunk[cut:]
            if last:
                seam = 1 if ends or first else 0
                yield here | {"layout": SEAMS_LAYOUT, "seam": seam, "raw": chunk}
            else:
                ends = True
                rows += _lines_in(chunk)
                if chunk:
                    yield text | {"text": chunk.decode("utf-8")}
    except UnicodeDecodeError:
        error = f"not UTF-8 in the frames at packed byte {run['offset']}"
    except Exception as problem:  # reported with the file
        error = f"{type(problem).__name__}: {problem}"
    yield here | {"layout": RUNS_LAYOUT, "error": error, "rows_read": rows, "seam": int(ends or first)}


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``TEXT_CHUNK`` bytes of text or 1,000 rows."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("text") or row.get("raw") or "")
        if size >= TEXT_CHUNK or len(held) >= 1000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def run_tasks(runs: DataFrame, range_bytes: int) -> int:
    """Tasks that unpack the runs: one each where they are large, else as many as their bytes are worth.

    A few for every core at least, so that short runs are dealt evenly too.
    """
    number, packed = runs.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    worth = math.ceil(packed / max(range_bytes, RANGE_BYTES))
    return max(1, min(number, max(4 * runs.sparkSession.sparkContext.defaultParallelism, worth)))


def unpack(
    files: DataFrame, required: Sequence[str] = (), range_bytes: int = RANGE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """A row per file, and the files' text in chunks by layout, staged in the scratch folder."""
    total, longest = files.agg(F.coalesce(F.sum("length"), F.lit(0)), F.max("length")).first()
    # Listings come in more partitions than so many bytes are worth.
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, total // range_bytes)
    whole = files.filter(F.col("length") <= range_bytes).coalesce(tasks)
    large = files.filter(F.col("length") > range_bytes)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for file in batch.to_pylist() for row in _unpack(file, required))
        yield from _batched(rows, UNPACKED_ARROW)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (_look_up(file, required, range_bytes) for batch in batches for file in batch.to_pylist())
        yield from _batched(rows, RANGES_ARROW)

    def run_unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for run in batch.to_pylist() for row in _unpack_run(run))
        yield from _batched(rows, UNPACKED_ARROW)

    rows = whole.mapInArrow(unpacked, UNPACKED_SCHEMA)
    if longest is None or longest <= range_bytes:
        table = staged(rows, "drops", partition_by=["layout"], options=TEXT_FILES)
        return table.filter(F.col("layout") == FILES_LAYOUT).select(*FILE_COLUMNS), table

    index = staged(large.mapInArrow(looked_up, RANGES_SCHEMA), "frames")
    named = F.sha1(F.array_join("header", "\0").cast("binary"))
    runs = index.filter(F.col("error").isNull()).select(
        "year", "uri", named.alias("layout"), "skip", F.posexplode("ranges").alias("run", "range")
    ).select("year", "uri", "layout", "skip", "run", "range.offset", "range.length")
    dealt = runs.repartitionByRange(run_tasks(runs, range_bytes), "uri", "run")
    rows = rows.unionByName(dealt.mapInArrow(run_unpacked, UNPACKED_SCHEMA))
    table = staged(rows, "drops", partition_by=["layout"], options=TEXT_FILES)

    seams = staged(_seams(table), "seams")
    layouts = index.select("uri", "header")
    bad = F.when(F.bool_or("bad"), F.lit("not UTF-8 where two runs of frames meet")).alias("seam_error")
    by_seam = seams.groupBy("uri").agg(bad, F.sum("rows_read").alias("seam_rows"))
    by_run = table.filter(F.col("layout") == RUNS_LAYOUT).groupBy("uri").agg(
        F.min("error").alias("run_error"), F.sum("rows_read").alias("run_rows")
    )
    large_files = (
        index.join(by_run, "uri", "left")
        .join(by_seam, "uri", "left")
        .withColumn("error", F.coalesce("error", "run_error", "seam_error"))
        .withColumn(
            "rows_read",
            F.when(F.col("error").isNull(), F.col("run_rows") + F.coalesce("seam_rows", F.lit(0))),
        )
    )
    listed = table.filter(F.col("layout") == FILES_LAYOUT).select(*FILE_COLUMNS)
    files = staged(listed.unionByName(large_files.select(*FILE_COLUMNS)), "files")
    lines = seams.filter(~F.col("bad")).join(layouts, "uri").select(
        named.alias("layout"), "year", "uri", F.col("raw").cast("string").alias("text")
    )
    chunks = table.select("layout", "year", "uri", "text").unionByName(lines)
    return files, chunks


def _seams(table: DataFrame) -> DataFrame:
    """The lines that were cut between runs: ``year``, ``uri``, ``raw``, ``rows_read``, ``bad``.

    The pieces of a seam are the end of a run, runs without a line end, and the start of the
    next that has one. Seams are numbered by the runs with a line end before them, and each
    is put together on its own.
    """
    pieces = table.filter(F.col("layout") == SEAMS_LAYOUT).select("year", "uri", "run", "seam", "raw")
    ending = table.filter(F.col("layout") == RUNS_LAYOUT).select("uri", "run", F.col("seam").alias("ends"))
    before = Window.partitionBy("uri").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    numbered = ending.withColumn("before", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    put = F.array_sort(F.collect_list(F.struct("run", "seam", "raw")))
    joined = F.aggregate(put, F.lit(b"").cast("binary"), lambda line, piece: F.concat(line, piece["raw"]))
    lines = (
        pieces.join(numbered, ["uri", "run"])
        .groupBy("year", "uri", (F.col("before") + F.col("seam")).alias("number"))
        .agg(joined.alias("raw"))
    )
    text = F.col("raw").cast("string")
    bad = ~F.is_valid_utf8(text)
    rows = F.size(F.filter(F.split(F.make_valid_utf8(text), "\r\n|\r|\n"), lambda line: F.length(line) > 0))
    return lines.select("year", "uri", "raw", rows.cast("long").alias("rows_read"), bad.alias("bad"))


@dataclass(frozen=True)
class Drop:
    """The files of all years and their rows as text, with and without the file's URI."""

    files: DataFrame
    located: DataFrame | None

    @property
    def rows(self) -> DataFrame | None:
        return None if self.located is None else self.located.drop(FILE_URI)


def read_drops(
    spark: SparkSession,
    years_dirs: Sequence[tuple[str, str]],
    on_corrupt: str = "skip",
    required: Sequence[str] = (),
    range_bytes: int = RANGE_BYTES,
) -> Drop:
    """All readable files of all years: text columns by name, then ``year`` and ``file``.

    Lines end with CR, LF or both; empty lines are none. Rows with too few or too many cells
    are left out. A broken file (not intact, not UTF-8, no usable header, or lacking a
    ``required`` column) contributes no row, or fails the job with ``on_corrupt="fail"``.
    ``files`` lists each file with its error and ``rows_read``, its lines but the header
    and empty ones. Files of more than ``range_bytes`` are unpacked in runs of frames.
    """
    if on_corrupt not in ("skip", "fail"):
        raise ValueError(f"on_corrupt must be 'skip' or 'fail', got {on_corrupt!r}")
    listings = []
    for year, directory in years_dirs:
        listed = list_drop(spark, directory)
        if listed is not None:
            listings.append(listed.withColumn(YEAR, F.lit(year)))
    if not listings:
        return Drop(spark.createDataFrame([], FILES_SCHEMA), None)

    files, chunks = unpack(union_widened(listings), required, range_bytes)
    counts = {
        row[YEAR]: row
        for row in files.groupBy(YEAR)
        .agg(
            F.count("error").alias("broken"),
            F.count_if(F.col("error").isNull()).alias("good"),
            F.min(F.when(F.col("error").isNotNull(), F.concat_ws(": ", "path", "error"))).alias("first"),
        )
        .collect()
    }
    broken = sum(row["broken"] for row in counts.values())
    if broken:
        first = min(row["first"] for row in counts.values() if row["first"])
        log.error("%d unreadable files, first: %s", broken, first)
        if on_corrupt == "fail":
            raise ValueError(f"{broken} unreadable files, first: {first}")
    for year, directory in years_dirs:
        if year not in counts or not counts[year]["good"]:
            log.warning("no readable files for year %s in %s", year, directory)

    good = files.filter(F.col("error").isNull())
    headers = [row["header"] for row in good.groupBy("header").count().collect()]
    if not headers:
        return Drop(files, None)
    if broken:
        # Broken files are few; with their size known, Spark needn't shuffle the text by file.
        bad = measured(files.filter(F.col("error").isNotNull()).select("uri"))
        chunks = chunks.join(bad, "uri", "left_anti")
    parsed = [_parse(chunks, header) for header in sorted(headers)]
    rows = union_widened(parsed, fill_missing=True)
    data = [name for name in rows.columns if name not in (YEAR, FILE_URI)]
    return Drop(
        files,
        rows.select(
            *(f"`{name}`" for name in data),
            YEAR,
            uri_file_id(uri_name(F.col(FILE_URI))).alias(FILE),
            FILE_URI,
        ),
    )


CSV_OPTIONS = {
    "mode": "PERMISSIVE",
    "escape": '"',
    "columnNameOfCorruptRecord": ROW_BAD,
}


def _text_schema(header: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in [*header, ROW_BAD]])


def _lines(text: str) -> Column:
    """The lines of a text. One character is split at much faster than a pattern."""
    ends = F.split(text, "\r\n|\r|\n")
    return F.when(F.contains(text, F.lit("\r")), ends).otherwise(F.split(text, "\n"))


def _rows_in(line: str, header: Sequence[str]) -> Column:
    """The row in a line as an array of one struct; none with a wrong number of cells.

    It takes a parser only where a line has a quote, or the NUL that could start a comment.
    """
    parsed = F.from_csv(line, _text_schema(header).toDDL(), CSV_OPTIONS)
    special = F.contains(line, F.lit('"')) | F.contains(line, F.lit("\0"))
    plain = F.filter(F.array(F.split(line, ",")), lambda cells: F.size(cells) == len(header))

    def row(cells: Column) -> Column:
        filled = (F.nullif(F.get(cells, F.lit(at)), F.lit("")) for at in range(len(header)))
        named = [cell.alias(name) for name, cell in zip(header, filled)]
        return F.struct(*named, F.lit(None).cast("string").alias(ROW_BAD))

    whole = F.filter(F.array(parsed), lambda found: found[ROW_BAD].isNull())
    return F.when(special, whole).otherwise(F.transform(plain, row))


def _parse(chunks: DataFrame, header: Sequence[str]) -> DataFrame:
    """Lines and cells of the files with one header."""
    text = chunks.filter(F.col("layout") == layout_of(header))
    # In an array of its own: else Spark splits each text once more to see whether it has lines.
    split = text.select("uri", YEAR, F.explode(F.array(_lines("text"))).alias("lines"))
    lines = split.select("uri", YEAR, F.explode("lines").alias("line"))
    # A generator parses each line once and drops bad rows in the same step.
    return (
        lines.filter(F.length("line") > 0)
        .select(F.col("uri").alias(FILE_URI), YEAR, F.inline(_rows_in("line", header)))
        .select(*(F.col(f"`{name}`") for name in header), YEAR, FILE_URI)
    )


def rows_per_file(rows: DataFrame) -> DataFrame:
    """Rows parsed from each file, before any filter."""
    return rows.groupBy(*LINEAGE).agg(F.count(F.lit(1)).alias("rows"))

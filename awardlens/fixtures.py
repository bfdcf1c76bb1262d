"""Contract-shaped rows derived from the star-schema test tables."""

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import staged

AWARDS_SQL = """
SELECT cast(l_orderkey as string) AS contract_award_unique_key,
 cast(year(l_shipdate) as bigint) AS action_date_fiscal_year,
 CASE WHEN l_quantity = 13 THEN NULL ELSE l_extendedprice * (1 - l_discount) END AS total_dollars_obligated,
 CASE WHEN l_quantity = 17 THEN NULL ELSE l_extendedprice * (1 - l_discount) * (1 + l_tax) END AS total_outlayed_amount_for_overall_award,
 CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS federal_action_obligation,
 CASE WHEN l_quantity = 19 THEN NULL ELSE l_extendedprice * (1 - l_discount) END AS current_total_value_of_award,
 CASE WHEN l_quantity = 29 THEN NULL ELSE l_extendedprice END AS potential_total_value_of_award,
 CASE WHEN p_size = 50 THEN NULL ELSE cast((10 + p_size) * 10000 + l_partkey % 10 as bigint) END AS naics_code,
 CASE WHEN p_size = 50 THEN NULL ELSE concat(p_type, ' ', cast(l_partkey % 10 as string)) END AS naics_description,
 CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS award_type,
 concat('Recipient ', cast(o_custkey as string)) AS recipient_name,
 cast(l_suppkey as bigint) AS awarding_agency_code,
 l_linestatus AS national_interest_action_code,
 CASE l_linestatus WHEN 'O' THEN 'T' ELSE NULL END AS minority_owned_business,
 CASE l_returnflag WHEN 'A' THEN 't' WHEN 'N' THEN 'F' ELSE 'x' END AS woman_owned_business,
 CASE WHEN l_quantity = 23 THEN 'not-a-date' ELSE cast(cast(l_shipdate as date) as string) END AS period_of_performance_current_end_date
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
"""


def awards_sql() -> str:
    """The same rows in ANSI SQL over the plain table names."""
    return AWARDS_SQL.format(lineitem="lineitem", orders="orders", part="part")


def awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {
        name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        for name in ("lineitem", "orders", "part")
    }
    # A small table is one row group and so one task: spread it over the idle cores.
    # A table of many files already has more tasks than cores and is left as it is.
    cores = spark.sparkContext.defaultParallelism
    if tables["lineitem"].rdd.getNumPartitions() < cores:
        tables["lineitem"] = tables["lineitem"].repartition(cores)
    return spark.sql(AWARDS_SQL, **tables)


def write_drop_files(
    lines: DataFrame, header: str, root: str, frame_bytes: int | None = None
) -> list[str]:
    """Write text lines as ``<root>/<year>_awards/contracts_All_<file>.csv.zst``.

    ``lines`` has the columns year, file and line. Each task streams its files to the
    shared folder, one zstd frame per file, or one for every ``frame_bytes`` of text, cut
    where they happen to end; returns the years written.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import zstandard
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        current, sink, out = None, None, None

        def parts(batch):
            """Runs of lines of one file; rows come sorted by file, those without one are left out."""
            batch = batch.filter(pc.and_(*(pc.is_valid(batch.column(n)) for n in ("year", "file"))))
            places = batch.select(["year", "file"]).to_struct_array()
            names = pc.binary_join_element_wise(batch.column("year"), batch.column("file"), "/")
            ends = pc.run_end_encode(pc.dictionary_encode(names).indices).run_ends.to_pylist()
            for start, end in zip([0, *ends], ends):
                place = places[start].as_py()
                yield (place["year"], place["file"]), batch.column("line").slice(start, end - start)

        def joined(lines):
            listed = pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines)
            return pc.binary_join(listed, "\n")[0].as_buffer().to_pybytes() + b"\n"

        def close():
            if out is not None:
                out.close()
                sink.close()

        for batch in batches:
            for key, part in parts(batch):
                if key != current:
                    close()
                    current = key
                    folder = f"{base}/{key[0]}_awards"
                    system.create_dir(folder, recursive=True)
                    sink = system.open_output_stream(
                        f"{folder}/contracts_All_{key[1]}.csv.zst", compression=None
                    )
                    out = zstandard.ZstdCompressor(level=3).stream_writer(sink, closefd=False)
                    out.write(f"{header}\n".encode())
                    yield pa.RecordBatch.from_pydict({"year": [key[0]]})
                text = joined(part)
                for at in range(0, len(text), frame_bytes or len(text)):
                    out.write(text[at : at + (frame_bytes or len(text))])
                    if frame_bytes:
                        out.flush(zstandard.FLUSH_FRAME)
        close()

    ordered = lines.repartition("year", "file").sortWithinPartitions("year", "file")
    written = ordered.select("year", "file", "line").mapInArrow(write, "year string")
    # Staged, so that what the files took to be dealt out goes before they are read.
    years = staged(written.groupBy("year").agg(F.count(F.lit(1)).alias("files")), "years")
    return sorted(row["year"] for row in years.collect())


def add_bad_files(
    spark: SparkSession, root: str, years: list[str], header: list[str], column: str, file: str
) -> None:
    """For each year a file that ends in the middle and one with a bad cell in ``column``.

    Both have the id of the clean file ``file``.
    """
    good = ["1" if name == column else "spoiled" for name in header]
    bad = ["no number" if name == column else "spoiled" for name in header]
    text = "\n".join(",".join(row) for row in (header, *[good] * 50, bad, *[good] * 50)) + "\n"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import zstandard
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for batch in batches:
            for year in batch.column(0).to_pylist():
                noise = os.urandom(100_000).hex()  # so that half of it is missing for good
                packed = zstandard.ZstdCompressor().compress(f"{text}{noise}\n".encode())
                whole = zstandard.ZstdCompressor().compress(text.encode())
                for name, content in (("cut", packed[: len(packed) // 2]), ("cell", whole)):
                    path = f"{base}/{year}_awards/{name}_{file}.csv.zst"
                    with system.open_output_stream(path, compression=None) as out:
                        out.write(content)
            yield batch

    listing = spark.createDataFrame([(year,) for year in years], "year string")
    listing.mapInArrow(write, "year string").count()


cloudpickle.register_pickle_by_value(sys.modules[__name__])

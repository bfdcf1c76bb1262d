"""WARC archives: one gzip member per record, written by tasks and read back sequentially."""

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import _repeated as repeated
from ..session import staged
from .common import ship

# Fixed values of the format.
VERSION = "WARC/1.1"
LINE_END = b"\r\n"
HEAD_END = b"\r\n\r\n"
HTTP_TYPE = "application/http"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Header of ours that carries the id of the page.
PAGE_ID = "X-Page-ID"
#: A record's or an HTTP message's header that is longer is refused.
HEAD_BYTES = 1 << 16
#: Bytes read, and unpacked, at a time.
STEP = 1 << 20


def _file_system(uri: str):
    """Arrow's file system for a folder or file, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


# ---- writing -----------------------------------------------------------------------------


def _header_text(value: str) -> str:
    """The value without characters that end or split a header line."""
    return "".join(quote(c) if c <= " " or c == "\x7f" else c for c in value)


def _head(lines: list[tuple[str, str | None]]) -> bytes:
    text = "".join(f"{name}: {value}\r\n" for name, value in lines if value is not None)
    return f"{VERSION}\r\n{text}\r\n".encode()


def record_id(*parts: str | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, repr(parts)).urn}>"


def response_id(digest: str) -> str:
    """Id of the response that all revisits of this payload refer to."""
    return record_id("response", digest)


def record(row: dict, date: str, unique: str) -> list[bytes]:
    """The parts of a record: head, HTTP head, payload, end.

    ``row`` has ``page_id``, ``url``, ``digest``, ``payload_bytes``, ``payload`` (None in a
    revisit), ``record_type``, ``shared`` (others may refer to it), ``first_url``.
    """
    revisit = row["record_type"] == "revisit"
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['payload_bytes']}\r\n\r\n"
    ).encode()
    payload = b"" if revisit else row["payload"]
    block = hashlib.sha256(http)
    block.update(payload)
    own = response_id(row["digest"]) if row["shared"] and not revisit else record_id(unique)
    url, first_url = row["url"], row["first_url"]
    head = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", own),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else _header_text(url)),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("WARC-Refers-To", response_id(row["digest"]) if revisit else None),
        ("WARC-Refers-To-Target-URI", _header_text(first_url) if revisit and first_url else None),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
        ("WARC-Block-Digest", f"sha256:{block.hexdigest()}"),
        (PAGE_ID, None if row["page_id"] is None else _header_text(row["page_id"])),
        ("Content-Type", f"{HTTP_TYPE}; msgtype=response"),
        ("Content-Length", str(len(http) + len(payload))),
    ]
    return [_head(head), http, payload, HEAD_END]


def _info(date: str) -> list[bytes]:
    body = b"software: awardlens\r\nformat: WARC File Format 1.1\r\n"
    head = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", record_id("warcinfo", date)),
        ("WARC-Date", date),
        ("Content-Type", "application/warc-fields"),
        ("Content-Length", str(len(body))),
    ]
    return [_head(head), body, HEAD_END]


def member(parts: list[bytes]) -> bytes:
    """The parts as one gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([*map(packer.compress, parts), packer.flush()])


RECORD_COLUMNS = "page_id string, url string, digest string, payload_bytes long, payload binary, record_type string, shared boolean, first_url string"
MANIFEST = "path string, records long, bytes long"


def with_record_types(
    pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int
) -> DataFrame:
    """The pages as rows of ``RECORD_COLUMNS``: which are responses and which revisits.

    Groups of equal payloads are found on digests, ids and URLs alone, combined before they
    are shuffled; only groups of more than one row are joined to the pages, by a join that
    Spark splits where a digest is frequent. Rows that tie with the first of their group in
    id and URL are equal throughout: they are counted, and given back as often.
    """
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).select("id", "url", "payload", F.unhex(F.sha2("payload", 256)).alias("digest"))
    counted = (
        rows.where(F.octet_length("payload") >= least_bytes)
        .groupBy("digest", "id", "url")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = F.struct(
        F.col("id").isNull().alias("no_id"), "id", F.col("url").isNull().alias("no_url"), "url", "n"
    )
    groups = counted.groupBy("digest").agg(F.sum("n").alias("size"), F.min(order).alias("first"))
    shared = staged(
        groups.where("size > 1").select(
            F.col("digest").alias("shared_digest"),
            F.col("first.id").alias("first_id"),
            F.col("first.url").alias("first_url"),
            F.col("first.n").alias("ties"),
        ),
        "shared-payloads",
    )
    joined = rows.join(
        shared,
        (F.col("digest") == F.col("shared_digest")) & (F.octet_length("payload") >= least_bytes),
        "left",
    )
    is_shared = F.col("shared_digest").isNotNull()
    is_first = F.col("id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))

    def as_records(rows: DataFrame, response: Column) -> DataFrame:
        kind = F.when(response, "response").otherwise("revisit")
        return rows.select(
            F.col("id").cast("string").alias("page_id"),
            "url",
            F.lower(F.hex("digest")).alias("digest"),
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            F.when(response, F.col("payload")).alias("payload"),
            kind.alias("record_type"),
            is_shared.alias("shared"),
            "first_url",
        )

    if shared.where("ties > 1").isEmpty():
        return as_records(joined, ~is_shared | is_first)
    tied = is_shared & is_first & (F.col("ties") > 1)
    plain = as_records(joined.where(~tied), ~is_shared | is_first)
    once = (
        joined.where(tied)
        .groupBy("digest", "shared_digest", "id", "url", "first_url", "ties")
        .agg(F.first("payload").alias("payload"))
    )
    # Their copies hold nothing of their own but the length: the payload stays behind.
    copies = once.select(
        F.col("id").cast("string").alias("page_id"),
        "url",
        F.lower(F.hex("digest")).alias("digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.lit("revisit").alias("record_type"),
        F.lit(True).alias("shared"),
        "first_url",
        (F.col("ties") - 1).alias("times"),
    )
    others = repeated(copies, "times").withColumn("payload", F.lit(None).cast("binary"))
    others = others.select(*plain.columns)
    return plain.unionByName(as_records(once, F.lit(True))).unionByName(others)


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 100,
    file_bytes: int = 1 << 30,
) -> DataFrame:
    """Write a record per page into ``folder``; returns ``path``, ``records``, ``bytes``.

    Of pages with equal payloads of at least ``least_bytes``, the one with the smallest id
    becomes a ``response`` and the others become ``revisit`` records that refer to it;
    smaller payloads are all responses. Every task writes files of its own, named after its
    attempt, and begins another at ``file_bytes``; a file counts once it is in the returned
    list, so what a lost executor or a second attempt leaves behind is never read.

    Payloads may be text (UTF-8) or binary; null is empty. A null id ranks behind all others,
    a null URL has no header. Of repeated rows one is the response. No pages make no file.
    Other columns are ignored.
    """
    ship(pages.sparkSession)
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = with_record_types(pages, id_col, url_col, payload_col, least_bytes)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        context, done, sink = TaskContext.get(), [], None
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}"

        def opened():
            system.create_dir(base, recursive=True)
            file = f"{name}-{len(done):04d}.warc.gz"
            done.append([f"{folder.rstrip('/')}/{file}", 0, 0])
            out = system.open_output_stream(f"{base.rstrip('/')}/{file}", compression=None)
            done[-1][2] += out.write(member(_info(date)))
            return out

        for batch in batches:
            payloads = batch.column(batch.schema.get_field_index("payload"))
            rest = batch.drop_columns(["payload"]).to_pylist()
            for row, payload in zip(rest, payloads, strict=True):
                row["payload"] = payload.as_py()
                if sink is None or done[-1][2] >= file_bytes:
                    if sink is not None:
                        sink.close()
                    sink = opened()
                done[-1][1] += 1
                done[-1][2] += sink.write(
                    member(record(row, date, f"{name} {len(done)} {done[-1][1]}"))
                )
        if sink is not None:
            sink.close()
        for path, records, size in done:
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

    return staged(rows.mapInArrow(written, MANIFEST), "archives")


# ---- reading -----------------------------------------------------------------------------


class Broken(ValueError):
    """What stands in the file is no record; nothing behind it can be trusted."""


@dataclass
class Members:
    """The gzip members of a stream, each unpacked in steps of bounded size."""

    source: object
    packed: bytes = b""
    offset: int = 0  # in the file, of what ``packed`` begins with
    ended: bool = True
    unpacker: object = None
    ready: bytes = b""
    start: int = field(default=0, init=False)

    def following(self) -> bool:
        """Go to the next member; False at the end of the file."""
        if not self.packed:
            self.packed = self.source.read(STEP)
        self.start, self.ended, self.ready = self.offset, not self.packed, b""
        self.unpacker = zlib.decompressobj(31)
        return not self.ended

    def _more(self) -> bytes:
        while not self.ended:
            if not self.packed:
                self.packed = self.source.read(STEP)
                if not self.packed:
                    raise Broken("file ends inside a gzip member")
            try:
                data = self.unpacker.decompress(self.packed, STEP)
            except zlib.error as error:
                raise Broken(f"bad gzip member: {error}") from None
            left = self.unpacker.unused_data if self.unpacker.eof else self.unpacker.unconsumed_tail
            self.offset += len(self.packed) - len(left)
            self.packed, self.ended = left, self.unpacker.eof
            if data:
                return data
        return b""

    def read(self, size: int) -> bytes:
        """At most ``size`` bytes; empty at the end of the member."""
        data, self.ready = self.ready or self._more(), b""
        self.ready = data[size:]
        return data[:size]

    def head(self, most: int) -> bytes:
        """The bytes before the next empty line, which is passed over."""
        data = b""
        while (end := data.find(HEAD_END)) < 0:
            more = self.read(STEP)
            if not more:
                raise Broken("header without end")
            data += more
            if len(data) > most and data.find(HEAD_END, 0, most) < 0:
                raise Broken("header too long")
        self.ready = data[end + len(HEAD_END) :] + self.ready
        return data[:end]


def _fields(head: bytes) -> dict[str, str]:
    fields, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()  # a folded line
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise Broken(f"no header line: {line[:80]!r}")
        last = name.strip().lower()
        fields[last] = value.strip()
    return fields


def _length(fields: dict[str, str]) -> int:
    text = fields.get("content-length", "")
    if not (text.isascii() and text.isdigit()):
        raise Broken(f"bad Content-Length {text!r}")
    return int(text)


def _differs(named: str | None, found) -> bool:
    """Whether a digest header names another digest. Other algorithms are not checked."""
    algorithm, _, value = (named or "").partition(":")
    return algorithm.lower() == "sha256" and value.lower() != found.hexdigest()


def read_record(members: Members, keep_payload: bool) -> dict:
    """The record in the member that ``members`` stands at, its digests verified."""
    first, _, rest = members.head(HEAD_BYTES).partition(LINE_END)
    if not first.startswith(b"WARC/"):
        raise Broken(f"no WARC record: {first[:20]!r}")
    fields = _fields(rest)
    left = _length(fields)
    block, payload, kept, size = hashlib.sha256(), hashlib.sha256(), [], 0
    kind = fields.get("warc-type")
    http, in_payload = {}, True
    if fields.get("content-type", "").lower().startswith(HTTP_TYPE) and left:
        # The block is an HTTP message: its payload begins behind the first empty line.
        head = members.head(min(left, HEAD_BYTES)) + HEAD_END
        block.update(head)
        left -= len(head)
        if left < 0:
            raise Broken("HTTP header longer than its block")
        http = _fields(head.partition(LINE_END)[2].removesuffix(HEAD_END))
    while left:
        data = members.read(min(left, STEP))
        if not data:
            raise Broken("block shorter than its Content-Length")
        left -= len(data)
        block.update(data)
        payload.update(data)
        size += len(data)
        if keep_payload:
            kept.append(data)
    end = members.read(STEP)
    while len(end) < 5 and (more := members.read(STEP)):
        end += more
    if end != HEAD_END:
        raise Broken("record longer than its Content-Length")
    error = "block digest differs" if _differs(fields.get("warc-block-digest"), block) else None
    digest = payload.hexdigest()
    if kind == "revisit":  # the payload stands in another record; its length and digest here
        digest = fields.get("warc-payload-digest", "").partition(":")[2].lower() or None
        length = http.get("content-length", "")
        size = int(length) if length.isascii() and length.isdigit() else None
        in_payload = False
    elif not error and _differs(fields.get("warc-payload-digest"), payload):
        error = "payload digest differs"
    return {
        "record_type": kind,
        "record_id": fields.get("warc-record-id"),
        "refers_to": fields.get("warc-refers-to"),
        "target_uri": fields.get("warc-target-uri"),
        "date": fields.get("warc-date"),
        "page_id": fields.get(PAGE_ID.lower()),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": b"".join(kept) if keep_payload and in_payload else None,
        "error": error,
    }


def records_of(source, keep_payload: bool = False) -> Iterator[dict]:
    """All records of a file, with ``offset`` and ``length`` of their gzip members.

    A record with a wrong digest has an ``error`` and the next ones follow. Where the file
    is cut off or is no archive, a row with only an ``error`` ends it.
    """
    members = Members(source)
    while members.following():
        try:
            found = read_record(members, keep_payload)
            yield found | {"offset": members.start, "length": members.offset - members.start}
        except Broken as broken:
            yield {"offset": members.start, "error": str(broken)}
            return


RECORDS_SCHEMA = (
    "path string, offset long, length long, record_type string, record_id string, refers_to string,"
    " target_uri string, date string, page_id string, payload_bytes long, payload_digest string,"
    " payload binary, error string"
)


def read_archives(files: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the files in ``path``: a row each, as in ``RECORDS_SCHEMA``.

    A file is read from start to end by one task, in steps of 1 MB, and every file is a task
    of its own; archives are made of about 1 GB for that. Without ``payloads`` no payload is
    ever held, however long; digests are verified all the same. Records that describe the
    file (``warcinfo``) are returned too. No files give no rows; an empty file has no record.
    """
    ship(files.sparkSession)
    names = [part.split()[0] for part in RECORDS_SCHEMA.split(",")]
    arrow = pa.schema(
        [
            (name, {"long": pa.int64(), "binary": pa.binary()}.get(kind, pa.string()))
            for name, kind in (part.split() for part in RECORDS_SCHEMA.split(","))
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = _file_system(path)
                rows, held = [], 0
                with system.open_input_stream(name, compression=None, buffer_size=STEP) as source:
                    for row in records_of(source, payloads):
                        rows.append({key: row.get(key) for key in names} | {"path": path})
                        held += len(row.get("payload") or b"")
                        if len(rows) >= 2000 or held >= 8 * STEP:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    paths = files.select("path")
    # The list of files is short; dealt out from one task, each task gets one of them.
    dealt = paths.coalesce(1).repartition(max(1, paths.count()))
    return dealt.mapInArrow(read, RECORDS_SCHEMA)


def with_referred_page(records: DataFrame) -> DataFrame:
    """The records of pages, and in ``refers_to_page`` the id of the page a revisit refers to.

    Found by the record ids; a revisit whose response is not there has null. The records are
    read three times, so they should be staged, or come from a table.
    """
    targets = records.where("record_type = 'response'").select(
        F.col("record_id").alias("target_id"), F.col("page_id").alias("refers_to_page")
    )
    wanted = records.where("record_type = 'revisit'")
    found = wanted.join(targets, wanted["refers_to"] == targets["target_id"], "left").drop("target_id")
    others = records.where("record_type <> 'revisit' OR record_type IS NULL").withColumn(
        "refers_to_page", F.lit(None).cast("string")
    )
    return others.unionByName(found).where("record_type IS NULL OR record_type <> 'warcinfo'")

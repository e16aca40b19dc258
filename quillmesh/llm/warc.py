"""WARC archives: written record by record, and read back by a reader that salvages damaged ones.

Writing. Payloads are told apart by SHA-1. The least page_id of a payload is its response record; the others are revisit
records that refer to it and hold no payload. Only ids and digests are shuffled for that; texts stay where they are, unless
revisits are too many to be sent to every task. Each record is a gzip member of its own (or plain), with digests of its block
and payload. Tasks write files of bounded size under names of their own; the driver's commit moves the whole files of the
tasks that succeeded to their place, so a lost or repeated task leaves nothing behind.

Reading. A record is taken when all its checks hold: the member inflates and its CRC is right, the version line and the
headers can be read, the block has its stated length and is followed by two line ends, and the digests of block and payload
agree. After a failed check the reader searches for the next member or version line from which a record passes the checks,
goes on there, and logs the bytes between as a quarantined gap. A file is read by one task in blocks of 1 MB with at most one
record in memory; a length that the file cannot hold fails before anything is read.

Cases: a null html is an empty payload (its SHA-1 is that of no bytes); a null url has no target line; control characters of
a url are written as %XX; a null page_id counts as the largest: it revisits the others, and among null ids alone each is a
response; repeated rows of the least page_id and one payload are each a response; very long pages are written and read whole;
an empty table makes archives without records; columns other than page_id, url and html are not read, so their names cannot
clash. A record of over 2 GB cannot be a row's value: it is quarantined.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from quillmesh.llm.common import checkpointed
from quillmesh.operators.graph import with_least
from quillmesh.operators.lineage import new_folder
from quillmesh.operators.parallel import few, spread
from quillmesh.sources.files import Bytes, batches, listed, located

#: Bytes after which a task begins another file.
FILE_BYTES = 128 << 20
#: Revisits that are sent to every task, some 40 bytes each, once they are counted.
FEW_REVISITS = 100_000
#: A block beyond this cannot be a row's value.
MOST_BYTES = (1 << 31) - (1 << 20)
_MAGIC, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_END = b"\r\n\r\n"
_CONTROL = re.compile("[\x00-\x20\x7f]")
_MANDATORY = {"warc-type", "warc-record-id", "warc-date"}
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")

WRITTEN = "page_id long, url string, payload binary, digest string, n long, refers_to long, revisit boolean"
READ = "path string, offset long, length long, gap string, type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


class Damaged(Exception):
    """A check of a record failed."""


# ---- records


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, n: int, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A response with its payload, or a revisit that keeps the response's HTTP headers alone."""
    headers = [("WARC-Record-ID", urn(page_id)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", urn(refers_to))]
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    return record("revisit" if revisit else "response", headers, http + payload)


def member(data: bytes) -> bytes:
    """A gzip member without a name or time."""
    deflate = zlib.compressobj(5, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes

    def row(self, path: str, payloads: bool) -> tuple:
        kind, get = self.headers.get("warc-type"), self.headers.get
        head, gap, payload = self.block.partition(_END) if get("content-type", "").startswith("application/http") else (b"", b"", self.block)
        n = len(payload)
        if kind == "revisit":  # the payload is elsewhere; the HTTP headers tell its length
            stated = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", head)
            n, payload = int(stated[1]) if stated else None, None
        digest = get("warc-payload-digest")
        return (path, self.offset, self.length, None, kind, get("warc-record-id"), get("warc-target-uri"), get("warc-refers-to"), digest and digest.rpartition(":")[2], n, payload if payloads else None)


def checked(headers: dict[str, str], block: bytes) -> None:
    """Fails unless the digests that a record states, by SHA-1, are those of its block and payload."""
    stated = headers.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated[5:] != base32_sha1(block):
        raise Damaged("block digest")
    stated = headers.get("warc-payload-digest", "")
    if stated.startswith("sha1:") and headers.get("warc-type") in ("response", "resource", "request"):
        http = headers.get("content-type", "").startswith("application/http")
        if stated[5:] != base32_sha1(block.partition(_END)[2] if http else block):
            raise Damaged("payload digest")


def parsed(head: bytes) -> tuple[dict[str, str], int]:
    """Headers in lower case, and the block's length."""
    first = _VERSION_LINE.match(head)
    if first is None:
        raise Damaged("version line")
    headers: dict[str, str] = {}
    try:
        for line in head[first.end() :].decode().split("\r\n"):
            name, colon, value = line.partition(":")
            if not colon or not name:
                raise Damaged("header line")
            headers[name.strip().lower()] = value.strip()
    except UnicodeDecodeError:
        raise Damaged("header line") from None
    if not re.fullmatch("[0-9]{1,18}", headers.get("content-length", "")) or not _MANDATORY <= headers.keys():
        raise Damaged("headers missing")
    n = int(headers["content-length"])
    if n > MOST_BYTES:
        raise Damaged("block too long")
    return headers, n


def plain_record(data: Bytes, at: int) -> Record:
    """The record whose version line begins at an offset."""
    if not _VERSION_LINE.match(data.read(at, 10)):
        raise Damaged("version line")
    end = data.find((_END,), at)
    if end == data.size or end - at > MOST_BYTES:
        raise Damaged("headers without end")
    headers, n = parsed(data.read(at, end - at))
    start = end + len(_END)
    if data.read(start + n, len(_END)) != _END:
        raise Damaged("block length")
    block = data.read(start, n)
    checked(headers, block)
    return Record(at, start + n + len(_END) - at, headers, block)


def gzip_record(data: Bytes, at: int) -> Record:
    """The record in the gzip member that begins at an offset; no more is inflated than its length asks for."""
    if data.read(at, 3) != _MAGIC:
        raise Damaged("member's magic")
    inflate, out, head, want, pos = zlib.decompressobj(31), bytearray(), None, None, at
    try:
        while not inflate.eof:
            part = inflate.unconsumed_tail
            if not part:
                part = data.read(pos, 1 << 16)
                pos += len(part)
                if not part:
                    raise Damaged("member without end")
            before = len(out)
            out += inflate.decompress(part, 1 << 20)
            if head is None:
                if bytes(out[:7]) != _VERSION[: len(out)]:
                    raise Damaged("version line")
                cut = out.find(_END, max(0, before - len(_END)))
                if cut >= 0:
                    headers, n = parsed(bytes(out[:cut]))
                    head, want = cut + len(_END), cut + 2 * len(_END) + n
            if want is not None and len(out) > want or len(out) > MOST_BYTES:
                raise Damaged("block length")
    except zlib.error as e:
        raise Damaged(f"member: {str(e)[:40]}") from None
    if head is None:
        raise Damaged("headers without end")
    if len(out) != want or not out.endswith(_END):
        raise Damaged("block length")
    block = bytes(out[head : -len(_END)])
    checked(headers, block)
    return Record(at, pos - len(inflate.unused_data) - at, headers, block)


def record_at(data: Bytes, at: int) -> Record:
    return gzip_record(data, at) if data.read(at, 2) == _MAGIC[:2] else plain_record(data, at)


def salvaged(data: Bytes) -> Iterator[Record | tuple[int, int, str]]:
    """The records of an archive in order, and (offset, bytes, failed check) of each gap between them."""
    at = 0
    while at < data.size:
        try:
            found = record_at(data, at)
        except Damaged as failed:
            after, why = at, str(failed)
            while (after := data.find((_MAGIC, _VERSION), after + 1)) < data.size:
                try:
                    found = record_at(data, after)
                    break
                except Damaged:
                    pass
            yield at, after - at, why
            if after == data.size:
                return
        yield found
        at = found.offset + found.length


# ---- the data source


class WarcFiles(DataSource):
    """format("warc"): reads records and gaps of *.warc and *.warc.gz; writes pages.

    Options: path; payloads ("false": their bytes are checked but not returned); compressed ("false": plain archives); date.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], to_arrow_schema(schema), self.options.get("payloads", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options.get("compressed", "true").lower() != "false", self.options.get("date", "1970-01-01T00:00:00Z"), int(self.options.get("fileBytes", FILE_BYTES)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, arrow: pa.Schema, payloads: bool):
        self.path, self.arrow, self.payloads = path, arrow, payloads

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(path) for path, _ in listed(self.path, (".warc", ".warc.gz"))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        def rows(data: Bytes):
            for found in salvaged(data):
                yield found.row(partition.value, self.payloads) if isinstance(found, Record) else (partition.value, *found, *[None] * 7)

        if partition is None:  # there are no files
            return
        with Bytes(partition.value) as data:
            yield from batches(rows(data), self.arrow, 1024, lambda row: len(row[-1] or b""))


@dataclass
class _Files(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, compressed: bool, date: str, file_bytes: int):
        self.path, self.compressed, self.date, self.file_bytes = path, compressed, date, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Files:
        system, folder = located(self.path)
        system.create_dir(f"{folder}/_written", recursive=True)
        pack = member if self.compressed else bytes
        names, out = [], None
        for batch in iterator:
            for i in range(batch.num_rows):
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc{'.gz' if self.compressed else ''}")
                    out = system.open_output_stream(f"{folder}/_written/{names[-1]}", compression=None)
                    out.write(pack(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                row = [c[i].as_py() for c in batch.columns]
                out.write(pack(page_record(row[0], row[1], row[2] or b"", row[3], row[4], row[5], row[6], self.date)))
                if out.tell() >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Files(names)

    def commit(self, messages: list[_Files | None]) -> None:
        """Moves the files of the tasks that succeeded to their place."""
        system, folder = located(self.path)
        system.create_dir(folder, recursive=True)
        for m in messages:
            for name in m.names if m else ():
                system.move(f"{folder}/_written/{name}", f"{folder}/{name}")
        self._sweep(system, folder)

    def abort(self, messages: list[_Files | None]) -> None:
        self._sweep(*located(self.path))

    def _sweep(self, system: fs.FileSystem, folder: str) -> None:
        if system.get_file_info(f"{folder}/_written").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/_written")


# ---- pages


def page_rows(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to write (WRITTEN): the responses, with their payloads, and the revisits."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = spread(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")))
    own = own.withColumns({"sha": F.unhex(F.sha1("payload")), "n": F.octet_length("payload").cast("long")})
    least = with_least(own.select("page_id", "url", "sha", "n"), "sha", "page_id", "refers_to")
    revisits = checkpointed(least.where(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))))
    gone = few(revisits.select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha")).distinct(), FEW_REVISITS)
    responses = own.join(gone, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left_anti")
    digest = base32(F.lower(F.hex("sha")))
    none = F.lit(None)
    return (
        responses.select("page_id", "url", "payload", digest.alias("digest"), "n", none.cast("long").alias("refers_to"), F.lit(False).alias("revisit")),
        revisits.select("page_id", "url", none.cast("binary").alias("payload"), digest.alias("digest"), "n", "refers_to", F.lit(True).alias("revisit")),
    )


def base32(digest: Column) -> Column:
    """Upper-case base32 of a 40-digit hexadecimal string: five of its digits are four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(letters, F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def write(pages: DataFrame, path: str, **options) -> None:
    """A record for each page, in archives below a folder."""
    pages.sparkSession.dataSource.register(WarcFiles)
    for rows in page_rows(pages):
        rows.write.format("warc").options(**options).mode("append").save(path)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """Records and gaps (READ); a gap's row has its offset, its bytes and the failed check, and nothing else."""
    spark.dataSource.register(WarcFiles)
    return spark.read.format("warc").options(**options).load(path)


def gaps(found: DataFrame) -> DataFrame:
    return found.where("gap is not null").select("path", "offset", "length", "gap")


def pages_of(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the page records among those read."""
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]*)>$', 1) as bigint)")
    own = found.where("type in ('response', 'revisit') and record_id like '<urn:page:%'")
    return own.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read from there."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write(pages, path)
    return pages_of(read(spark, path, payloads="false"))

"""WARC archives: writing, normalising whole-file gzip streams, reading by offset.

An archive that was compressed as one gzip stream cannot be read from the middle.
The normaliser inflates such a stream once, from start to end, writes each record
as a gzip member of its own and notes where it lies, so that any record can be
read alone. ``normalise`` works on byte streams of any length. On a cluster the
archives are files: ``archives`` writes whole-stream ``.warc.gz`` files,
``normalised`` writes for each a ``.warc.gz`` of members and a sidecar ``.idx`` (JSON
lines) beside it, ``indexed`` reads the sidecars and ``read_pages`` the records by
their offsets. Tasks stream: they hold one record or a megabyte, never an archive.
A task's files have names of their own, and only the rows of tasks that ended name
files, so a task that runs again or twice does no harm.

Files are opened by ``pyarrow.fs`` (local or shared mounts, HDFS, S3, GCS, ABFS); in
another kind of store the operator fails.

Of pages with equal payloads the one with the smallest id is stored as response,
all others as revisit records that refer to it.

Defined results: a null html is an empty payload, a null url an empty one; equal
rows are records each; a page with a null id is always a response; an empty table
gives no archive; payloads shorter than ``least`` bytes are never revisits.
"""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import erase, materialize, qualified, shared_dir, small_batches

ARCHIVE_BYTES = 16 << 20
READ_BYTES = 4 << 20  # of a normalised archive, read by one task
TASKS = 1 << 14  # no more tasks than this; beyond it each takes several archives
HOT = 1 << 17  # at most so many digests, the most frequent ones, are broadcast: about 20 MB
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_PAGE = "urn:x-page:"


@dataclass
class Record:
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def to_bytes(self) -> bytes:
        lines = "".join(f"{k}: {v}\r\n" for k, v in {**self.headers, "Content-Length": str(len(self.block))}.items())
        return b"WARC/1.0\r\n" + lines.encode() + b"\r\n" + self.block + b"\r\n\r\n"

    @property
    def payload(self) -> bytes:
        """The block without its HTTP head."""
        return self.block.partition(b"\r\n\r\n")[2]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> Record:
    """A response with the payload, or a revisit of page ``refers_to`` without it."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda i: f"<{_PAGE}{'' if i is None else i}>"
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": name(page_id),
        "WARC-Target-URI": "".join(c if c > " " else f"%{ord(c):02X}" for c in url or ""),
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http;msgtype=response",
    }
    if refers_to is not None:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": name(refers_to)}
    return Record(headers, head if refers_to is not None else head + payload)


def inflated(pieces: Iterator[bytes], step: int = 1 << 20) -> Iterator[bytes]:
    """Inflate a gzip stream of one or many members, at most ``step`` bytes at a time."""
    engine, fresh = zlib.decompressobj(31), True
    for piece in pieces:
        while piece:
            out = engine.decompress(piece, step)
            fresh = False
            if out:
                yield out
            if engine.eof:
                piece, engine, fresh = engine.unused_data, zlib.decompressobj(31), True
            else:
                piece = engine.unconsumed_tail
    if not fresh:
        while out := engine.decompress(engine.unconsumed_tail, step):
            yield out
        if not engine.eof:
            raise ValueError("the gzip stream ends inside a member")


def records(pieces: Iterator[bytes]) -> Iterator[Record]:
    """Parse the records of an inflated archive; holds one record at a time."""
    held = bytearray()
    ended = False

    def more() -> bool:
        nonlocal ended
        piece = next(pieces, None)
        ended = piece is None
        held.extend(piece or b"")
        return not ended

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if end < 0:
            if held.strip():
                raise ValueError("the archive ends inside a record's head")
            return
        version, *lines = held[:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record starts with {version[:40]!r}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        size = int(headers.pop("Content-Length"))
        while len(held) < end + 4 + size + 4 and more():
            pass
        if len(held) < end + 4 + size + 4:
            raise ValueError("the archive ends inside a record")
        yield Record(headers, bytes(held[end + 4 : end + 4 + size]))
        del held[: end + 4 + size + 4]


def member(record: Record, level: int = 6) -> bytes:
    """The record as a gzip member (the same bytes for the same record)."""
    engine = zlib.compressobj(level, zlib.DEFLATED, 31)
    return engine.compress(record.to_bytes()) + engine.flush()


def normalise(pieces: Iterator[bytes], write: Callable[[bytes], object]) -> Iterator[tuple[int, int, str, str]]:
    """Rewrite a gzip stream of any layout, record by record.

    ``write`` gets each member; yields the index: (offset, length, type, record id).
    """
    at = 0
    for record in records(inflated(pieces)):
        data = member(record)
        write(data)
        yield at, len(data), record.headers.get("WARC-Type", ""), record.headers.get("WARC-Record-ID", "")
        at += len(data)


# ---------------------------------------------------------------- archives as files


def with_referred(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): the page whose equal payload is stored, or null.

    Only ids and digests are grouped. A digest is frequent if it has over one in ``HOT``
    of all copies, so there are fewer than ``HOT`` of those; they are broadcast, and
    only where there are others a join moves pages, none of its keys being a hot one.
    """
    key = F.when(F.octet_length("html") >= least, F.sha1(F.col("html").cast("binary")))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("_key", key)
    first = rows.where("_key is not null and page_id is not null").groupBy("_key").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    copies = materialize(first.where("_n > 1"))
    total = copies.agg(F.sum("_n")).first()[0] or 0
    frequent = F.col("_n") * HOT > total
    rows = rows.join(F.broadcast(copies.where(frequent).select("_key", "_first")), "_key", "left")
    rare = copies.where(~frequent).select(F.col("_key").alias("_rare"), F.col("_first").alias("_rare_first"))
    if not rare.isEmpty():
        # what needs no partner here is spread by its id
        asked = F.when(F.col("_first").isNull(), F.col("_key"))
        rows = rows.withColumn("_asked", F.coalesce(asked, F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
        rows = rows.join(rare, F.col("_asked") == F.col("_rare"), "left").withColumn("_first", F.coalesce("_first", "_rare_first"))
    return rows.select("page_id", "url", "html", F.when(F.col("page_id") != F.col("_first"), F.col("_first")).alias("refers_to"))


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _pieces(stream: pa.NativeFile, step: int = 1 << 20) -> Iterator[bytes]:
    while piece := stream.read(step):
        yield piece


def archives(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages to files in ``folder``, each one whole gzip stream: (archive, records).

    A task starts another file after ``archive_bytes`` of records. Each run of the
    table writes files anew: materialise it.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        store.create_dir(path)
        rows = (row for batch in batches for row in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "html", "refers_to")), strict=True))
        row = next(rows, None)
        while row is not None:
            name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
            engine = zlib.compressobj(1, zlib.DEFLATED, 31)
            with store.open_output_stream(f"{path}/{name}", compression=None) as out:
                while row is not None and size < archive_bytes:
                    page_id, url, html, refers_to = row
                    data = page_record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to).to_bytes()
                    out.write(engine.compress(data))
                    size, count = size + len(data), count + 1
                    row = next(rows, None)
                out.write(engine.flush())
            yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([count])], names=["archive", "records"])

    return with_referred(pages, least).mapInArrow(run, "archive string, records long")


def normalised(table: DataFrame, folder: str) -> DataFrame:
    """Normalise the files named by ``archive`` into ``folder``: (archive, index, records, bytes).

    ``index`` is the sidecar: a line {"offset", "length", "type", "id"} for each record.
    A gzip stream can only be read from its start, so a file is one task's. Each run of
    the table writes files anew: materialise it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        store.create_dir(path)
        for source in (a for batch in batches for a in batch.column("archive").to_pylist()):
            name, count, size = uuid.uuid4().hex, 0, 0
            origin, at = _store(source)
            with (
                origin.open_input_stream(at, compression=None) as stream,
                store.open_output_stream(f"{path}/{name}.warc.gz", compression=None) as out,
                store.open_output_stream(f"{path}/{name}.idx", compression=None) as idx,
            ):
                for entry in normalise(_pieces(stream), out.write):
                    idx.write(json.dumps(dict(zip(("offset", "length", "type", "id"), entry, strict=True))).encode() + b"\n")
                    count, size = count + 1, entry[0] + entry[1]
            values = [f"{folder}/{name}.warc.gz", f"{folder}/{name}.idx", count, size]
            yield pa.record_batch([pa.array([v]) for v in values], names=["archive", "index", "records", "bytes"])

    return table.select("archive").mapInArrow(run, "archive string, index string, records long, bytes long")


def indexed(table: DataFrame) -> DataFrame:
    """Read the sidecars of normalised archives: (archive, offset, length, type, id)."""
    names, kinds = ["offset", "length", "type", "id"], [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, index in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist(), strict=True):
                store, path = _store(index)
                with store.open_input_stream(path, compression=None) as stream, io.TextIOWrapper(stream, "utf-8") as lines:
                    while some := [json.loads(line) for line in itertools.islice(lines, 4096)]:
                        columns = [pa.array([e[n] for e in some], k) for n, k in zip(names, kinds, strict=True)]
                        yield pa.record_batch([pa.array([archive] * len(some)), *columns], names=["archive", *names])

    return table.select("archive", "index").mapInArrow(run, "archive string, offset long, length long, type string, id string")


def read_pages(table: DataFrame) -> DataFrame:
    """Read each record by its place in the sidecar: what it is and what it says of its payload.

    An archive of any size is read by many tasks, ``READ_BYTES`` by each. The payload of
    a response is counted and digested anew and must agree with its head.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def number(name: str | None) -> int | None:
        text = (name or "").removeprefix(f"<{_PAGE}").removesuffix(">")
        return int(text) if text else None

    def read(data: bytes, name: str) -> tuple:
        (record,) = records(inflated(iter([data])))
        h = record.headers
        size, said = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:")
        if h["WARC-Record-ID"] != name:
            raise ValueError(f"{name} is not where the index says")
        if h["WARC-Type"] == "response" and (len(record.payload), digest(record.payload)) != (size, said):
            raise ValueError(f"the payload of {name} is damaged")
        return number(name), size, said, h["WARC-Type"], number(h.get("WARC-Refers-To"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, file = None, None
        try:
            for batch in batches:
                out = []
                for archive, offset, length, name in zip(*(batch.column(n).to_pylist() for n in ("archive", "offset", "length", "id")), strict=True):
                    if archive != opened:
                        if file:
                            file.close()
                        store, path = _store(archive)
                        opened, file = archive, store.open_input_file(path)
                    out.append(read(file.read_at(length, offset), name))
                if out:
                    yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        finally:
            if file:
                file.close()

    small_batches(table.sparkSession)
    tasks = (table.agg(F.sum("bytes")).first()[0] or 0) // READ_BYTES + 1
    tasks = min(tasks, TASKS)
    places = indexed(table).withColumn("_span", F.floor(F.col("offset") / READ_BYTES))
    places = places.repartition(tasks, "archive", "_span").sortWithinPartitions("archive", "offset").drop("_span", "type")
    return places.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages to whole-stream archives, normalise them, and read all records back.

    The normalised archives and their sidecars stay in the shared folder.
    """
    spark = pages.sparkSession
    folder = qualified(spark, f"{shared_dir(spark)}/rillflow/warc-{uuid.uuid4().hex}")
    written = materialize(archives(pages, f"{folder}/whole", least))
    table = materialize(normalised(written.repartition(min(max(1, written.count()), TASKS)), f"{folder}/members"))
    erase(spark, f"{folder}/whole")
    return read_pages(table)

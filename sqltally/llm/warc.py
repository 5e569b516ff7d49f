"""Web archives: pages written as WARC records, one gzip member each, and read back in sequence with bounded memory.

Writing: the first page of each payload is a ``response`` (an HTTP message with the page's bytes), the others are ``revisit`` records
that name it and carry the message's head only. Each task writes files of its own into the shared folder, under a name that no
other attempt uses, and returns what it wrote; that list is a written table. A file that is not in it, left by a lost or
repeated task, is never read.

Reading: a task goes through whole archives from front to end. A member is inflated piece by piece, its record framed by the declared
length, and digests are taken on the way, so a record of any size costs one piece of memory unless its payload is asked for.
Each record must be one whole member, end where its length says, and match its block and payload digests.

Files are opened through ``pyarrow.fs``, so the folder may be a mounted path or a store that Arrow opens (hdfs, s3, gs).

Defined cases: a null html is empty; a null url is ``about:blank``, and other characters than URLs have are percent-encoded; of equal
payloads the smallest page id responds, null ids after all others, and of rows that repeat an id one; an empty table gives
no archive and an empty answer; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltally.llm.words import body
from sqltally.session import kept, ship_package, work_dir

#: Fixed values of the format.
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Characters that stay as they are in a target address.
URL_SAFE = "!#$%&'()*+,/:;=?@[]~"

DATE = "2024-01-01T00:00:00Z"
#: Compressed bytes after which a task begins a new file.
FILE_BYTES = 1 << 30
#: Bytes read from a file and inflated at once; longest head of a record or message.
PIECE, HEAD = 1 << 16, 1 << 16
_SPACE = uuid.UUID("8c2f6a39-9f0b-4f0e-9f2d-0d3f5f0a7a11")


class DamagedArchive(ValueError):
    """An archive that is not what its headers say."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{row}')}>"


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    packer = zlib.compressobj(wbits=31)
    return b"".join([packer.compress(b"\r\n".join(lines) + END), packer.compress(block), packer.compress(END), packer.flush()])


def info_member(name: str, date: str = DATE) -> bytes:
    """The record that opens a file."""
    block = b"software: sqltally\r\nformat: WARC File Format 1.1\r\n"
    headers = [
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", date),
        ("WARC-Filename", name), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/warc-fields"),
    ]
    return member(headers, block)


def page_member(page: dict, date: str = DATE) -> bytes:
    """The record of a page: ``row, page_id, url, html`` and, for a revisit, ``first_row, first_page_id, first_url``."""
    payload = page["html"].encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END
    again = page["first_row"] is not None
    block = head if again else head + payload
    address = lambda url: quote(url or "about:blank", safe=URL_SAFE)
    headers = [
        ("WARC-Type", "revisit" if again else "response"),
        ("WARC-Record-ID", record_id(page["page_id"], page["row"])),
        ("WARC-Date", date),
        ("WARC-Target-URI", address(page["url"])),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if page["page_id"] is not None:
        headers.append(("X-Page-ID", str(page["page_id"])))
    if again:
        headers += [
            ("WARC-Profile", SAME_PAYLOAD),
            ("WARC-Refers-To", record_id(page["first_page_id"], page["first_row"])),
            ("WARC-Refers-To-Target-URI", address(page["first_url"])),
            ("WARC-Refers-To-Date", date),
        ]
    return member(headers, block)


def placed(pages: DataFrame, least: int = 0) -> DataFrame:
    """The pages, numbered, with the first page of an equal payload of at least ``least`` bytes, null for that page itself."""
    rows = kept(
        pages.select(
            F.monotonically_increasing_id().alias("row"), "page_id", "url", body(F.col("html")).alias("html")
        ).withColumn("mark", F.unhex(F.sha2("html", 256))),
        "warc-pages",
    )
    slim = rows.where(F.octet_length("html") >= least).select("mark", "row", F.col("page_id").isNull().alias("none"), "page_id", "url")
    first = F.min(F.struct("none", "page_id", "row", "url")).alias("first")
    groups = kept(slim.groupBy("mark").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1"), "warc-groups")
    again = slim.select("mark", "row").join(groups, "mark").where(F.col("row") != F.col("first.row"))
    again = kept(again.select("row", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("row", "page_id", "url")]), "warc-again")
    return rows.drop("mark").join(again, "row", "left")


def write_archives(pages: DataFrame, folder: str, least: int = 0, date: str = DATE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages below ``folder``, which executors and driver share; ``path, n_records, n_bytes`` of every archive."""
    ship_package(pages.sparkSession)
    schema = T.StructType([
        T.StructField("path", T.StringType()), T.StructField("n_records", T.LongType()), T.StructField("n_bytes", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, told, done = None, None, []
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for page in batch.slice(start, 64).to_pylist():
                    if out is None:
                        name = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                        out, told = store.open_output_stream(f"{base}/{name}", compression=None), [f"{folder}/{name}", 1, 0]
                        told[2] += out.write(info_member(name, date))
                    told[1] += 1
                    told[2] += out.write(page_member(page, date))
                    if told[2] >= file_bytes:
                        out.close()
                        done.append(told)
                        out = None
        if out is not None:
            out.close()
            done.append(told)
        columns = list(zip(*done)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], schema.names
        )

    return kept(placed(pages, least).mapInArrow(run, schema), "warc-files")


class Members:
    """The gzip members of a file, one after the other, each inflated piece by piece."""

    def __init__(self, source: BinaryIO, piece: int = PIECE):
        self.source, self.piece = source, piece
        self.raw, self.read_so_far = b"", 0
        self.inflater = None

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(self.piece)
            self.read_so_far += len(self.raw)
        return bool(self.raw)

    def begin(self) -> int | None:
        """Go to the next member; its place in the file, or None at the end of the file."""
        if not self._more():
            return None
        self.inflater = zlib.decompressobj(wbits=31)
        return self.read_so_far - len(self.raw)

    def some(self) -> bytes:
        """The next bytes of the member, at most a piece; none at its end, whose checksum and length are then proved."""
        while not self.inflater.eof:
            if not self._more():
                raise DamagedArchive("the file ends inside a member")
            try:
                found = self.inflater.decompress(self.raw, self.piece)
            except zlib.error as broken:
                raise DamagedArchive(f"a member does not inflate: {broken}") from broken
            self.raw = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
            if found:
                return found
        return b""


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    payload_bytes: int = 0
    payload_digest: str = ""
    payload: bytes | None = None
    parts: list[bytes] = field(default_factory=list, repr=False)


def _head(members: Members, held: bytes, left: int | None = None) -> tuple[bytes | None, bytes]:
    """A head up to its empty line, and what follows it so far; no head if ``left`` bytes hold none."""
    while (at := held.find(END)) < 0:
        if left is not None and len(held) >= left:
            return None, held
        if len(held) > HEAD:
            raise DamagedArchive("a head is too long")
        if not (more := members.some()):
            raise DamagedArchive("a member ends inside a head")
        held += more
    return held[:at], held[at + len(END) :]


def _fields(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise DamagedArchive(f"not a record: {lines[0][:40]!r}")
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _proved(kind: str, declared: str | None, found: str) -> None:
    if declared is not None and declared.partition(":")[0] == "sha1" and declared.partition(":")[2] != found:
        raise DamagedArchive(f"{kind} digest {found} where {declared} is declared")


def read_records(source: BinaryIO, with_payload: bool = False, piece: int = PIECE) -> Iterator[Record]:
    """All records of an archive in their order; raises ``DamagedArchive`` at the first that is not sound."""
    members = Members(source, piece)
    while (offset := members.begin()) is not None:
        try:
            head, held = _head(members, b"")
            record = Record(offset, _fields(head))
            length = record.headers.get("content-length", "")
            if not re.fullmatch("[0-9]+", length):
                raise DamagedArchive("no content length")
            left = int(length)
            block, payload = hashlib.sha1(), hashlib.sha1()
            if record.headers.get("content-type", "").startswith("application/http"):
                message, rest = _head(members, held, left)
                if message is None or len(message) + len(END) > left:
                    raise DamagedArchive("no message head inside the block")
                block.update(message + END)
                left -= len(message) + len(END)
                held = rest
            while left:
                part, held = held[:left], held[left:]
                left -= len(part)
                record.payload_bytes += len(part)
                block.update(part)
                payload.update(part)
                if with_payload:
                    record.parts.append(part)
                if left and not (held := members.some()):
                    raise DamagedArchive("a member ends inside a block")
            while len(held) <= len(END) and (more := members.some()):
                held += more
            if held != END:
                raise DamagedArchive("the block does not end where its length says")
            encoded = lambda h: base64.b32encode(h.digest()).decode()
            _proved("block", record.headers.get("warc-block-digest"), encoded(block))
            record.payload_digest = encoded(payload)
            if record.headers.get("warc-type") != "revisit":
                _proved("payload", record.headers.get("warc-payload-digest"), record.payload_digest)
            if with_payload:
                record.payload, record.parts = b"".join(record.parts), []
        except DamagedArchive as broken:
            raise DamagedArchive(f"{broken}, in the record at byte {offset}") from broken
        yield record


READ = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("record_id", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("target_uri", T.StringType()), T.StructField("page_id", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("refers_to_id", T.StringType()), T.StructField("payload", T.BinaryType()),
])


def read_archives(files: DataFrame, with_payload: bool = False, piece: int = PIECE) -> DataFrame:
    """One row per record of the archives in ``files`` (path). Sizes are those found; digests of revisits those declared.

    The payload is null unless asked for. Archives are dealt out one by one: a gzip stream does not split.
    """
    ship_package(files.sparkSession)
    columns = [f.name for f in READ.fields]

    def rows(paths: Iterator[str]) -> Iterator[tuple]:
        for path in paths:
            store, at = fs.FileSystem.from_uri(path)
            with store.open_input_stream(at, compression=None, buffer_size=piece) as source:
                for r in read_records(source, with_payload, piece):
                    again = r.headers.get("warc-type") == "revisit"
                    declared = r.headers.get("warc-payload-digest", "").partition(":")[2]
                    yield (
                        path, r.offset, r.headers.get("warc-record-id"), r.headers.get("warc-type"), r.headers.get("warc-target-uri"),
                        r.headers.get("x-page-id"), None if again else r.payload_bytes, declared if again else r.payload_digest,
                        r.headers.get("warc-refers-to"), r.payload,
                    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        held, weight = [], 0
        flushed = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], columns)
        for row in rows(path for batch in batches for path in batch.column("path").to_pylist()):
            held.append(row)
            weight += 512 + len(row[-1] or b"")
            if weight > 1 << 22:
                yield flushed()
                held, weight = [], 0
        if held:
            yield flushed()

    n = max(1, files.count())
    return files.select("path").repartition(n).mapInArrow(run, READ)


def page_rows(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the pages among the records that were read.

    A revisit's size is that of the response it names, which must be there with the same digest.
    """
    slim = kept(records.where("record_type IN ('response', 'revisit')").drop("payload", "path", "offset", "target_uri"), "warc-read")
    first = slim.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("first_bytes"), F.col("payload_digest").alias("first_digest"),
    )
    again = slim.where("record_type = 'revisit'").join(first, "refers_to_id", "left")
    sound = F.col("payload_digest").eqNullSafe(F.col("first_digest"))
    again = again.select(
        "page_id",
        F.when(sound, F.col("first_bytes")).otherwise(F.raise_error(F.lit("a revisit names no response of its payload"))).alias("payload_bytes"),
        "payload_digest", "record_type", "refers_to",
    )
    own = slim.where("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("string").alias("refers_to")
    )
    return own.unionByName(again)


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages as archives into the shared folder and read these back."""
    files = write_archives(pages, work_dir(pages.sparkSession, "warc"), least)
    kind = pages.schema["page_id"].dataType
    found = page_rows(read_archives(files))
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})

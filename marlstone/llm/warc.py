"""WARC files as a PySpark Python data source.

`spark.read.format("warc")` plans a partition for each stretch of each file; predicates on record headers
are pushed down: a record's headers are parsed first, and its payload is decoded only if they
agree and payloads are wanted. Written files hold a gzip member for each record whose extra field tells the member's
length, so that a reader steps over what it doesn't want; other gzip members and plain files are read too.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from marlstone.llm.shared import attach, materialize

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_length long, refers_to string, content_length long, headers map<string,string>, payload binary"

#: Columns that stand in headers, so that predicates on them need no payload.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}

#: Bytes of a file after which a new partition may begin, and that are read at a time.
SPLIT, CHUNK = 32 << 20, 4 << 20
#: Revisits that are broadcast at most.
BROADCAST = 200_000

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest.json"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


# --- records ----------------------------------------------------------------------------------------


def member(record: bytes) -> bytes:
    """A gzip member with the lengths of itself and of the record in the extra field `sl`."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(record))
    return head + body + struct.pack("<II", zlib.crc32(record), len(record))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit that refers to the response of another page and holds none."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {page_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {page_urn(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def parse_headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first of repeated ones, continued lines joined."""
    found: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found.setdefault(name, value.strip())
    return found


class _Record:
    """A record whose headers are decoded, and whose block is only when asked for."""

    def __init__(self, head: bytes, rest) -> None:
        self.headers, self._rest = parse_headers(head), rest

    def block(self) -> bytes:
        return self._rest(int(self.headers.get("content-length", 0)))


class _File:
    """Bytes of a file, read in chunks."""

    def __init__(self, handle, size: int) -> None:
        self.handle, self.size, self.at, self.held = handle, size, 0, b""

    def bytes(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.held):
            self.at, self.held = at, self.handle.read_at(max(0, min(max(n, CHUNK), self.size - at)), at)
        return self.held[at - self.at : at - self.at + n]



def records(file: _File, start: int, end: int) -> Iterator[_Record]:
    """The records that begin in a stretch of a file."""
    at = start
    while at < end:
        first = file.bytes(at, 24)
        if first[:2] != b"\x1f\x8b":
            if first[:2] == b"\r\n":
                at += 2
                continue
            head = _until(lambda n, at=at: file.bytes(at, n), file.size - at)
            found = _Record(head, lambda n, at=at + len(head): file.bytes(at, n))
            yield found
            at += len(head) + int(found.headers.get("content-length", 0)) + 4
        elif first[3] & 4 and first[12:14] == b"sl":
            size = struct.unpack_from("<I", first, 16)[0]
            yield _member_record(file.bytes(at, size)[24:-8], -15)
            at += size
        else:  # a member of unknown length is inflated to its end
            inflate, taken, out = zlib.decompressobj(31), 0, []
            while not inflate.eof:
                piece = file.bytes(at + taken, min(CHUNK, file.size - at - taken))
                if not piece:
                    raise ValueError("a gzip member is cut off")
                out.append(inflate.decompress(piece))
                taken += len(piece)
            whole = b"".join(out)
            head = _until(lambda n, whole=whole: whole[:n], len(whole))
            yield _Record(head, lambda n, rest=whole[len(head) :]: rest[:n])
            at += taken - len(inflate.unused_data)


def _until(take, most: int) -> bytes:
    """Bytes up to and with the empty line."""
    n = 4096
    while (end := (data := take(min(n, most))).find(b"\r\n\r\n")) < 0:
        if n >= most:
            raise ValueError("a record has no end of headers")
        n *= 4
    return data[: end + 4]


def _member_record(body: bytes, bits: int) -> _Record:
    inflate = zlib.decompressobj(bits)
    data = inflate.decompress(body, 2048)
    while (end := data.find(b"\r\n\r\n")) < 0:
        more = inflate.decompress(inflate.unconsumed_tail, 1 << 16)
        if not more:
            raise ValueError("a record has no end of headers")
        data += more
    return _Record(data[: end + 4], lambda n: (data[end + 4 :] + inflate.decompress(inflate.unconsumed_tail))[:n])


# --- the data source ------------------------------------------------------------------------------------


@dataclass
class _Stretch(InputPartition):
    path: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.payloads, self.verify = options["path"], options.get("payload", "true") == "true", options.get("verify", "true") == "true"
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.tests.append((HEADERS[column], "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((HEADERS[column], "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((HEADERS[column], "starts", (f.value,)))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((HEADERS[column], "is", ()))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, path = _open(self.path)
        if system.get_file_info(path).type == fs.FileType.File:
            return [_Stretch(self.path, 0, system.get_file_info(path).size)]
        manifest = f"{path}/{MANIFEST}"
        if system.get_file_info(manifest).type == fs.FileType.File:
            files = json.loads(system.open_input_stream(manifest).read())
        else:
            found = [f for f in system.get_file_info(fs.FileSelector(path)) if re.search(r"\.warc(\.gz)?$", f.base_name)]
            files = [[f.base_name, [0, f.size]] for f in sorted(found, key=lambda f: f.base_name)]
        return [_Stretch(f"{self.path.rstrip('/')}/{name}", a, b) for name, cuts in files for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    def read(self, partition: _Stretch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no records, and so no stretches
            return
        system, path = _open(partition.path)
        schema = pa.schema([(name, pa.int64() if kind == "long" else pa.binary() if kind == "binary" else pa.map_(pa.string(), pa.string()) if kind.startswith("map") else pa.string()) for name, kind in (c.split() for c in SCHEMA.split(", "))])
        rows, size = [], 0
        with system.open_input_file(path) as handle:
            for found in records(_File(handle, handle.size()), partition.start, partition.end):
                h = found.headers
                if all(self._agrees(h.get(name), kind, values) for name, kind, values in self.tests):
                    rows.append(self._row(found))
                    size += len(rows[-1][-1] or b"")
                    if len(rows) >= 2000 or size > CHUNK:
                        yield self._batch(rows, schema)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows, schema)

    @staticmethod
    def _agrees(value: str | None, kind: str, values: tuple) -> bool:
        return value is not None and (kind == "is" or (kind == "in" and value in values) or (kind == "starts" and value.startswith(values[0])))

    def _row(self, found: _Record) -> tuple:
        h = found.headers
        payload, length, digest = None, None, h.get("warc-payload-digest")
        if h.get("content-type", "").startswith("application/http"):
            if self.payloads or h.get("warc-type") == "revisit":
                http, _, body = found.block().partition(b"\r\n\r\n")
                told = parse_headers(http).get("content-length")
                length = int(told) if told and told.isdigit() else None
                if h.get("warc-type") != "revisit":
                    payload, length = body, len(body)
        elif self.payloads:
            payload = found.block()
            length = len(payload)
        if self.verify and payload is not None and digest and digest.startswith("sha1:") and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest[5:]:
            raise ValueError(f"the payload of {h.get('warc-record-id')} isn't that of its digest")
        named = [h.get(HEADERS[c]) for c in ("record_id", "record_type", "target_uri", "payload_digest")]
        return (*named, length, h.get("warc-refers-to"), int(h.get("content-length", 0)), list(h.items()), payload)

    @staticmethod
    def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class _Written(WriterCommitMessage):
    name: str
    cuts: list[int]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows (page_id, url, html, refers_to); only files that a finished task told of are in the manifest."""

    def __init__(self, options: dict) -> None:
        self.path, self.date = options["path"].rstrip("/"), options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        name, cuts, size = f"part-{uuid.uuid4().hex}.warc.gz", [0], 0
        with system.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in iterator:
                for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    data = member(record(page_id, url, (html or "").encode(), refers_to, self.date))
                    out.write(data)
                    size += len(data)
                    if size - cuts[-1] >= SPLIT:
                        cuts.append(size)
        return _Written(name, [*cuts, size])

    def commit(self, messages: list[_Written | None]) -> None:
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{MANIFEST}") as out:
            out.write(json.dumps([[m.name, m.cuts] for m in messages if m is not None]).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        system, path = _open(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{path}/{m.name}")


class WarcDataSource(DataSource):
    """Options: path; for reading payload (false: none are decoded) and verify (payloads against digests); for writing date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the smallest page_id of the pages whose html of at least
    least_bytes is the same, where that is another; null for that page itself and for pages alone with theirs.

    Hashes are grouped, not pages, and those of a very common page stay where they are; only revisits are joined to pages, by page_id: no page's
    html meets another's.
    A null html counts as empty; a null page_id is a revisit where there is another page, and never the first. Repeated rows stay, and
    are alike: rows of one page_id and html are all first, or all revisits. Other columns are left out. An empty table gives no rows.
    """
    html = F.coalesce("html", F.lit(""))
    hashed = pages.filter(F.octet_length(html) >= least_bytes).select("page_id", F.sha1(html).alias("digest"))
    shared = hashed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    revisits = materialize(attach(hashed, materialize(shared, "shared"), "digest").filter("page_id > first OR page_id IS NULL").select("page_id", "digest", F.col("first").alias("refers_to")).distinct(), "revisits")
    few = revisits.limit(BROADCAST + 1).count() <= BROADCAST
    side = F.broadcast(revisits) if few else revisits
    keyed = pages.select("page_id", "url", "html", F.sha1(html).alias("digest"))
    return keyed.join(side, keyed.page_id.eqNullSafe(side.page_id) & (keyed.digest == side.digest), "left").select(keyed.page_id, "url", "html", "refers_to")


def archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write a record for each row of pages (page_id, url, html) to WARC files in a new folder.

    A null html is an empty payload, a null page_id or url is left out of the headers. Each repeated row is a record of its own;
    rows of the first page_id with that html are all responses. A page is one record, whose bytes, and those of its gzip
    member, are below 4 GiB, as a Spark value is. An empty table makes an archive without records. Other columns are not written.
    """
    register(pages.sparkSession)
    with_revisits(pages, least_bytes).write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of a file or folder, in no order; a folder without WARC files, or whose files are empty, gives no rows."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_number(urn: str):
    return F.regexp_extract(urn, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")

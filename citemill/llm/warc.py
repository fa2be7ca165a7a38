"""WARC archives as a Spark data source, and their writing with revisit records.

Source `warc`: reads .warc and .warc.gz files and writes .warc.gz, one gzip member per record. Partitions
are planned over files, large ones first; files that this source wrote are split at the members that
their manifest lists, others are read whole, whether a member holds one record or many. Option headers
names further headers (comma-separated) that become string columns, in lower case with _ for -.
Equality and IN predicates on record_type, uri, date, digest, record_id, content_type and on those
columns are pushed down: a record's header block is parsed first, and the payload of a record that
fails them is neither decoded nor, where its lengths are known (gzip extra field `sl`, or an
uncompressed file), read. Spark cannot push predicates on values of the map `headers`. Option
payload=false leaves all payloads out. Every write has a mark of its own, which is part of its files' names,
and lists its files in _manifest-<mark>.json when it commits. Readers take the files that the manifests of
their own folder list, and all files with other names, so writes can be appended and stand beside
foreign files, while files of failed, repeated or unfinished tasks are never read. Mode overwrite
replaces what the folder held, subfolders too, when the new files are complete. A record that ends
before its length, or a member that ends too soon, raises an error.

Headers: names as in WARC 1.1; those of Names below become columns, all are in `headers`. Line
breaks in values are percent-encoded. Null values are left out. Null html counts as empty. Rows
that share the smallest page_id of their payload are responses, so a repeated row repeats its
response; a null page_id is smallest only if there is no other. An empty table writes no file
and reads as no rows; other columns are ignored; records of any length are kept whole. A payload
that many pages share is dealt over several tasks.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..runtime import ship
from .common import keyed_join, new_place, table, written

SCHEMA = "record_type string, record_id string, uri string, date string, digest string, content_type string, headers map<string,string>, payload binary"
NAMES = {"record_type": "warc-type", "record_id": "warc-record-id", "uri": "warc-target-uri", "date": "warc-date", "digest": "warc-payload-digest", "content_type": "content-type"}
#: Bytes after which a task starts another file; bytes between places where readers may start.
FILE_BYTES, SPLIT_BYTES = 256 << 20, 4 << 20
#: Names of files that this source writes and of the lists of them: part-<mark of the write>-<number of the file>.warc.gz.
OWN, MANIFEST = re.compile(r"part-[0-9a-f]{32}-[0-9a-f]{32}\.warc\.gz"), re.compile(r"_manifest-[0-9a-f]{32}\.json")


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def member(data: bytes) -> bytes:
    """A gzip member whose extra field `sl` holds its compressed and uncompressed lengths."""
    body = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = body.compress(data) + body.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = 10 + 2 + 12 + len(packed) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + b"\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + packed + tail


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    clean = lambda v: v.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in v or "\n" in v else v
    lines = [f"{k}: {clean(v)}" for k, v in headers if v is not None] + [f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def parse_headers(data: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    name = ""
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def payload(headers: dict[str, str], block: bytes) -> bytes:
    """The block without its HTTP headers, if it has such."""
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


class _Stream:
    """The bytes of a file from a place on, decompressed across gzip members where it is zipped."""

    def __init__(self, file, zipped: bool, path: str):
        self.file, self.zipped, self.path = file, zipped, path
        self.held, self.raw, self.unpack = b"", b"", None
        self.member, self.sizes = 0, None

    def place(self) -> int | None:
        """Where in the file the next byte stands; None inside a gzip member."""
        if self.unpack is not None and self.unpack.eof:
            self.raw, self.unpack = self.unpack.unused_data, None
        return self.file.tell() - len(self.raw or self.held) if not self.held or not self.zipped and self.unpack is None else None

    def more(self, n: int) -> bool:
        """Holds further bytes; False at the end."""
        if not self.zipped:
            data = self.file.read(n)
            self.held += data
            return bool(data)
        if self.unpack is not None and self.unpack.eof:
            self.raw, self.unpack = self.unpack.unused_data, None
        data, self.raw = self.raw or self.file.read(n), b""
        if self.unpack is None:
            if len(data) < 24:
                data += self.file.read(24 - len(data))
            if not data:
                return False
            self.member, self.sizes = self.file.tell() - len(data), None
            if len(data) >= 24 and data[3] & 4 and data[12:14] == b"sl":
                self.sizes = struct.unpack("<II", data[16:24])
            self.unpack = zlib.decompressobj(31)
        elif not data:
            raise ValueError(f"{self.path}: a gzip member ends too soon")
        self.held += self.unpack.decompress(data)
        return True

    def upto(self, mark: bytes) -> bytes | None:
        """The bytes up to mark; None if nothing but line breaks is left."""
        while (at := self.held.find(mark)) < 0:
            if not self.more(2048):
                if self.held.strip():
                    raise ValueError(f"{self.path}: a header block ends too soon")
                return None
        found, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return found

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            self.held = b""
            if not self.more(max(n - have, 1 << 16) if not self.zipped else 1 << 16):
                raise ValueError(f"{self.path}: a record ends too soon")
            parts.append(self.held)
            have += len(self.held)
        data = b"".join(parts)
        self.held = data[n:]
        return data[:n]

    def skip(self, n: int, head: int | None) -> None:
        """Leaves n bytes out; head is the length of the header block before them if that began a member."""
        if not self.zipped and len(self.held) < n:
            self.file.seek(self.file.tell() + n - len(self.held))
            self.held = b""
        elif head is not None and self.sizes and self.sizes[1] == head + n and self.sizes[0]:
            self.file.seek(self.member + self.sizes[0])
            self.held, self.raw, self.unpack = b"", b"", None
        else:
            while n > len(self.held):
                n -= len(self.held)
                self.held = b""
                if not self.more(1 << 16):
                    raise ValueError(f"{self.path}: a record ends too soon")
            self.held = self.held[n:]


@dataclass
class Pieces(InputPartition):
    """Path, first byte and byte after the last place where a record may start, of parts of files."""

    pieces: list[tuple[str, int, int]]


def extra_columns(options: dict) -> dict[str, str]:
    """Column and header name of the further headers asked for."""
    names = [h.strip().lower() for h in options.get("headers", "").split(",") if h.strip()]
    return {h.replace("-", "_"): h for h in names}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.per_partition = int(options.get("partitionbytes", 16 << 20))
        self.columns = NAMES | extra_columns(options)
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else ()
            name = self.columns.get(column[0]) if len(column) == 1 else None
            if name and isinstance(f, EqualTo):
                self.wanted.append((name, frozenset([f.value])))
            elif name and isinstance(f, In):
                self.wanted.append((name, frozenset(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, path = _place(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
        sizes = {f.path: f.size for f in found if f.is_file and f.path.endswith((".warc", ".warc.gz"))}
        # A path of one file: its folder's manifests are not asked, it is read as it is.
        starts = {p: [0] for p in sizes if len(found) == 1 or not OWN.fullmatch(p.rpartition("/")[2])}
        for f in found:
            if MANIFEST.fullmatch(f.base_name):
                folder = f.path.rpartition("/")[0]
                listed = json.loads(system.open_input_stream(f.path).read())
                if lost := [n for n in listed if f"{folder}/{n}" not in sizes]:
                    raise FileNotFoundError(f"{folder}: {lost[0]} and {len(lost) - 1} more files that were written are gone")
                starts |= {f"{folder}/{n}": places for n, places in listed.items()}
        pieces = [(p, a, b) for p, places in starts.items() for a, b in zip(places, [*places[1:], sizes[p]], strict=True)]
        result: list[Pieces] = []
        held = self.per_partition
        for p, a, b in sorted(pieces, key=lambda x: (x[1] - x[2], x)):
            if held + b - a > self.per_partition:
                result.append(Pieces([]))
                held = 0
            result[-1].pieces.append((p, a, b))
            held += b - a
        return result or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        system, _ = _place(self.path)
        rows: list[tuple] = []
        held = 0
        for path, start, end in partition.pieces:
            for row in self.records(system, path, start, end):
                rows.append(row)
                held += len(row[1] or b"") + 500
                if held > 8 << 20:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple[dict, bytes | None]]) -> pa.RecordBatch:
        own = {column: pa.array([h.get(name) for h, _ in rows], pa.string()) for column, name in self.columns.items()}
        own["headers"] = pa.array([list(h.items()) for h, _ in rows], pa.map_(pa.string(), pa.string()))
        own["payload"] = pa.array([p for _, p in rows], pa.binary())
        names = [*NAMES, "headers", "payload", *[c for c in self.columns if c not in NAMES]]
        return pa.RecordBatch.from_arrays([own[n] for n in names], names)

    def records(self, system: fs.FileSystem, path: str, start: int, end: int) -> Iterator[tuple[dict, bytes | None]]:
        with system.open_input_file(path) as file:
            file.seek(start)
            data = _Stream(file, path.endswith(".gz"), path)
            while (at := data.place()) is None or at < end:
                head = data.upto(b"\r\n\r\n")
                if head is None:
                    break
                headers = parse_headers(head)
                length = int(headers.get("content-length", 0))
                if self.with_payload and all(headers.get(name) in values for name, values in self.wanted):
                    block = payload(headers, data.take(length))
                    data.take(4)
                    yield headers, block
                else:
                    data.skip(length + 4, None if at is None else len(head))
                    if not self.with_payload and all(headers.get(name) in values for name, values in self.wanted):
                        yield headers, None


@dataclass
class Written(WriterCommitMessage):
    places: dict[str, list[int]]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of headers (array of structs k, v) and block (binary)."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.overwrite, self.mark = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = _place(self.path)
        system.create_dir(path)
        found: dict[str, list[int]] = {}
        out, size, places = None, 0, [0]
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, places = f"part-{self.mark}-{uuid.uuid4().hex}.warc.gz", [0]
                    found[name] = places
                    out, size = system.open_output_stream(f"{path}/{name}", compression=None), 0
                if size - places[-1] > SPLIT_BYTES:
                    places.append(size)
                packed = member(record([(h["k"], h["v"]) for h in row["headers"]], row["block"]))
                out.write(packed)
                size += len(packed)
        if out is not None:
            out.close()
        return Written(found)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _place(self.path)
        system.create_dir(path)
        found = {n: places for m in messages if m is not None for n, places in m.places.items()}
        old = [f for f in system.get_file_info(fs.FileSelector(path)) if self.mark not in f.base_name] if self.overwrite else []
        with system.open_output_stream(f"{path}/_manifest-{self.mark}.json") as out:
            out.write(json.dumps(found).encode())
        for f in sorted(old, key=lambda f: not MANIFEST.fullmatch(f.base_name)):  # lists go before the files they name
            (system.delete_file if f.is_file else system.delete_dir)(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        system, path = _place(self.path)
        for name in (n for m in messages if m is not None for n in m.places):
            system.delete_file(f"{path}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return ", ".join([SCHEMA, *[f"`{c}` string" for c in extra_columns(self.options) if c not in NAMES]])

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: five hex digits make four letters."""
    digits = F.sha1(data)
    four = lambda k: F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0")
    return F.translate(F.upper(F.concat(*map(four, range(8)))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def archive(pages: DataFrame, path: str, least: int = 0, mode: str = "append") -> None:
    """Writes a record for every row of pages (page_id, url, html) to path; payloads of at least so many bytes are written once a call."""
    spark = pages.sparkSession
    register(spark)
    body = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("body"))
    sized = body.withColumn("digest", base32_sha1(F.col("body"))).withColumn("size", F.length("body"))
    keyed = sized.withColumn("same", F.concat_ws(":", "digest", F.col("size").cast("string")))
    firsts = keyed.where(F.col("size") >= least).groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    named = keyed_join(keyed, written(firsts), "same", "left")
    again = F.col("c").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    text = lambda c: c.cast("string")
    header = lambda k, v: F.struct(F.lit(k).alias("k"), text(v).alias("v"))
    headers = F.array(
        header("WARC-Type", F.when(again, "revisit").otherwise("response")),
        header("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))),
        header("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        header("WARC-Target-URI", F.col("url")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        header("X-Refers-To-Page", F.when(again, F.col("first"))),
        header("X-Page-Id", F.col("page_id")),
        header("X-Payload-Length", F.col("size")),
    )
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), text(F.col("size")), F.lit("\r\n\r\n")).cast("binary")
    block = F.when(again, http).otherwise(F.concat(http, F.col("body")))
    named.select(headers.alias("headers"), block.alias("block")).write.format("warc").mode(mode).save(path)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    path = new_place(spark, "warc")
    archive(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    numbers = "x-page-id,x-payload-length,x-refers-to-page"
    full = read(spark, path, headers=numbers).where("record_type = 'response'")
    short = read(spark, path, headers=numbers, payload="false").where("record_type = 'revisit'")

    def result(found: DataFrame, size: Column, digest: Column) -> DataFrame:
        return found.select(F.col("x_page_id").cast("long").alias("page_id"), size.cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", F.col("x_refers_to_page").cast("long").alias("refers_to"))

    return result(full, F.length("payload"), base32_sha1(F.col("payload"))).union(result(short, F.col("x_payload_length"), F.substring_index("digest", ":", -1)))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""

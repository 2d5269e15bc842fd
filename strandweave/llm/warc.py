"""WARC archives as a Python data source, read and written through Arrow batches.

Reading: one partition per archive file. Filters on ``record_type`` and on the header columns ``page_id``,
``target_uri`` and ``payload_digest`` are pushed to the reader; a record's headers are parsed first, and the payload of a record
that they rule out (or that nobody asked for, option ``payload`` = false) isn't decoded: members written here tell their
compressed length in gzip's extra field (subfield ``sl``, skip lengths, of the WARC specification), so the reader
goes on at the next member without reading the rest; in other archives the rest is passed over by Content-Length.
A folder without a manifest is read by its files' names: ``.warc`` and ``.warc.gz``, of any writer; so is one file.

Writing: each task writes archives of at most ``roll_mb`` under names of its own; only names that tasks committed are
listed in the commit's manifest, so a lost or repeated task leaves no records behind. Every commit has a manifest of its own and
readers go by all of them; mode ``overwrite`` removes earlier ones and their archives.

Archives of other writers: payloads are those of ``response`` (after the HTTP headers), ``resource`` and ``conversion`` records, as they
are stored: transfer and content encodings inside a response stay. ``refers_to`` and ``page_id`` are null where no header of this writer
names a page. While a commit in mode ``overwrite`` removes earlier ones, a reader may see both.

``archive`` makes a record for every page row: of rows with an equal payload (same SHA-1) of at least ``min_bytes`` the one
with the smallest page_id is a response, the others revisit it.

Defined cases: null html is an empty payload; null url has no target; null page_id sorts after all others and gets no id
header; repeated page_ids with equal payloads: all rows of the smallest page_id are responses (records of one page_id share their
WARC-Record-ID, which names the page); an empty table gives an
empty archive; other columns are ignored; a record is held in memory whole, however long, where its payload is asked for.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from ..shipping import ship
from .common import cut, drop_on_exit, shared_path, small_batches

SCHEMA = "page_id long, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload binary"
CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
#: A record's id carries its page_id in its last 16 hex digits.
ID = "urn:uuid:5741524f-0000-4000-{}-{}"


def record_id(page_id: int | None) -> str:
    x = f"{(page_id or 0) & (1 << 64) - 1:016x}"
    return "<" + ID.format(x[:4] if page_id is not None else "ffff", x[4:]) + ">"


OWN_ID = re.compile("<?" + ID.format("([0-9a-f]{4})", "([0-9a-f]{12})") + ">?")


def page_of(urn: str) -> int | None:
    """The page_id in an id of this writer; other writers' ids name no page."""
    found = OWN_ID.fullmatch(urn.strip())
    if not found:
        return None
    x = int(found[1] + found[2], 16)
    return x - (1 << 64) if x >> 63 else x


def number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,18}|-?[0-9]{19}", text) and -(1 << 63) <= int(text) < 1 << 63 else None


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def digest_column(payload: Column) -> Column:
    """Upper-case base32 SHA-1 in SQL: each 5 hex digits are 4 base-32 digits."""
    hexed = F.sha1(payload)
    chunks = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*chunks), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def local(path: str):
    """A pyarrow filesystem for the path's scheme, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def encode(row: dict) -> bytes:
    """One record, a gzip member of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + (row["payload"] or b"" if row["record_type"] == "response" else b"")
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", record_id(row["page_id"])), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + row["payload_digest"]), ("X-Payload-Length", str(row["payload_bytes"]))]
    if row["page_id"] is not None:
        fields.append(("X-Page-Id", str(row["page_id"])))
    if row["target_uri"] is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in row["target_uri"])))
    if row["record_type"] == "revisit":
        fields += [("WARC-Refers-To", record_id(row["refers_to"])), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return member(head.encode() + block + CRLF + CRLF)


#: Fixed values of gzip's format: a member's first bytes with an extra field, and that field's head for two lengths of 4 bytes.
MEMBER, SKIP = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff", struct.pack("<H2sH", 12, b"sl", 8)


def member(data: bytes) -> bytes:
    """A gzip member that tells its compressed and whole length; 0 where they don't fit."""
    coder = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = coder.compress(data) + coder.flush()
    size = len(MEMBER) + len(SKIP) + 8 + len(body) + 8
    lengths = (size, len(data)) if max(size, len(data)) < 1 << 32 else (0, 0)
    return MEMBER + SKIP + struct.pack("<II", *lengths) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Archive:
    """A plain or gzip-compressed archive (members of any writer) as a stream of its records' bytes."""

    CHUNK = 1 << 15

    def __init__(self, raw):
        self.raw, self.size, self.at = raw, raw.size() if callable(getattr(raw, "size", None)) else raw.seek(0, 2), 0
        raw.seek(0)
        self.ready, self.coder, self.end = b"", None, None
        self.packed = self._take(2) == MEMBER[:2]
        self._go(0)

    def _take(self, n: int) -> bytes:
        data = self.raw.read(n)
        self.at += len(data)
        return data

    def _go(self, at: int) -> None:
        self.raw.seek(at)
        self.at, self.ready, self.coder, self.end = at, b"", None, None

    def _more(self) -> bool:
        """More bytes to read; False at the archive's end."""
        if not self.packed:
            data = self._take(self.CHUNK)
            self.ready += data
            return bool(data)
        while True:
            if self.coder is None:
                start = self.at
                head = self._take(self.CHUNK)
                if not head:
                    return False
                self.coder = zlib.decompressobj(31)
                self.end = None
                if not self.ready:  # a record begins with the member
                    known = head[: len(MEMBER)][3:4] == b"\x04" and head[len(MEMBER) : len(MEMBER) + len(SKIP)] == SKIP
                    length = struct.unpack_from("<I", head, len(MEMBER) + len(SKIP))[0] if known and len(head) >= 24 else 0
                    self.end = start + length if length else None
            else:
                head = self._take(self.CHUNK)
                if not head:
                    raise ValueError("a WARC archive ends early")
            data = self.coder.decompress(head)
            if self.coder.eof:
                self.raw.seek(self.at - len(self.coder.unused_data))
                self.at -= len(self.coder.unused_data)
                self.coder = None
            if data:
                self.ready += data
                return True

    def readline(self) -> bytes:
        while (end := self.ready.find(b"\n") + 1) == 0:
            if not self._more():
                end = len(self.ready)
                break
        line, self.ready = self.ready[:end], self.ready[end:]
        return line

    def read(self, n: int) -> bytes:
        parts, left = [], n
        while left and (self.ready or self._more()):
            parts.append(self.ready[:left])
            self.ready = self.ready[len(parts[-1]) :]
            left -= len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        """Over the rest of a record's block, n bytes."""
        if not self.packed and n > len(self.ready):
            if self.at + n - len(self.ready) > self.size:
                raise ValueError("a WARC record ends early")
            self._go(self.at + n - len(self.ready))
        elif self.packed and self.coder is not None and self.end is not None:
            self._go(self.end)
        else:
            skip(self, n)


#: Records whose block is, or ends with, a payload.
PAYLOAD_TYPES = ("response", "resource", "conversion")


def records(stream, wanted, payload: bool) -> Iterator[dict]:
    """Records of a stream that ``wanted(headers)`` lets through."""
    pass_over = getattr(stream, "skip", None) or (lambda n: skip(stream, n))
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (CRLF, b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (CRLF, b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        left = int(head.get("content-length", 0))
        if not wanted(head):
            pass_over(left)
            continue
        body = None
        if payload and head.get("warc-type") in PAYLOAD_TYPES:
            block = take(stream, left)
            body = block[block.find(b"\r\n\r\n") + 4 :] if head.get("content-type", "").startswith("application/http") else block
        else:
            pass_over(left)
        yield head | {"payload": body}


def take(stream, n: int) -> bytes:
    out = stream.read(n)
    if len(out) != n:
        raise ValueError("a WARC record ends early")
    return out


def skip(stream, n: int) -> None:
    while n > 0:
        got = len(stream.read(min(n, 1 << 16)))
        if not got:
            raise ValueError("a WARC record ends early")
        n -= got


def digest_of(head: dict) -> str | None:
    """A payload's digest without the name of its algorithm."""
    digest = head.get("warc-payload-digest")
    return digest.partition(":")[2] if digest else None


def to_row(head: dict) -> tuple:
    size = number(head.get("x-payload-length"))
    if size is None and head["payload"] is not None:
        size = len(head["payload"])
    return number(head.get("x-page-id")), head.get("warc-type"), head.get("warc-target-uri"), digest_of(head), size, page_of(head.get("warc-refers-to", "")), head["payload"]


#: What a record's headers say of a column, as text.
HEADER_OF = {"record_type": lambda h: h.get("warc-type"), "target_uri": lambda h: h.get("warc-target-uri"), "page_id": lambda h: h.get("x-page-id"), "payload_digest": digest_of}


@dataclass
class ArchivePart(InputPartition):
    path: str


def manifests(path: str) -> dict[str, list[str]]:
    """Each commit's manifest and the archives that it lists; none for a single file."""
    from pyarrow import fs as files

    fs, root = local(path)
    if fs.get_file_info(root).type != files.FileType.Directory:
        return {}
    out = {}
    for info in fs.get_file_info(files.FileSelector(root)):
        if info.base_name.startswith("manifest") and info.base_name.endswith(".json"):
            with fs.open_input_stream(info.path) as f:
                out[info.path] = [f"{root}/{x}" for x in json.loads(f.read())]
    return out


def archives(path: str) -> list[str]:
    """Archives below a path: the committed ones, or where nothing was committed here all that have an archive's name."""
    from pyarrow import fs as files

    fs, root = local(path)
    if listed := manifests(path):
        return sorted(x for names in listed.values() for x in names)
    info = fs.get_file_info(root)
    if info.type == files.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == files.FileType.File else fs.get_file_info(files.FileSelector(root, recursive=True))
    return sorted(x.path for x in found if x.type == files.FileType.File and x.base_name.lower().endswith((".warc", ".warc.gz")))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.equal: list[tuple[Callable[[dict], str | None], set[str]]] = []

    def pushFilters(self, filters):
        for f in filters:
            header = HEADER_OF.get(f.attribute[0]) if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            values = (f.value,) if isinstance(f, EqualTo) else f.value if isinstance(f, In) else ()
            if header and all(v is not None for v in values):
                self.equal.append((header, {str(v) for v in values}))
            else:
                yield f

    def partitions(self):
        return [ArchivePart(x) for x in archives(self.path)] or [ArchivePart("")]

    def read(self, partition: ArchivePart):
        if not partition.path:
            return
        fs, _ = local(self.path)
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        wanted = lambda head: all(header(head) in values for header, values in self.equal)
        rows, size = [], 0
        with fs.open_input_file(partition.path) as raw:
            for head in records(Archive(raw), wanted, self.payload):
                rows.append(to_row(head))
                size += len(head["payload"] or b"")
                if len(rows) >= 2000 or size >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.roll, self.overwrite = options["path"], int(float(options.get("roll_mb", 64)) * (1 << 20)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = local(self.path)
        fs.create_dir(root, recursive=True)
        names, out, left = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                data = encode(row)
                if out is None or left < len(data):
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, left = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), self.roll
                out.write(data)
                left -= len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages) -> None:
        fs, root = local(self.path)
        fs.create_dir(root, recursive=True)
        before = manifests(self.path) if self.overwrite else {}
        with fs.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())
        for manifest, names in before.items():
            for old in (manifest, *names):
                fs.delete_file(old)

    def abort(self, messages) -> None:
        fs, root = local(self.path)
        for m in messages:
            for n in m.names if m else []:
                fs.delete_file(f"{root}/{n}")


class Warc(DataSource):
    """``spark.read.format("warc").load(path)``, ``df.write.format("warc").mode("append").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    ship(spark)
    spark.dataSource.register(Warc)


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows to write. Digests with several page_ids are summed up partially first and written, so the join back knows their size:
    Spark broadcasts them where they are few (html isn't shuffled then), and AQE can split a hot digest's rows where they aren't."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("payload_digest", digest_column(F.col("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    groups = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count("*").alias("n"))
    groups = groups.where((F.col("n") > 1) & F.col("first").isNotNull()).select(F.col("payload_digest").alias("g_digest"), "first")
    groups = cut(groups, "payloads")
    both = rows.join(groups, (F.col("payload_digest") == F.col("g_digest")) & (F.col("payload_bytes") >= min_bytes), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    kind = F.when(again, "revisit").otherwise("response")
    return both.select("page_id", kind.alias("record_type"), "target_uri", "payload_digest", "payload_bytes", F.when(again, F.col("first")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"))


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    spark = pages.sparkSession
    register(spark)
    small_batches(spark)
    archive(pages, min_bytes).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records below a path. Load anew for each query with filters of its own: Spark 4.1 keeps filters that were pushed to a Python
    data source with the loaded relation, so a second query on the same DataFrame would see the first one's."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages' archives below the shared folder and read all records back."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write(pages, path, min_bytes)
    drop_on_exit(spark, path)
    return read_archives(spark, path)


def verified(read_back: DataFrame) -> DataFrame:
    """Checks each response's payload against its headers; without the payload."""
    wrong = (F.col("record_type") == "response") & ((digest_column(F.col("payload")) != F.col("payload_digest")) | (F.octet_length("payload") != F.col("payload_bytes")))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("payload differs from its headers: page "), F.col("page_id").cast("string")))).otherwise(F.col("payload_digest"))
    return read_back.select("page_id", "payload_bytes", checked.cast("string").alias("payload_digest"), "record_type", "refers_to")

"""FASTA / FASTQ files as a DataFrame of records, and file-of-files expansion.

Files are listed by Spark; each is parsed by a small state machine on an executor, with gzip, xz and zstd by extension. Files of
stores that pyarrow opens are read as streams, so a task holds some records of a file, not the file; those of other
stores are read whole through Spark. A large file that isn't compressed is read by many tasks, each a range of its bytes. A record
keeps its file, its number in it and its full header line.
"""

from __future__ import annotations

import gzip
import io
import lzma
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import cut
from ..shipping import ship

COMPRESSED = {"gz": "gzip", "gzip": "gzip", "xz": "xz", "zst": "zstd", "zstd": "zstd"}
RECORD = "path string, record_idx long, header string, seq string"
#: Bytes of a range of a large file.
SPLIT = 128 << 20
_SPAN = "path string, start long, end long, found long, records long, next long, odd boolean"


class InvalidInput(ValueError):
    """A file that begins neither like FASTA nor like FASTQ."""


def codec_of(path: str) -> str | None:
    return COMPRESSED.get(path.rpartition(".")[2].lower()) if "." in os.path.basename(path) else None


def place(path: str):
    """A pyarrow filesystem for the path's scheme, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def streams(paths: list[str]) -> bool:
    """Whether pyarrow opens all of the paths' stores."""
    try:
        return all(place(p) for p in {p.partition("://")[0]: p for p in paths}.values())
    except (pa.ArrowInvalid, OSError, ValueError):
        return False


def opened(raw, path: str) -> io.TextIOBase:
    """Lines of a binary stream, decompressed by the path's extension."""
    codec = codec_of(path)
    if codec == "gzip":
        raw = gzip.GzipFile(fileobj=raw)
    elif codec == "xz":
        raw = lzma.LZMAFile(raw)
    elif codec == "zstd":
        import zstandard

        raw = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    return io.TextIOWrapper(raw, "latin-1", newline=None)


def parse(lines: io.TextIOBase) -> Iterator[tuple[str, str]]:
    """(header, sequence) of each record; qualities are ignored."""
    line = next((x for x in lines if x.strip()), None)
    if line is None:
        return
    if line[0] not in ">@":
        raise InvalidInput(f"Invalid record start: {line[:20]!r}")
    while line:
        kind, header, parts, line = line[0], line[1:].rstrip("\n"), [], lines.readline()
        while line and not line.startswith(">" if kind == ">" else "+"):
            parts.append(line.strip())
            line = lines.readline()
        text = "".join(parts)
        if kind == "@":  # as many qualities as bases follow; they may hold any character
            left, line = len(text), lines.readline()
            while line and left > 0:
                left -= len(line.rstrip("\n"))
                line = lines.readline()
            while line and not line.strip():
                line = lines.readline()
            if line and line[0] != "@":
                raise ValueError(f"record expected, found {line[:20]!r}")
        yield header, text


class Lines:
    """Lines of a binary stream, and where in the file the last one began."""

    def __init__(self, raw: io.BufferedIOBase, at: int):
        raw.seek(at)
        self.raw, self.at, self.after, self.odd = raw, at, at, False

    def readline(self) -> str:
        line = self.raw.readline()
        self.at, self.after = self.after, self.after + len(line)
        text = line.decode("latin-1").replace("\r\n", "\n")
        self.odd |= "\r" in text  # ends a line, too, where lines are counted as text
        return text

    def __iter__(self) -> Iterator[str]:
        return iter(self.readline, "")

    def to_next(self, end: int) -> bool:
        """Go to the next line's begin, if it is before ``end``."""
        while self.after < end:
            part = self.raw.readline(1 << 20)
            self.after += len(part)
            if not part or part.endswith(b"\n"):
                return bool(part) and self.after < end
        return False


def lines_of(path: str, content: bytes | None) -> io.TextIOBase:
    """A file's lines: of its content, or streamed from its store where that isn't given."""
    if content is not None:
        return opened(io.BytesIO(content), path)
    fs, inside = place(path)
    return opened(fs.open_input_stream(inside, compression=None), path)


def seekable(path: str) -> io.BufferedIOBase:
    fs, inside = place(path)
    return io.BufferedReader(fs.open_input_file(inside), 1 << 20)


def first_record(path: str, start: int, end: int) -> int | None:
    """Where the first record begins in these bytes: a FASTA header, or what looks like FASTQ's four lines."""
    raw = seekable(path)
    kind = raw.read(1 << 16).lstrip()[:1]
    lines = Lines(raw, start - 1)
    if not lines.to_next(end):
        return None
    held: list[tuple[int, str]] = []
    for line in lines:
        if kind == b">":
            if lines.at >= end:
                return None
            if line[0] == ">":
                return lines.at
            continue
        held = [*held[-3:], (lines.at, line.rstrip("\n"))]
        if held[0][0] >= end:
            return None
        if len(held) == 4:
            (at, head), (_, bases), (_, plus), (_, quality) = held
            if head[:1] == "@" and plus[:1] == "+" and (not bases or bases.isalpha()) and len(bases) == len(quality):
                return at
    return None


def scanned(path: str, start: int, end: int) -> tuple[int | None, int, int | None, bool]:
    """Of a range of a file: where its first record begins, how many begin in it, where the first one after it does, and whether
    the range could not be read alone."""
    found = first_record(path, start, end) if start else 0
    if found is None:
        return None, 0, None, False
    lines, n = Lines(seekable(path), found), 0
    try:
        for _ in parse(lines):
            n += 1
            if lines.at >= end:
                break
    except ValueError:
        return found, n, None, True
    return found, n, lines.at, lines.odd


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(r["path"], r["start"], r["end"], *scanned(r["path"], r["start"], r["end"])) for r in batch.to_pylist()]
        names = ["path", "start", "end", "found", "records", "next", "odd"]
        types = [pa.string(), *[pa.int64()] * 5, pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def spans(files: DataFrame, split: int) -> DataFrame:
    """path, start, end, first: what one task each reads of files (path, length). A file of at most ``split`` bytes, or a compressed one, is
    one span, without an end.

    A range of a larger one begins with the first record found in it, which takes a pass that counts records, too: ``first`` is the number
    of those before. That pass goes on to the next record after the range. Only if that is where the next range begins, at every
    edge, the ranges are what one task would read from the first byte on; else (FASTQ of more than four lines a record, a
    lone carriage return, text that isn't sequences) the file is one span."""
    packed = F.lower(F.substring_index("path", ".", -1)).isin(list(COMPRESSED))
    large = ~packed & (F.col("length") > split)
    whole = [F.lit(0).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(0).cast("long").alias("first")]
    n = files.where(large).agg(F.sum(F.ceil(F.col("length") / split))).first()[0]
    small = files.where(~large).select("path", *whole)
    if not n:
        return small
    ranges = files.where(large).select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("start"), "length")
    seen = cut(ranges.select("path", "start", F.least(F.col("start") + split, "length").alias("end")).repartition(int(n)).mapInArrow(_scan, _SPAN), "spans")
    order = Window.partitionBy("path").orderBy("start")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("next", True).over(past)
    fits = (F.col("start") == 0) | F.when(F.col("found").isNull(), before >= F.col("end")).otherwise(before == F.col("found"))
    checked = seen.withColumn("first", F.coalesce(F.sum("records").over(past), F.lit(0))).withColumn("fits", F.coalesce(fits, F.lit(False)) & ~F.col("odd"))
    checked = checked.withColumn("fits", F.min("fits").over(Window.partitionBy("path")))
    parts = checked.where("fits and records > 0").select("path", F.col("found").alias("start"), "end", "first")
    return small.unionByName(parts.repartition(int(n))).unionByName(checked.where("not fits and start = 0").select("path", *whole))


def read_fastx(spark: SparkSession, paths: list[str], on_invalid: str = "error", split: int | None = None) -> DataFrame:
    """path, record_idx, header, seq. on_invalid: ``error``, or ``skip`` to leave out files that aren't sequences. Files of more
    than ``split`` bytes (by default ``SPLIT``) are read in ranges (``spans``), if their store opens as a stream."""
    ship(spark)
    if on_invalid not in ("error", "skip"):
        raise ValueError("on_invalid must be error or skip")
    stream = streams(paths)
    files = spark.read.format("binaryFile").load(paths)
    if stream:
        files = spans(files.select("path", "length"), split or SPLIT)
    else:
        files = files.select("path", F.lit(0).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(0).cast("long").alias("first"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "record_idx", "header", "seq"]
        for batch in batches:
            contents = batch.column("content") if not stream else [None] * batch.num_rows
            for path, start, end, first, content in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end", "first")), contents):
                rows, size = [], 0
                try:
                    lines = lines_of(path, None if stream else content.as_py()) if end is None else Lines(seekable(path), start)
                    for i, (header, text) in enumerate(parse(lines), first):
                        rows.append((path, i, header, text))
                        size += len(text)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
                            rows, size = [], 0
                        if end is not None and lines.at >= end:
                            break
                except InvalidInput:
                    if on_invalid != "skip":
                        raise
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return files.mapInArrow(run, RECORD)


def invalid(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files that begin neither like FASTA nor like FASTQ, which ``skip`` leaves out: one row for each file, at most."""
    ship(spark)
    stream = streams(paths)
    files = spark.read.format("binaryFile").load(paths).select("path", *([] if stream else ["content"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1)):
                try:
                    next(parse(lines_of(path, None if stream else content.as_py())), None)
                except InvalidInput:
                    bad.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], ["path"])

    return sorted(r["path"] for r in files.mapInArrow(run, "path string").collect())


def expand_fofns(paths: list[str]) -> list[str]:
    """Paths that lists name, one a line, in order and with repeats; blank lines and comments are left out, relative ones are
    relative to their list."""
    out = []
    for path in paths:
        with open(path) as f:
            for line in f:
                line = line.strip()
                if line and not line.startswith("#"):
                    out.append(line if os.path.isabs(line) else os.path.join(os.path.dirname(path), line))
    if not out:
        raise ValueError("the lists name no file")
    return out


def read_datasets(spark: SparkSession, paths: list[str], on_invalid: str = "error") -> DataFrame:
    """Records of a list of datasets with dataset_id, the place in the list: a file listed twice is two datasets."""
    listed = spark.createDataFrame([(i, os.path.abspath(p)) for i, p in enumerate(paths)], "dataset_id long, d_path string")
    reads = read_fastx(spark, sorted(set(paths)), on_invalid)
    return reads.join(listed, F.regexp_replace("path", "^file:/*", "/") == F.col("d_path")).drop("d_path")

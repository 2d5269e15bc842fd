"""KFF files as a data source: ``df.write.format("kff")`` of (kmer, count), ``spark.read.format("kff").load(path)``.

A task writes one file, complete with header and trailer, whose records are in sections of a bounded number: a section's count
comes before its records, and stores can't go back. Files are made in a folder of the job, and those of tasks that count are moved to their
places when all are done, so a task that is repeated leaves nothing; no row passes the driver. The moves are one after the other: a
driver that is lost among them leaves some.

Records have a fixed size, so a file is read by many tasks, each a range of its bytes: they pass over other sections by their counts.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..shipping import ship
from .fastx import SPLIT, place
from .sinks import KFF_HEAD, KFF_MARK

SCHEMA = "kmer string, count long"
_ARROW = pa.schema([("kmer", pa.string()), ("count", pa.int64())])
#: Most records of a section, which a task holds packed; and of a batch that is read.
SECTION, BATCH = 1 << 20, 1 << 16
_CODES = np.full(256, 255, np.uint8)
_CODES[list(b"ACGT")] = range(4)
_SHIFTS = np.array([6, 4, 2, 0], np.uint8)


def head(k: int, m: int, threshold: int, size: int, ordered: bool, producer: str) -> bytes:
    """All before the first section of records."""
    text = f"producer={producer}\nk={k}\nm={m}\nthreshold={threshold}\nfilter=count>threshold\ncanonical=1\n".encode()
    values = {"k": k, "max": 1, "data_size": size, "ordered": int(ordered), "m": m, "threshold": threshold}
    return KFF_MARK + KFF_HEAD + struct.pack(">I", len(text)) + text + b"v" + struct.pack(">Q", len(values)) + b"".join(n.encode() + b"\0" + struct.pack(">Q", v) for n, v in values.items())


def pack(kmers: pa.Array, counts: pa.Array, k: int, size: int) -> np.ndarray:
    """A row of bytes for each record: right-aligned 2-bit bases and the big-endian count."""
    n, width = len(kmers), -(-k // 4)
    if kmers.null_count or counts.null_count:
        raise ValueError("a k-mer and its count must not be null")
    text = b"".join(s.encode() for s in kmers.to_pylist())
    if len(text) != n * k or any(len(s) != k for s in kmers.to_pylist()):
        raise ValueError(f"k-mers must have {k} bases")
    codes = _CODES[np.frombuffer(text, np.uint8)].reshape(n, k)
    if (codes > 3).any():
        raise ValueError("k-mers must be of A, C, G and T")
    numbers = counts.to_numpy(zero_copy_only=False).astype(np.int64)
    if n and (numbers.min() < 0 or (size < 8 and numbers.max() >= 1 << 8 * size)):
        raise ValueError(f"a count doesn't fit {size} bytes")
    padded = np.zeros((n, 4 * width), np.uint8)
    padded[:, 4 * width - k :] = codes
    bases = np.bitwise_or.reduce(padded.reshape(n, width, 4) << _SHIFTS, axis=2)
    return np.hstack([bases, numbers.astype(">u8").view(np.uint8).reshape(n, 8)[:, 8 - size :]])


def unpack(data: bytes, k: int, size: int, letters: bytes) -> pa.RecordBatch:
    width = -(-k // 4)
    rows = np.frombuffer(data, np.uint8).reshape(-1, width + size)
    codes = ((rows[:, :width, None] >> _SHIFTS) & 3).reshape(len(rows), 4 * width)[:, 4 * width - k :]
    text = np.frombuffer(letters, np.uint8)[codes].tobytes().decode()
    numbers = np.zeros((len(rows), 8), np.uint8)
    numbers[:, 8 - size :] = rows[:, width:]
    return pa.RecordBatch.from_arrays([pa.array([text[i : i + k] for i in range(0, len(text), k)], pa.string()), pa.array(numbers.view(">u8").ravel().astype(np.int64))], schema=_ARROW)


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str


class KffWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        k = int(options["k"])
        self.k, self.size, self.section = k, int(options.get("data_size") or (1 if k <= 32 else 8)), int(options.get("section", SECTION))
        if not 1 <= self.size <= 8 or k < 1 or self.section < 1:
            raise ValueError("data_size must be 1 to 8, k and section positive")
        self.head = head(k, int(options.get("m", 1)), int(options.get("threshold", 1)), self.size, options.get("ordered", "true") == "true", options.get("producer", "strandweave"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        number = TaskContext.get().partitionId()
        fs, root = place(f"{self.path}/_made-{self.job}")
        fs.create_dir(root, recursive=True)
        path = f"{root}/{number:05d}-{uuid.uuid4().hex}"
        with fs.open_output_stream(path, compression=None) as f:
            f.write(self.head)
            held, n = [], 0
            for batch in iterator:
                for at in range(0, batch.num_rows, self.section):
                    rows = pack(batch.column(0).slice(at, self.section), batch.column(1).slice(at, self.section), self.k, self.size)
                    while n + len(rows) >= self.section:
                        self.flush(f, [*held, rows[: self.section - n]])
                        rows, held, n = rows[self.section - n :], [], 0
                    if len(rows):
                        held.append(rows)
                        n += len(rows)
            if n:
                self.flush(f, held)
            f.write(KFF_MARK)
        return Part(number, path)

    def flush(self, f, held: list[np.ndarray]) -> None:
        f.write(b"r" + struct.pack(">Q", sum(map(len, held))) + b"".join(rows.tobytes() for rows in held))

    def commit(self, messages) -> None:
        fs, root = place(self.path)
        before = [i.path for i in listed(self.path)] if self.overwrite else []
        for m in messages:
            if m:
                fs.move(m.path, f"{root}/part-{m.number:05d}-{self.job}.kff")
        for old in before:
            fs.delete_file(old)
        self.clear()

    def abort(self, messages) -> None:
        self.clear()

    def clear(self) -> None:
        from pyarrow import fs as files

        fs, made = place(f"{self.path}/_made-{self.job}")
        if fs.get_file_info(made).type == files.FileType.Directory:
            fs.delete_dir(made)


def listed(path: str) -> list:
    """Files of a path, a folder's in order of their names."""
    from pyarrow import fs as files

    fs, root = place(path)
    info = fs.get_file_info(root)
    if info.type != files.FileType.Directory:
        return [info] if info.type == files.FileType.File else []
    return sorted((i for i in fs.get_file_info(files.FileSelector(root)) if i.type == files.FileType.File and i.base_name.endswith(".kff")), key=lambda i: i.base_name)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def exactly(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise ValueError("the KFF file ends within a section")
    return data


def sections(f, size: int) -> Iterator[tuple[int, int, dict[str, int], bytes]]:
    """(first byte, records, values, letters of the codes 0 to 3) of each section of records."""
    mark, head_ = exactly(f, 3), exactly(f, 5)
    if mark != KFF_MARK or head_[0] != 1:
        raise ValueError("not a KFF 1 file")
    codes = [head_[2] >> s & 3 for s in (6, 4, 2, 0)]
    letters = bytes(b"ACGT"[codes.index(c)] for c in range(4))
    f.seek(struct.unpack(">I", exactly(f, 4))[0], 1)
    values: dict[str, int] = {}
    while (kind := exactly(f, 1)) != KFF_MARK[:1]:
        if kind == b"v":
            for _ in range(struct.unpack(">Q", exactly(f, 8))[0]):
                name = b"".join(iter(lambda: exactly(f, 1), b"\0"))
                values[name.decode()] = struct.unpack(">Q", exactly(f, 8))[0]
        elif kind == b"r" and values.get("max") == 1:
            n = struct.unpack(">Q", exactly(f, 8))[0]
            at = f.tell()
            after = at + n * (-(-values["k"] // 4) + values["data_size"])
            if after > size:
                raise ValueError("the KFF file ends within a section")
            yield at, n, values, letters
            f.seek(after)
        else:
            raise ValueError(f"sections {kind!r} of KFF, or blocks of several k-mers, are not read")
    if exactly(f, 2) != KFF_MARK[1:]:
        raise ValueError("the KFF file has no end mark")


class KffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[Range]:
        found = listed(self.path)
        if not found:
            raise FileNotFoundError(f"no KFF file at {self.path}")
        return [Range(i.path, at, min(at + self.split, i.size)) for i in found for at in range(0, i.size, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """Records that begin in the range."""
        fs, _ = place(self.path)
        with fs.open_input_file(partition.path) as f:
            for at, n, values, letters in sections(f, f.size()):
                k, size = values["k"], values["data_size"]
                width = -(-k // 4) + size
                first, last = (min(n, max(0, -(-(edge - at) // width))) for edge in (partition.start, partition.end))
                for i in range(first, last, BATCH):
                    f.seek(at + i * width)
                    yield unpack(exactly(f, (min(last, i + BATCH) - i) * width), k, size, letters)


class Kff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> KffReader:
        return KffReader(self.options)

    def writer(self, schema, overwrite: bool) -> KffWriter:
        return KffWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Kff)


def write(counts: DataFrame, path: str, k: int, m: int = 1, threshold: int = 1, data_size: int | None = None, ordered: bool = True, section: int = SECTION, mode: str = "append", producer: str = "strandweave") -> int:
    """Counted k-mers (kmer, count) as a folder of KFF files, range-sorted, so that the files in name order are in order; returns how many.
    data_size as for ``sinks.write_kff``. Columns besides those two are ignored."""
    register(counts.sparkSession)
    size = data_size or (1 if k <= 32 else 8)
    n = F.lit(threshold + 1) if data_size is None and size == 1 else F.col("count")
    seen = Observation(path)
    rows = counts.select("kmer", n.cast("long").alias("count")).orderBy("kmer").observe(seen, F.count("*").alias("rows"))
    options = {"k": k, "m": m, "threshold": threshold, "data_size": size, "ordered": str(ordered).lower(), "section": section, "producer": producer}
    rows.write.format("kff").mode(mode).options(**options).save(path)
    return seen.get.get("rows", 0)


def read(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(kmer, count) of a KFF file or a folder of them; no order is promised."""
    register(spark)
    return spark.read.format("kff").option("split", split).load(path)

"""Windows looked up by numpy inside tasks in an index that is sent to them: sums for each row, and what lies between windows that the index has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import ship
from . import codes, stretches
from .codes import bases_of, mixed, scan

#: K-mers of an index that is sent to every task at most: 8 MB, below Spark's own threshold for tables that it broadcasts.
SENT = 1 << 20


class Lookup:
    """Sorted numbers behind a table of hashes, which most absent ones don't pass."""

    def __init__(self, numbers: np.ndarray) -> None:
        self.numbers = numbers
        bits = max(10, (16 * len(numbers) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[mixed(numbers) >> self.shift] = True

    def has(self, numbers: np.ndarray) -> np.ndarray:
        hit = self.table[mixed(numbers) >> self.shift]
        maybe = np.flatnonzero(hit)
        if len(maybe):
            found = numbers[maybe]
            at = np.minimum(np.searchsorted(self.numbers, found), len(self.numbers) - 1)
            hit[maybe] = self.numbers[at] == found
        return hit


def sent(kmers: DataFrame, k: int) -> Broadcast | None:
    """The numbers of an index of at most ``SENT`` distinct k-mers (kmer), sorted, for all tasks; None for a larger index or longer k-mers."""
    if k > codes.MOST_K or kmers.count() > SENT:
        return None
    numbers = kmers.where(F.length("kmer") == k).select(codes.number("kmer", k).alias("n")).toArrow().column("n")
    return kmers.sparkSession.sparkContext.broadcast(np.sort(numbers.to_numpy().astype(np.int64).view(np.uint64)))


def _sums(batches: Iterator[pa.RecordBatch], k: int, index: Broadcast, schema: list[str]) -> Iterator[pa.RecordBatch]:
    lookup = Lookup(index.value)
    total = np.zeros(2, np.int64)
    for batch in batches:
        data, starts = bases_of(batch.column(batch.num_columns - 1))
        all_, hits = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        for places, numbers, _ in scan(data, starts, k):
            if len(places):
                hit = lookup.has(numbers)
                first, last = np.searchsorted(starts, (places[0], places[-1]), "right") - 1
                edges = starts[first : last + 2]
                all_[first : last + 1] += np.diff(np.searchsorted(places, edges))
                hits[first : last + 1] += np.diff(np.searchsorted(places[hit], edges))
        total += (all_.sum(), hits.sum())
        if len(schema) > 2:
            rows = pa.array(np.flatnonzero(all_))
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[:-1]), pa.array(all_).take(rows), pa.array(hits).take(rows)], names=schema)
    if len(schema) == 2:
        yield pa.RecordBatch.from_arrays([pa.array(total[:1]), pa.array(total[1:])], names=schema)


def sums(reads: DataFrame, k: int, index: Broadcast, keys: list[str], col: str) -> DataFrame:
    """keys, scanned, filtered: windows, and those that the index has, of each row that has windows; without keys, of each task."""
    ship(reads.sparkSession)
    given = reads.select(*keys, F.col(col).alias("seq"))
    schema = StructType(given.schema.fields[:-1]).add("scanned", "long").add("filtered", "long")
    names = schema.fieldNames()
    return given.mapInArrow(lambda b: _sums(b, k, index, names), schema)


def _segments(batches: Iterator[pa.RecordBatch], k: int, index: Broadcast, name: str) -> Iterator[pa.RecordBatch]:
    lookup = Lookup(index.value)

    def absent(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, None]]:
        for places, numbers, _ in scan(data, starts, k):
            yield places[~lookup.has(numbers)], None

    for batch in batches:
        data, starts = bases_of(batch.column(1))
        at, n, _ = stretches.runs(absent(data, starts), starts, k)
        row, frag, start = stretches.located(data, starts, at)
        size = n + (k - 1)
        ends = np.cumsum(size)
        i = 0
        while i < len(at):
            to = max(i + 1, int(np.searchsorted(ends, ends[i] - size[i] + stretches.OUT, "right")))
            s = slice(i, to)
            offsets = np.append(0, np.cumsum(size[s]))
            bases = data[np.repeat(at[s] - offsets[:-1], size[s]) + np.arange(offsets[-1])] & 0xDF  # in capitals
            texts = pa.StringArray.from_buffers(to - i, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(bases.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[s])), pa.array(frag[s], pa.int32()), pa.array(start[s], pa.int32()), texts], names=[name, "frag", "start", "seq"])
            i = to


def segments(reads: DataFrame, k: int, index: Broadcast, record: str, col: str) -> DataFrame:
    """record, frag, start, seq of the maximal runs of windows that the index lacks. A record is one row, so nothing is shuffled."""
    ship(reads.sparkSession)
    given = reads.select(record, F.col(col).alias("seq"))
    schema = StructType(given.schema.fields[:1]).add("frag", "integer").add("start", "integer").add("seq", "string")
    return given.mapInArrow(lambda b: _segments(b, k, index, record), schema)


#: Bits of a filter's hash that tell its bitmap, which the built-in aggregate makes, and those inside it.
_MAP = 15


def _hashed(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        at = (mixed(numbers) % np.uint64(bits)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at >> _MAP), pa.array(at & (1 << _MAP) - 1)], names=["map", "bit"])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed numbers of an index, by bucket."""
    for batch in batches:
        bucket, kmers, _ = codes._deal(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([bucket, kmers], names=["bucket", "known"])


def _passed(batches: Iterator[pa.RecordBatch], k: int, filter_: Broadcast, key: bool) -> Iterator[pa.RecordBatch]:
    """key, bucket, scanned, kmers, n: what passes the filter, a row for each key and bucket; all windows of a key are in its first row's scanned."""
    bits = filter_.value
    size = np.uint64(8 * len(bits))
    held: dict[object, list[np.ndarray]] = {}
    scanned: dict[object, int] = {}
    kind, many = pa.null(), 0

    def flush() -> Iterator[pa.RecordBatch]:
        for value, total in scanned.items():
            found = np.concatenate(held.get(value, []) or [np.zeros(0, np.uint64)])
            bucket, kmers, n = codes._deal(found)
            if not len(bucket):
                bucket, kmers, n = pa.array([total % (1 << codes.BUCKET_BITS)], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())
            sums = np.zeros(len(bucket), np.int64)
            sums[0] = total
            keys = [pa.array([value] * len(bucket), kind)] if key else []
            yield pa.RecordBatch.from_arrays([*keys, bucket, pa.array(sums), kmers, n], names=[*(["key"] if key else []), "bucket", "scanned", "kmers", "n"])
        held.clear()
        scanned.clear()

    for batch in batches:
        data, starts = bases_of(batch.column(batch.num_columns - 1))
        names, of_row = [None], np.zeros(len(batch), np.int64)
        if key:
            kind = batch.column(0).type
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            names, of_row = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        for places, numbers, _ in scan(data, starts, k):
            if not len(places):
                continue
            at = mixed(numbers) % size
            may_be = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            found, of_found = numbers[may_be], of_row[np.searchsorted(starts, places[may_be], "right") - 1]
            first, last = np.searchsorted(starts, (places[0], places[-1]), "right") - 1
            totals = np.bincount(of_row[first : last + 1], np.diff(np.searchsorted(places, starts[first : last + 2])), len(names))
            for i in np.flatnonzero(totals).tolist():
                scanned[names[i]] = scanned.get(names[i], 0) + int(totals[i])
                held.setdefault(names[i], []).append(found[of_found == i])
            many += len(found)
            if many >= codes.HELD:
                yield from flush()
                many = 0
    yield from flush()


def _met(rows: pa.Table, index: pa.Table, key: bool) -> pa.Table:
    """One bucket: of each row the windows that the index has."""
    known = np.sort(codes._numbers(index.column("known"), np.uint64))
    kmers, n = codes._numbers(rows.column("kmers"), np.uint64), codes._numbers(rows.column("n"), np.int32)
    lengths = pc.fill_null(pc.binary_length(rows.column("kmers")), 0).to_numpy() // 8
    hit = known[np.minimum(np.searchsorted(known, kmers), len(known) - 1)] == kmers if len(known) else np.zeros(len(kmers), bool)
    ends = np.append(0, np.cumsum(np.where(hit, n, 0), dtype=np.int64))[np.append(0, np.cumsum(lengths))]
    return pa.table(({"key": rows.column("key")} if key else {}) | {"scanned": rows.column("scanned"), "filtered": pa.array(np.diff(ends))})


def probed(reads: DataFrame, kmers: DataFrame, k: int, bits: int, key: str | None, col: str) -> DataFrame:
    """key, scanned, filtered, to be added up: windows that a hashed bitmap of the index lacks are only counted, others meet the index by bucket.

    The bitmap of so many bits, made by tasks in parts, is sent to all."""
    spark = reads.sparkSession
    ship(spark)
    numbers = kmers.where(F.length("kmer") == k).select(codes.number("kmer", k).alias("kmer"))
    hashed = numbers.mapInArrow(lambda b: _hashed(b, bits), "map long, bit long")
    maps = hashed.groupBy("map").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow()
    whole = np.zeros(bits // 8, np.uint8)
    for number, part in zip(maps.column("map").to_pylist(), maps.column("bits").to_pylist(), strict=True):
        whole[number << _MAP - 3 : number + 1 << _MAP - 3] = np.frombuffer(part, np.uint8)
    filter_ = spark.sparkContext.broadcast(whole)
    given = reads.select(*([F.col(key).alias("key")] if key else []), F.col(col).alias("seq"))
    kind = f"key {given.schema['key'].dataType.simpleString()}, " if key else ""
    rows = given.mapInArrow(lambda b: _passed(b, k, filter_, bool(key)), kind + "bucket int, scanned long, kmers binary, n binary")
    index = numbers.mapInArrow(_indexed, "bucket int, known binary")
    return rows.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(lambda a, b: _met(a, b, bool(key)), kind + "scanned long, filtered long")

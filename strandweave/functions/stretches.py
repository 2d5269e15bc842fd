"""Super-k-mers made by numpy inside tasks: the stretches of windows that have one minimizer, packed to two bits a base or as runs with their
places; k up to ``codes.MOST_K``. A row for each window or a regular expression for each text costs Spark more than the window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import codes
from .codes import _CODES, _binary, _numbers, _rows, bases_of, canonical, letters_of, minima, mixed, scan

#: Windows of one packed stretch at most: their number is a byte.
MOST = 255
#: Windows of a bucket in what a task holds from which it is tried whether distinct numbers are fewer bytes than stretches.
MANY = 1 << 15
#: Rows, or bases, of one batch that a task passes on.
OUT = 1 << 20
PACKED = "bucket int, bases binary, windows binary, kmers binary, n binary"
_FOUR = np.array([[b >> 6, b >> 4 & 3, b >> 2 & 3, b & 3] for b in range(256)], np.uint8)


def runs(parts: Iterator[tuple[np.ndarray, np.ndarray | None]], starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(first place, windows, value) of the maximal runs of neighbouring windows that have one value, from places and values in order."""

    def firsts(at: np.ndarray, n: np.ndarray | int, values: np.ndarray | None) -> np.ndarray:
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != (at + n)[:-1]
        if values is not None:
            new[1:] |= values[1:] != values[:-1]
        if k == 1:  # windows of two rows can be neighbours
            new |= np.isin(at, starts)
        return np.flatnonzero(new)

    none = np.zeros(0, np.int64)
    found = [(none, none, none.astype(np.uint64))]
    for places, values in parts:
        f = firsts(places, 1, values)
        found.append((places[f], np.diff(f, append=len(places)), none.astype(np.uint64) if values is None else values[f]))
        valued = values is not None
    if len(found) == 1:
        return found[0]
    at, n, values = (np.concatenate(x) for x in zip(*found, strict=True))
    f = firsts(at, n, values if valued else None)
    return at[f], np.add.reduceat(n, f) if len(f) else n[:0], values[f] if valued else None


def base_runs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of bases begin and end (one past the last base); none crosses rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    base = _CODES[data] < 4
    rows = starts[starts < len(data)]
    begins, ends = base.copy(), np.append(base, False)
    begins[1:] &= ~base[:-1]
    begins[rows] = base[rows]
    ends[1:-1] = base[:-1] & ~base[1:]
    ends[-1:] = base[-1:]
    ends[0] = False
    inner = rows[rows > 0]
    ends[inner] = base[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends)


def located(data: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number of the run of bases in it, place in that run) of places that hold bases."""
    begins = base_runs(data, starts)[0]
    row = np.searchsorted(starts, at, "right") - 1
    of = np.searchsorted(begins, at, "right") - 1
    return row, of - np.searchsorted(begins, starts[row]), at - begins[of]


def _superkmers(batches: Iterator[pa.RecordBatch], k: int, m: int, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts = bases_of(batch.column(1))
        at, n, mins = runs(((p, x) for p, _, x in scan(data, starts, k, m, False)), starts, k)
        row, frag, start = located(data, starts, at)
        for i in range(0, len(at), OUT):
            s = slice(i, i + OUT)
            columns = [batch.column(0).take(pa.array(row[s])), pa.array(frag[s], pa.int32()), pa.array(start[s], pa.int32()), pa.array(n[s], pa.int64()), letters_of(mins[s])]
            yield pa.RecordBatch.from_arrays(columns, names=[name, "frag", "start", "windows", "minimizer"])


def superkmers(reads: DataFrame, k: int, m: int, record: str, col: str = "seq") -> DataFrame:
    """record, frag, start, windows, minimizer of the maximal runs of windows with one minimizer. A record is one row, so nothing is shuffled."""
    ship(reads.sparkSession)
    given = reads.select(record, F.col(col).alias("seq"))
    schema = given.select(record, *[F.lit(None).cast(t).alias(c) for c, t in (("frag", "int"), ("start", "int"), ("windows", "long"), ("minimizer", "string"))]).schema
    return given.mapInArrow(lambda b: _superkmers(b, k, m, record), schema)


def _sizes(batches: Iterator[pa.RecordBatch], k: int, m: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(4, np.int64)
    for batch in batches:
        data, starts = bases_of(batch.column(0))
        begins, ends = base_runs(data, starts)
        long = (ends - begins)[ends - begins >= k]
        n = runs(((p, x) for p, _, x in scan(data, starts, k, m, False)), starts, k)[1]
        total += (len(long), long.sum(), len(n), n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total.tolist()], names=["fragments", "bases", "runs", "windows"])


def sizes(reads: DataFrame, k: int, m: int, col: str = "seq") -> DataFrame:
    """One row: fragments (runs of at least k bases), their bases, runs of windows with one minimizer, windows. Sums of nothing are null."""
    ship(reads.sparkSession)
    each = reads.select(F.col(col).alias("seq")).mapInArrow(lambda b: _sizes(b, k, m), "fragments long, bases long, runs long, windows long")
    total = each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in each.columns])
    return total.select("fragments", F.expr("nullif(bases, 0)").alias("bases"), "runs", F.expr("nullif(windows, 0)").alias("windows"))


def _bytes(n: np.ndarray, k: int) -> np.ndarray:
    """Bytes of stretches of n windows: each begins with a byte."""
    return (n.astype(np.int64) + (k + 2)) // 4


def _stretches(data: np.ndarray, at: np.ndarray, n: np.ndarray, mins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, windows, minimizer, packed bases) of runs, cut into those of ``MOST`` windows."""
    parts = -(-n // MOST)
    if len(parts) and parts.max() > 1:
        number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at, mins = np.repeat(at, parts) + MOST * number, np.repeat(mins, parts)
        n = np.minimum(np.repeat(n, parts) - MOST * number, MOST)
    room = 4 * _bytes(n, k)
    taken = np.repeat(at - (np.cumsum(room) - room), room) + np.arange(room.sum())
    four = (_CODES[data[np.minimum(taken, len(data) - 1)]] & 3).reshape(-1, 4)  # the last byte's rest is any base
    return at, n.astype(np.uint8), mins, four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]


def _buckets(mins: np.ndarray) -> np.ndarray:
    return ((mins * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - codes.BUCKET_BITS)).astype(np.int64)


def _packed(batches: Iterator[pa.RecordBatch], k: int, m: int, hot: np.ndarray, key: bool, whole: bool = False) -> Iterator[pa.RecordBatch]:
    """A row for each key and bucket of minimizers of the stretches of some millions of windows; k-mers of hot minimizers are dealt out by themselves."""
    names: dict[object, int] = {}
    held: list[tuple[np.ndarray, ...]] = []
    loose: list[np.ndarray] = []
    kind, size = pa.null(), 0

    def out(group: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
        bucket = pa.array(group % (1 << codes.BUCKET_BITS), pa.int32())
        each = [columns.get(c, pa.nulls(len(group), pa.binary())) for c in ("bases", "windows", "kmers", "n")]
        keys = [pa.array(list(names), kind).take(pa.array(group >> codes.BUCKET_BITS))] if key else []
        return pa.RecordBatch.from_arrays([*keys, bucket, *each], names=[*(["key"] if key else []), "bucket", "bases", "windows", "kmers", "n"])

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            group, n, packed = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(group, kind="stable")
            room = _bytes(n, k)
            begins = (np.cumsum(room) - room)[order]
            group, n, room = group[order], n[order], room[order]
            ends = np.cumsum(room)
            packed = packed[np.repeat(begins - (ends - room), room) + np.arange(len(packed))]
            cuts = np.append(_rows(group), len(group))
            at = np.append(0, ends)[cuts]
            many = (np.add.reduceat(n.astype(np.int64), cuts[:-1]) >= MANY) & (not whole)
            few = []
            for i in np.flatnonzero(many).tolist():
                values, sums = counts_in(packed[at[i] : at[i + 1]], n[cuts[i] : cuts[i + 1]], k)
                if 12 * len(values) < at[i + 1] - at[i]:
                    few.append(i)
                    yield out(group[cuts[i : i + 1]], kmers=pa.array([values.tobytes()], pa.binary()), n=pa.array([sums.astype(np.int32).tobytes()], pa.binary()))
            rows = out(group[cuts[:-1]], bases=_binary(packed, at), windows=_binary(n, cuts))
            yield rows.filter(pa.array(~np.isin(np.arange(rows.num_rows), few))) if few else rows
        if loose:
            bucket, kmers, n = codes._deal(np.concatenate(loose))
            yield out(bucket.to_numpy().astype(np.int64), kmers=kmers, n=n)
        held.clear()
        loose.clear()

    for batch in batches:
        data, starts = bases_of(batch.column(batch.num_columns - 1))
        if key:
            kind = batch.column(0).type
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            ids = np.array([names.setdefault(x, len(names)) for x in coded.dictionary.to_pylist()], np.int64)
            of_row = ids[coded.indices.to_numpy(zero_copy_only=False)]
        for places, kmers, mins in scan(data, starts, k, m, bool(len(hot)), mixed):
            size += len(places)
            if len(hot):
                apart = np.isin(mins, hot)
                loose.append(kmers[apart])
                places, mins = places[~apart], mins[~apart]
            if len(places):
                at, n, mins, packed = _stretches(data, *runs(iter([(places, mins)]), starts, k), k)
                group = _buckets(mins)
                if key:
                    group |= of_row[np.searchsorted(starts, at, "right") - 1] << codes.BUCKET_BITS
                held.append((group, n, packed))
            if size >= codes.HELD * (4 if key else 1):  # a row of a key and a bucket is small
                yield from flush()
                size = 0
    yield from flush()


def _slices(packed: np.ndarray, n: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
    """(codes of the bases, where each stretch begins in them, which stretches) of packed stretches, some at a time."""
    room = 4 * _bytes(n, k)
    ends = np.cumsum(room)
    at = 0
    while at < len(n):
        begin = ends[at] - room[at]
        to = max(at + 1, int(np.searchsorted(ends, begin + codes.CHUNK, "right")))
        yield _FOUR[packed[begin // 4 : ends[to - 1] // 4]].ravel(), ends[at:to] - room[at:to] - begin, slice(at, to)
        at = to


def _sums(values: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What is distinct, sorted, and how often it is there, or the sums of n."""
    if n is None:
        values = np.sort(values)
    else:
        order = np.argsort(values)
        values, n = values[order], n[order]
    firsts = _rows(values)
    sums = np.diff(firsts, append=len(values)) if n is None else np.add.reduceat(n, firsts) if len(firsts) else n
    return values[firsts], sums.astype(np.int64)


def counts_in(packed: np.ndarray, n: np.ndarray, k: int, kept: np.ndarray | None = None, more: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the canonical k-mers of packed stretches (of those kept) and how often each is there, with ``more`` counts added. What repeats is summed
    up every some millions of windows."""
    held: list[np.ndarray] = []
    parts = [more] if more else []
    size = 0
    for bases, first, s in _slices(packed, n, k):
        here = n[s].astype(np.int64)
        if kept is not None:
            here = here * kept[s]
        windows = np.repeat(first - (np.cumsum(here) - here), here) + np.arange(here.sum())
        held.append(canonical(bases, k)[windows])
        size += len(windows)
        if size >= codes.HELD:
            parts.append(_sums(np.concatenate(held)))
            held, size = [], 0
    if held or not parts:
        parts.append(_sums(np.concatenate(held or [np.zeros(0, np.uint64)])))
    if len(parts) == 1 and not more:
        return parts[0]
    return _sums(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def often(packed: np.ndarray, n: np.ndarray, k: int, m: int, least: int) -> np.ndarray:
    """Which stretches have a minimizer with more than ``least`` windows; all stretches of a minimizer must be there."""
    mins = np.concatenate([minima(mixed(canonical(bases, m)), k - m + 1)[first] for bases, first, _ in _slices(packed, n, k)] or [np.zeros(0, np.uint64)])
    values, sums = _sums(mins, n.astype(np.int64))
    return sums[np.searchsorted(values, mins)] > least


def counted(table: pa.Table, k: int, least: int = 0, m: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts above ``least`` of the k-mers of one bucket's rows; with m, windows of minimizers that are too rare are left out
    first (all stretches of such a minimizer must have come as stretches: ``whole``)."""
    packed, n = _numbers(table.column("bases"), np.uint8), _numbers(table.column("windows"), np.uint8)
    numbers = _numbers(table.column("kmers"), np.uint64)
    kept = often(packed, n, k, m, least) if m else None
    values, sums = counts_in(packed, n, k, kept, (numbers, _numbers(table.column("n"), np.int32).astype(np.int64)) if len(numbers) else None)
    return values[sums > least], sums[sums > least]


def dealt(reads: DataFrame, k: int, m: int, hot: list[int] | None = None, key: str | None = None, col: str = "seq", whole: bool = False) -> DataFrame:
    """key, bucket, bases, windows, kmers, n: packed stretches of the windows that have one minimizer, dealt to buckets by its number in ``mixed`` order; a
    k-mer has one minimizer wherever it stands, so a bucket has all of it. Windows of ``hot`` minimizers (not with a key), and of a bucket where that
    is smaller (but with ``whole``), come as numbers of k-mers and how often each is there. No shuffle."""
    ship(reads.sparkSession)
    given = reads.select(*([F.col(key).alias("key")] if key else []), F.col(col).alias("seq"))
    kind = f"key {given.schema['key'].dataType.simpleString()}, " if key else ""
    apart = np.array(sorted(hot or []), np.int64).view(np.uint64)
    return given.mapInArrow(lambda b: _packed(b, k, m, apart, bool(key), whole), kind + PACKED)


def summed(rows: DataFrame, k: int, least: int = 0, m: int | None = None) -> DataFrame:
    """kmer, count of what was dealt without a key."""
    ship(rows.sparkSession)

    def one(table: pa.Table) -> pa.Table:
        numbers, n = counted(table, k, least, m)
        return pa.table({"kmer": letters_of(numbers), "count": pa.array(n, pa.int64())})

    return rows.groupBy("bucket").applyInArrow(one, "kmer string, count long")

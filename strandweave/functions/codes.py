"""K-mers as numbers, made by numpy inside tasks: a 1 and then two bits a base, for k up to 31; longer ones stay strings.

A window costs a dozen bytes of a shuffle and a comparison of two numbers instead of strings. The 1 tells a number's length, and numbers of
one length have the order of their texts. Sequences may hold anything between the bases, in either case: a window is of one run of bases in one row.
Numbers are made by doubling (2, 4, 8 ... bases from two of half as many), on both strands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import seq as s

MOST_K = 31
#: Bases that are numbered at a time (arrays stay in the cache), and windows that a task holds before it passes on what is distinct in them.
CHUNK, HELD = 1 << 15, 1 << 22
#: Buckets that k-mers are dealt to: at 3 billion distinct ones, 12 MB each.
BUCKET_BITS = 11
_CODES = np.full(256, 4, np.uint8)
_CODES[list(b"ACGT")] = _CODES[list(b"acgt")] = range(4)
_LETTERS = np.frombuffer(b"ACGT", np.uint8)


def canonical(codes: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the canonical k-mers at all starts; where there is a gap, some number."""
    powers = [(f := (codes & 3).astype(np.uint64), np.uint64(3) - f)]
    size, n, forward, back = 1, 0, None, None
    while True:
        pf, pr = powers.pop()
        if k & size:
            if n:
                forward = (forward[: len(pf) - n] << np.uint64(2 * size)) | pf[n : n + len(forward)]
                back = (pr[n : n + len(back)] << np.uint64(2 * n)) | back[: len(pr) - n]
            else:
                forward, back = pf, pr
            n += size
        if n == k:
            return np.minimum(forward, back) | np.uint64(1 << 2 * k)
        shift = np.uint64(2 * size)
        powers.append(((pf[:-size] << shift) | pf[size:], (pr[size:] << shift) | pr[:-size]))
        size *= 2


def minima(numbers: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    size = 1
    while size < width:
        step = min(size, width - size)
        numbers, size = np.minimum(numbers[:-step], numbers[step:]), size + step
    return numbers


def bases_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, and where each begins (and the last ends)."""
    texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8), offsets - offsets[0]


def mixed(numbers: np.ndarray) -> np.ndarray:
    """Numbers in an order of their own, one to one: minimizers in this order are not mostly those of runs of A."""
    numbers = numbers * np.uint64(0x9E3779B97F4A7C15)
    numbers ^= numbers >> np.uint64(32)
    return numbers * np.uint64(0xD6E8FEB86659FD93)


def scan(data: np.ndarray, starts: np.ndarray, k: int, m: int | None = None, kmers: bool = True, order: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """(places in data, numbers of the k-mers, numbers of their minimizers) of the windows, some at a time, in order. m: the minimizers' length;
    order: what the minimizers' numbers become before the smallest is taken."""
    edges = starts[1:-1]
    for at in range(0, len(data), CHUNK):
        codes = _CODES[data[at : at + CHUNK + k - 1]]
        if (n := len(codes) - k + 1) < 1:
            return
        gaps = np.cumsum(codes > 3, dtype=np.int32)
        whole = gaps[k - 1 :] == gaps[:n]
        whole &= codes[:n] < 4
        here = edges[np.searchsorted(edges, at, "right") : np.searchsorted(edges, at + len(codes))] - at
        crossing = (here[:, None] - np.arange(1, k)).ravel()
        whole[crossing[(crossing >= 0) & (crossing < n)]] = False
        places = np.flatnonzero(whole)
        found = canonical(codes, k)[places] if kmers else None
        mins = None
        if m:
            mers = canonical(codes, m)
            mins = minima(order(mers) if order else mers, k - m + 1)[places]
        yield places + at, found, mins


def letters_of(numbers: np.ndarray) -> pa.Array:
    """K-mers of one or several lengths as text."""
    if not len(numbers):
        return pa.array([], pa.string())
    numbers = numbers.astype(np.uint64)
    lengths = (np.frexp(numbers.astype(np.float64))[1] - 1) // 2
    # a double may round up to the next power of two: that can't change the bit that a 1 before the bases has, unless all are T
    lengths = np.where(numbers >> (2 * lengths).astype(np.uint64) == 0, lengths - 1, lengths)
    if (k := int(lengths[0])) != int(lengths.max()) or k != int(lengths.min()):
        return pa.array(["".join("ACGT"[int(x) >> 2 * i & 3] for i in range(int(n) - 1, -1, -1)) for x, n in zip(numbers, lengths, strict=True)], pa.string())
    text = np.empty((len(numbers), k), np.uint8)
    for i in range(k):
        text[:, i] = _LETTERS[((numbers >> np.uint64(2 * (k - 1 - i))) & np.uint64(3)).astype(np.uint8)]
    return pa.StringArray.from_buffers(len(numbers), pa.py_buffer((np.arange(len(numbers) + 1, dtype=np.int32) * k).tobytes()), pa.py_buffer(text.tobytes()))


def text(number: str | Column) -> Column:
    """K-mers' numbers as text; strings stay as they are only by ``text_of``."""

    @F.arrow_udf("string")
    def kmer(x: pa.Array) -> pa.Array:
        return letters_of(x.to_numpy(zero_copy_only=False))

    return kmer(s.of(number))


def with_text(df: DataFrame, k: int, c: str = "kmer") -> DataFrame:
    """``df`` with the numbers of a column as text."""
    return df if k > MOST_K else df.withColumn(c, text(c))


def number(kmer: str | Column, k: int) -> Column:
    """The number of a k-mer's text, as it stands; for a longer one the text."""
    kmer = s.of(kmer)
    return kmer if k > MOST_K else F.conv(F.concat(F.lit("1"), F.translate(kmer, "ACGT", "0123")), 4, 10).cast("long")


def _rows(sorted_numbers: np.ndarray) -> np.ndarray:
    """Where each value of sorted numbers begins. (numpy's own unique hashes, which takes ten times as long.)"""
    return np.flatnonzero(np.concatenate([[True], sorted_numbers[1:] != sorted_numbers[:-1]])) if len(sorted_numbers) else np.zeros(0, int)


def _binary(numbers: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * numbers.itemsize).astype(np.int32).tobytes()), pa.py_buffer(numbers.tobytes())])


def _deal(numbers: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(bucket, numbers, how often each) of what is distinct."""
    numbers = np.sort(numbers)
    firsts = _rows(numbers)
    values, counts = numbers[firsts], np.diff(firsts, append=len(numbers)).astype(np.int32)
    buckets = ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)
    order = np.argsort(buckets, kind="stable")
    buckets = buckets[order]
    cuts = np.append(_rows(buckets), len(buckets))
    return pa.array(buckets[cuts[:-1]].astype(np.int32)), _binary(values[order], cuts), _binary(counts[order], cuts)


def _dealt(batches: Iterator[pa.RecordBatch], k: int, m: int | None, key: bool, order: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Windows of a task's rows, held until there are many: a row for each key and bucket of what is distinct in them."""
    held: dict[object, list[np.ndarray]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for value, parts in held.items():
            bucket, kmers, n = _deal(np.concatenate(parts))
            yield pa.RecordBatch.from_arrays([*([pa.array([value] * len(bucket), kind)] if key else []), bucket, kmers, n], names=[*(["key"] if key else []), "bucket", "kmers", "n"])
        held.clear()

    kind = None
    for batch in batches:
        data, starts = bases_of(batch.column(batch.num_columns - 1))
        if key:
            kind = batch.column(0).type
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            names, of = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            of_row = np.append(of, 0).astype(np.uint16 if len(names) < 1 << 16 else np.int32)
        for places, kmers, mins in scan(data, starts, k, m, m is None, order):
            numbers = kmers if m is None else mins
            size += len(numbers)
            if not len(numbers):
                continue
            if not key:
                held.setdefault(None, []).append(numbers)
            else:
                first, last = np.searchsorted(starts, (places[0], places[-1]), "right") - 1
                here = of_row[np.repeat(np.arange(first, last + 1), np.diff(np.clip(np.searchsorted(places, starts[first : last + 2]), 0, len(places))))]
                by = np.argsort(here, kind="stable")
                cuts = np.append(_rows(here[by]), len(here))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    held.setdefault(names[here[by[a]]], []).append(numbers[by[a:b]])
            if size >= HELD:
                yield from flush()
                size = 0
    yield from flush()


def _numbers(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([bases_of(c)[0].view(kind) for c in column.chunks] or [np.zeros(0, kind)])


def _summed(table: pa.Table, least: int, key: bool, as_text: bool, out: str) -> pa.Table:
    """One bucket: kmer and its count, or its number of datasets that aren't null, above ``least``; or its distinct pairs with datasets."""
    if key:
        table = table.take(pc.sort_indices(table.column("key")))  # nulls are last
    kmers = _numbers(table.column("kmers"), np.uint64)
    order = np.argsort(kmers, kind="stable" if key else None)
    kmers = kmers[order]
    if key:
        coded = table.column("key").combine_chunks().dictionary_encode(null_encoding="encode")
        of = coded.indices.to_numpy(zero_copy_only=False)
        lengths = pc.binary_length(table.column("kmers")).to_numpy() // 8
        of = np.repeat(of, lengths)[order]
        new = np.ones(len(kmers), bool)
        new[1:] = (kmers[1:] != kmers[:-1]) | (of[1:] != of[:-1])
        known = pc.is_valid(coded.dictionary).to_numpy(zero_copy_only=False)
        if out == "pairs":
            at = np.flatnonzero(new)
            return pa.table({"kmer": kmers[at].view(np.int64), "key": coded.dictionary.take(pa.array(of[at]))})
        n = (new & known[of]).astype(np.int64)
    else:
        n = _numbers(table.column("n"), np.int32)[order].astype(np.int64)
    firsts = _rows(kmers)
    sums = np.add.reduceat(n, firsts) if len(firsts) else np.zeros(0, np.int64)
    often = sums > least
    kmers = kmers[firsts][often]
    return pa.table({"kmer": letters_of(kmers) if as_text else pa.array(kmers.view(np.int64)), "n": pa.array(sums[often])})


def dealt(reads: DataFrame, k: int, key: str | None = None, col: str = "seq", m: int | None = None, order: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """key, bucket, kmers, n: packed numbers of canonical k-mers (of windows' minimizers, with m), a row for each bucket of what is distinct in some millions
    of windows, and how often each is there (not with ``key``); k up to 31. A row for each window costs Spark more than the window. No shuffle."""
    ship(reads.sparkSession)
    given = reads.select(*([F.col(key).alias("key")] if key else []), F.col(col).alias("seq"))
    kind = f"key {given.schema['key'].dataType.simpleString()}, " if key else ""
    rows = given.mapInArrow(lambda b: _dealt(b, k, m, bool(key), order), kind + "bucket int, kmers binary, n binary")
    return rows.drop("n") if key else rows


def gathered(rows: DataFrame, least: int = 0, as_text: bool = True, pairs: bool = False) -> DataFrame:
    """kmer, n of what was dealt: k-mers found more than ``least`` times, or with more than so many keys; with ``pairs`` the distinct kmer, key.

    A frequent k-mer is one number of each row. Buckets are a part in 2^BUCKET_BITS of the distinct k-mers, and sorted where they meet."""
    ship(rows.sparkSession)
    key = "key" in rows.columns
    schema = f"kmer long, key {rows.schema['key'].dataType.simpleString()}" if pairs else f"kmer {'string' if as_text else 'long'}, n long"
    return rows.groupBy("bucket").applyInArrow(lambda t: _summed(t, least, key, as_text, "pairs" if pairs else "sums"), schema)


def summed(reads: DataFrame, k: int, least: int = 0, key: str | None = None, col: str = "seq", m: int | None = None, as_text: bool = True) -> DataFrame:
    return gathered(dealt(reads, k, key, col, m), least, as_text)

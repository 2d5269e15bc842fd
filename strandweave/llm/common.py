"""Shared helpers: table access, lineage cuts, and vectorised byte work on Arrow text columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession

from ..lineage import cut, cut_by, drop_on_exit, release, shared_path  # noqa: F401
from ..shipping import ship

#: Bytes of text that one vectorised step handles; a longer document is a step of its own.
STEP_BYTES = 1 << 21
#: Text bytes and rows of one Arrow batch sent to a Python worker.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000
#: Rows of a batch of a few numbers each.
NARROW_ROWS = 1 << 16

_U = np.uint64
_P = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what a Python worker holds at once: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """rows: of a batch at most, while the plan is run before the next call of this."""
    small_batches(df.sparkSession, rows)
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, and the offsets of its rows in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(pc.cast(column, pa.large_binary()), b"")
    n, at = len(column), column.offset
    buffers = column.buffers()
    if not n or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[at : at + n + 1]
    return np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes each, or one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """True for bytes outside of the ranges."""
    out = np.ones(256, bool)
    for a, b in ranges:
        out[a : b + 1] = False
    return out


#: `[^\x20\x09-\x0D]` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` on lower-cased bytes. Bytes of a character beyond ASCII are word bytes in both, so words of bytes are words of characters.
NOT_SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes; none crosses a row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.zeros(n + 2, bool)
    word[1:-1] = kind[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets[(offsets >= 0) & (offsets <= n)]] = True
    left = word[1:] & (~word[:-1] | edge)
    right = word[:-1] & (~word[1:] | edge)
    return np.flatnonzero(left), np.flatnonzero(right)


#: The fields of fingerprints: numbers modulo a prime, so no construction makes equal fingerprints whatever the base is.
_PRIME, _BITS = (1 << 31) - 1, 31
_P31, _B31 = _U(_PRIME), _U(_BITS)
#: Bases and values of bytes, drawn once: two fields for a fingerprint, and two others for a second one.
_draws = np.random.default_rng(20240229)
_BASES = [int(x) for x in _draws.integers(1 << 16, _PRIME - 1, 4)]
_VALUES = _draws.integers(1, _PRIME, (4, 256), dtype=np.uint64)
_SALTS = _draws.integers(1, 1 << 63, 4, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}
_SLICE = 1 << 14


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo the prime; kept for the sizes of a step."""
    old = _powers.get(base)
    if old is None or len(old) <= n:
        old, size = np.ones(1, np.uint64), max(n, STEP_BYTES) + 1
        while len(old) < size:
            old = np.concatenate([old, old[: size - len(old)] * _U(pow(base, len(old), _PRIME)) % _P31])
        if n <= 4 * STEP_BYTES:
            _powers[base] = old
    return old


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class Hasher:
    """64-bit fingerprints of slices of ``data`` (bytes, or other numbers) from prefix sums of polynomials in two fields of 31 bits."""

    def __init__(self, data: np.ndarray, second: bool = False):
        """second: in two other fields, independent of the first."""
        n, self.fields = len(data), []
        for k in (2, 3) if second else (0, 1):
            sums, power = np.zeros(n + 1, np.uint64), _power(_BASES[k], n)
            for at in range(0, n, _SLICE):  # small enough for the processor's cache
                part = data[at : at + _SLICE]
                values = _VALUES[k].take(part) if data.dtype == np.uint8 else mix(part.astype(_U) ^ _SALTS[k]) % _P31
                values *= power[at : at + len(part)]
                high = values >> _B31
                values &= _P31
                values += high
                values[0] += sums[at]
                np.cumsum(values, out=sums[at + 1 : at + 1 + len(part)])
            self.fields.append((sums, _power(pow(_BASES[k], -1, _PRIME), n)))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        one, two = ((sums[ends] - sums[starts]) % _P31 * inverse[starts] % _P31 for sums, inverse in self.fields)
        return mix((one << _U(32) | two) + _U(_P))


def chain(words: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of each k consecutive word fingerprints."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * _U(0xD1342543DE82EF95) + words[j : j + n]
        return mix(out)

"""Line dedup by range-partitioned hashes with a secondary sort by document and position.

Every line whose key is long enough becomes (128-bit hash of the key, doc_id, line number); these rows are
range-partitioned and sorted, so one pass over a partition sees each hash's occurrences in order and keeps
those of the first document. A hash that begins a partition may have begun in an earlier one (a hot line fills many):
such rows are passed on and resolved against the smallest document of that hash, of which there is at most one
summary per partition end. Dropped positions are gathered into one compressed bitmap per document, which the
text is filtered by; texts are never shuffled by line.

Defined cases: null or empty text is one empty line; a null doc_id's lines are all kept and don't count as a
document; repeated rows of one doc_id are one document; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NARROW_ROWS, cut, map_arrow, same

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
LINE = "h long, l long, doc_id long, pos int"


def lines_of(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, ids, places = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text or doc is None or len(text) < min_chars:
                    continue
                for pos, line in enumerate(text.split("\n")):
                    if len(line) >= min_chars:
                        key = line.strip(SPACES)
                        if len(key) >= min_chars:
                            digests.append(hashlib.blake2b(key.encode().lower(), digest_size=16).digest())
                            ids.append(doc)
                            places.append(pos)
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(ids, pa.int64()), pa.array(places, pa.int32())], ["h", "l", "doc_id", "pos"])

    return run


def first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: kind 0, a line to drop; 1, a line of the partition's first hash; 2, the last hash and its
    smallest document here (1 and 2 are resolved with other partitions)."""
    names = ["h", "l", "doc_id", "pos", "kind"]
    lead = last = None
    first_doc = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, l, doc, pos = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:4])
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
        if last is not None and (h[0], l[0]) == last:
            new[0] = False
        group = np.cumsum(new)  # 0: goes on from the batch before
        firsts = np.concatenate([[first_doc if first_doc is not None else doc[0]], doc[new]])
        if lead is None:
            lead = (h[0], l[0])
        last, first_doc = (h[-1], l[-1]), firsts[group[-1]]
        leading = (h == lead[0]) & (l == lead[1])
        drop = (doc != firsts[group]) & ~leading
        some = drop | leading
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[some], l[some], doc[some], pos[some], np.where(leading[some], 1, 0).astype(np.int32))], names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64()), pa.array([first_doc], pa.int64()), pa.array([0], pa.int32()), pa.array([2], pa.int32())], names)


def dropped_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, pos of every line to drop."""
    spark = docs.sparkSession
    lines = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lines_of(min_chars), LINE)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.repartitionByRange(parts, "h", "l", "doc_id", "pos").sortWithinPartitions("h", "l", "doc_id", "pos")
    out = cut(map_arrow(dealt, first_occurrences, LINE + ", kind int", NARROW_ROWS), "lines")
    # at most two hashes of a partition (its first and its last) are open: as many rows as partitions, not as data
    open_ = out.where("kind > 0").groupBy("h", "l").agg(F.min("doc_id").alias("first"))
    late = out.where("kind = 1").join(F.broadcast(open_), ["h", "l"]).where("doc_id > first")
    return out.where("kind = 0").select("doc_id", "pos").unionByName(late.select("doc_id", "pos")).distinct()


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for places in batch.column(1):
            places = np.asarray(places.values.to_numpy(zero_copy_only=False))
            bits = np.zeros(int(places.max()) + 1, np.uint8)
            bits[places] = 1
            out.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["b_doc", "drops"])


def bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """b_doc, drops: for each document that loses lines, the zlib-compressed bitmap of those."""
    by_doc = dropped_lines(docs, min_chars).groupBy("doc_id").agg(F.collect_list("pos").alias("pos"))
    return map_arrow(by_doc, pack, "b_doc long, drops binary")


def kept_text(text: str | None, drops: bytes | None) -> tuple[str, int, int]:
    """The text without the dropped lines, its number of lines before, and of dropped ones."""
    lines = (text or "").split("\n")
    if drops is None:
        return text or "", len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(drops), np.uint8))[: len(lines)]
    keep = [x for i, x in enumerate(lines) if i >= len(bits) or not bits[i]]
    return "\n".join(keep), len(lines), len(lines) - len(keep)


def dedup(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, kept (text without dropped lines), n_lines, n_dropped."""
    maps = bitmaps(docs, min_chars)
    both = docs.select("doc_id", "text").join(maps, F.col("doc_id") == F.col("b_doc"), "left").select("doc_id", "text", "drops")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kept_text(t.as_py(), d.as_py()) for t, d in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["doc_id", "kept", "n_lines", "n_dropped"])

    return map_arrow(both, run, "doc_id long, kept string, n_lines long, n_dropped long")

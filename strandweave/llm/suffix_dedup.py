"""Suffix-array dedup of byte strings: a distributed difference-cover computation that discards what can't repeat.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (in a smaller doc_id, or earlier in the document).

1. Whole texts that are equal are one: only the smallest doc_id's copy is looked at further.
2. Sorted sample: places whose number modulo ``MODULUS`` is in a perfect difference cover. For any two places some shift below
   the modulus brings both into the sample, so two equal strings hold, at one and the same shift, two sampled places with an
   equal prefix of LENGTH - MODULUS + 1 bytes. Prefixes are named by fingerprints, dealt by ranges of names, sorted, and
   compared with their neighbours; a sampled suffix whose name is unique can't lie in a repeat and is discarded. Samples travel
   packed, a few bytes each; a batch of documents sends a name once, and its table of documents once.
3. Recursion on names: only strings that hold a sampled place with a repeated name remain. Each takes as its name the smallest
   prefix fingerprint in it, its anchor; consecutive strings of one name are one run, one symbol of the shorter text. Runs are
   sorted over the whole table by name and content and compared with their neighbours: equal ones are copies. Where runs of
   one name differ, their strings are named again by pieces of ``PIECE``, counted from the anchor, and sorted and compared likewise.
4. Merge of the remaining suffixes: where pieces of one name differ (at the ends of repeats), or a run repeats itself, single
   strings are sorted by 128-bit fingerprints of their LENGTH bytes, and adjacent ones are compared.

The order of names is that of fingerprints, not of bytes: only equality of adjacent prefixes matters. A full suffix array (a
record for every byte, sorted in several rounds) would take many times the corpus in shuffles.

Sorts are range partitions of the whole key with the place, so a hot string's rows fill many partitions; what a partition's
first row repeats is told by one row for each partition's end.

Defined cases: null text is empty; texts shorter than LENGTH lose nothing; repeated rows of one doc_id are one document; null doc_id: the
row is kept whole and isn't compared; empty tables give no rows; other columns are ignored. A text is a step of its own however
long it is: a task holds some 50 bytes for each of its bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NARROW_ROWS, Hasher, cut, cut_by, flat, map_arrow, release, small_batches, steps

LENGTH = 100
#: A perfect difference cover; every number below 57 is a difference of two of these modulo 57 (of order 7).
MODULUS, COVER = 57, np.array([0, 1, 3, 13, 32, 36, 43, 52])
PREFIX = LENGTH - MODULUS + 1
#: Samples of a bucket, about; ids that are broadcast at most (some 40 bytes each where they are looked up).
BUCKET, SENT = 1_500_000, 1 << 20
#: Bits of a name beyond those that tell its bucket: a bucket's samples collide by chance at a rate of BUCKET / 2^32.
NAME_BITS, PIECE = 32, 8
_U = np.uint64


def sampled(n: int) -> np.ndarray:
    """Sampled places of a text of n bytes that a whole prefix follows; a place's number among them is its ordinal."""
    if n < LENGTH:
        return np.zeros(0, np.int64)
    at = (np.arange(-(-n // MODULUS))[:, None] * MODULUS + COVER).ravel()
    return at[at <= n - PREFIX]


def pack_ints(x: np.ndarray) -> bytes:
    """Ascending numbers as differences, in two or four bytes each."""
    d = np.diff(x, prepend=0)
    wide = len(d) and int(d.max()) > 65535
    return (b"\1" + d.astype("<u4").tobytes()) if wide else (b"\0" + d.astype("<u2").tobytes())


def unpack_ints(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, "<u4" if b[0] else "<u2", offset=1).astype(np.int64))


def name_samples(bits: int):
    """For each batch a row with its documents and the ordinals of samples whose names repeat in it (bucket below 0), and a row
    for each bucket with the names and ordinals of its samples (the first of each name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = flat(batch.column(1))
            names, sizes = [np.zeros(0, np.uint64)], np.zeros(len(ids), np.int64)
            for a, b in steps(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                places = [sampled(int(n)) for n in np.diff(at)]
                sizes[a:b] = [len(p) for p in places]
                flat_places = np.concatenate([p + s for p, s in zip(places, at)]) if places else np.zeros(0, np.int64)
                names.append(Hasher(part)(flat_places, flat_places + PREFIX))
            names = np.concatenate(names)
            if not len(names):
                continue
            table = np.concatenate([np.diff(ids, prepend=0), sizes]).astype("<i8").tobytes()
            number = int.from_bytes(hashlib.blake2b(table, digest_size=7).digest())
            order = np.argsort(names, kind="stable")
            ordered = names[order]
            new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            again = np.concatenate([~new[1:], [False]]) | ~new
            first = np.sort(order[new])
            buckets, docs, packed, at = [-1 - number], [zlib.compress(table, 1)], [None], [pack_ints(np.sort(order[again]))]
            mine = (names[first] >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(first), np.int64)
            rest = ((names[first] >> _U(64 - bits - NAME_BITS)) & _U((1 << NAME_BITS) - 1)).astype("<u4")
            by = np.argsort(mine, kind="stable")
            edges = np.searchsorted(mine[by], np.arange((1 << bits) + 1))
            for k in np.flatnonzero(np.diff(edges)):
                some = by[edges[k] : edges[k + 1]]
                buckets.append(int(k))
                docs.append(None)
                packed.append(rest[some].tobytes())
                at.append(pack_ints(first[some]))
            kinds = pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()
            columns = buckets, [number] * len(buckets), docs, packed, at
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["bucket", "batch", "docs", "names", "at"])

    return run


MARKS = "batch long, docs binary, at binary"


def repeated_names(group: pa.Table) -> pa.Table:
    """Of a bucket: for each batch the ordinals of samples whose names occur in several batches, a row at most for each one in.
    A batch's own row (bucket below 0) goes on as it is."""
    group = group.combine_chunks().select(["batch", "docs", "names", "at"])
    whole = group.filter(pa.compute.is_null(group.column("names")))
    group = group.filter(pa.compute.is_valid(group.column("names")))
    data, offsets = flat(group.column("names"))
    names = np.frombuffer(data.tobytes(), "<u4")
    order = np.argsort(names, kind="stable")
    same = names[order][1:] == names[order][:-1]
    mark = np.zeros(len(names), bool)
    mark[order[1:][same]] = True
    mark[order[:-1][same]] = True
    edges = offsets // 4
    numbers, found = [], []
    for i in np.flatnonzero(np.add.reduceat(np.append(mark, False), edges[:-1])) if len(names) else []:
        numbers.append(group.column("batch")[i].as_py())
        found.append(pack_ints(unpack_ints(group.column("at")[i].as_py())[mark[edges[i] : edges[i + 1]]]))
    mixed = pa.table({"batch": pa.array(numbers, pa.int64()), "docs": pa.nulls(len(numbers), pa.binary()), "at": pa.array(found, pa.binary())})
    return pa.concat_tables([whole.select(["batch", "docs", "at"]).cast(mixed.schema), mixed])


def documents_of(group: pa.Table) -> pa.Table:
    """Of a batch's rows: doc_id and ordinals of each document with repeated samples."""
    at = np.unique(np.concatenate([unpack_ints(x) for x in group.column("at").to_pylist()]))
    tables = [x for x in group.column("docs").to_pylist() if x is not None]
    ids, sizes = np.frombuffer(zlib.decompress(tables[0]), "<i8").reshape(2, -1)
    ids, first = np.cumsum(ids), np.concatenate([[0], np.cumsum(sizes)])
    own = np.searchsorted(first, at, "right") - 1
    edges = np.flatnonzero(np.diff(own, prepend=-1))
    ordinals = (at - first[own]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.append(edges, len(at)).astype(np.int32)), pa.array(ordinals))
    return pa.table({"doc_id": pa.array(ids[own[edges]], pa.int64()), "ordinals": lists})


def candidates(data: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
    """Starts of strings that hold a marked sample with its whole prefix."""
    n = len(data) - LENGTH + 1
    at = np.unique(ordinals)
    at = at // len(COVER) * MODULUS + COVER[at % len(COVER)]
    edge = np.bincount(np.minimum(np.maximum(at - MODULUS + 1, 0), n), minlength=n + 1) - np.bincount(np.minimum(at + 1, n), minlength=n + 1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def spans_of(column: pa.ListArray, *names: str) -> tuple[np.ndarray, ...]:
    """Offsets of a list column of structs, and fields of its values."""
    return (column.offsets.to_numpy(), *(column.values.field(n).to_numpy(zero_copy_only=False) for n in names))


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start .. start + n - 1 of each, one after the other."""
    n = n.astype(np.int64)
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


def window_names(hashes: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each MODULUS consecutive fingerprints, for n places."""
    size, low = 1, hashes
    while size * 2 <= MODULUS:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = MODULUS - size
    return np.minimum(low[: len(low) - rest], low[rest:])[:n]


def anchors(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where the smallest of each MODULUS consecutive fingerprints first stands, for n places."""
    size, low, at = 1, hashes, np.arange(len(hashes))
    for step in (1, 2, 4, 8, 16, MODULUS - 32):
        left = low[:-step] <= low[step:]
        low, at = np.where(left, low[:-step], low[step:]), np.where(left, at[:-step], at[step:])
        size += step
    return at[:n]


def strings(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return Hasher(data)(places, places + LENGTH), Hasher(data, second=True)(places, places + LENGTH)


RUN = "name long, h long, doc_id long, start int, n int, own boolean"


def batch_of(columns: list[list[np.ndarray]], names: str) -> pa.RecordBatch:
    """Columns in pieces, with the types that the schema text names."""
    kinds = [x.split() for x in names.split(", ")]
    types = {"long": np.int64, "int": np.int32, "boolean": bool}
    whole = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
    whole = [c.view(np.int64) if c.dtype == np.uint64 else c.astype(types[t]) for c, (_, t) in zip(whole, kinds)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in whole], [k for k, _ in kinds])


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, text, ordinals): maximal runs of candidate strings with one name; own: a string occurs in it twice."""
    for batch in batches:
        data_all, offsets = flat(batch.column(1))
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        for i, doc in enumerate(batch.column(0).to_pylist()):
            data = data_all[offsets[i] : offsets[i + 1]]
            places = candidates(data, np.asarray(batch.column(2)[i].values.to_numpy(zero_copy_only=False), np.int64))
            if not len(places):
                continue
            one = Hasher(data)
            grams = np.arange(len(data) - PREFIX + 1)
            name = window_names(one(grams, grams + PREFIX), len(data) - LENGTH + 1)[places]
            new = np.concatenate([[True], (name[1:] != name[:-1]) | (places[1:] != places[:-1] + 1)])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(places)))
            start = places[first]
            own = np.zeros(len(first), bool)
            run = np.cumsum(new) - 1
            w = one(places, places + LENGTH)
            mixed = np.sort(w)
            if (mixed[1:] == mixed[:-1]).any():
                order = np.lexsort((w, run))
                twice = (w[order][1:] == w[order][:-1]) & (run[order][1:] == run[order][:-1])
                own[run[order[1:]][twice]] = True
            for c, x in zip(out, (name[first], one(start, start + size - 1 + LENGTH), np.full(len(first), doc), start, size, own)):
                c.append(x)
        yield batch_of(out, RUN)


PIECES = "name long, h long, doc_id long, start int, n int"


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, text, spans: start, n of runs): their strings in pieces at fixed distances before the anchor."""
    for batch in batches:
        data_all, offsets = flat(batch.column(1))
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        edges, begin, sizes = spans_of(batch.column(2), "start", "n")
        for i, doc in enumerate(batch.column(0).to_pylist()):
            data = data_all[offsets[i] : offsets[i + 1]]
            one = Hasher(data)
            grams = np.arange(len(data) - PREFIX + 1)
            mine = slice(edges[i], edges[i + 1])
            places = ranges(begin[mine], sizes[mine])
            anchor = anchors(one(grams, grams + PREFIX), len(data) - LENGTH + 1)[places]
            part = (anchor - places) // PIECE
            new = np.concatenate([[True], (part[1:] != part[:-1]) | (anchor[1:] != anchor[:-1])])
            new[(np.cumsum(sizes[mine]) - sizes[mine]).astype(np.int64)] = True
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(places)))
            shared, start = (anchor - part * PIECE)[first], places[first]
            for c, x in zip(out, (one(shared, shared + LENGTH - PIECE + 1), one(start, start + size - 1 + LENGTH), np.full(len(first), doc), start, size)):
                c.append(x)
        yield batch_of(out, PIECES)


def single_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, text, spans of starts): a row for each string: its fingerprints and place."""
    for batch in batches:
        data_all, offsets = flat(batch.column(1))
        out: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        edges, begin, sizes = spans_of(batch.column(2), "start", "n")
        for i, doc in enumerate(batch.column(0).to_pylist()):
            mine = slice(edges[i], edges[i + 1])
            places = np.unique(ranges(begin[mine], sizes[mine]))
            h, l = strings(data_all[offsets[i] : offsets[i + 1]], places)  # noqa: E741
            for c, x in zip(out, (h, l, np.full(len(places), doc), places)):
                c.append(x)
        h, l, doc, pos = (np.concatenate(c) for c in out)  # noqa: E741
        for a in range(0, len(h), 200_000):
            b = a + 200_000
            yield pa.RecordBatch.from_arrays([pa.array(h[a:b].view(np.int64)), pa.array(l[a:b].view(np.int64)), pa.array(doc[a:b].astype(np.int64)), pa.array(pos[a:b].astype(np.int32))], ["h", "l", "doc_id", "start"])


def removed(size: int, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``size`` bytes the strings that start in [start, start + n) cover, and the edges of maximal covered runs."""
    edge = np.bincount(start, minlength=size + 1) - np.bincount(start + n - 1 + LENGTH, minlength=size + 1)
    gone = np.cumsum(edge[:-1]) > 0
    return gone, np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)


def with_ids(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on doc_id; at most ``SENT`` ids go to the rows, more are shuffled with them and the rows sorted, so that a
    task that is run again makes the same batches."""
    if ids.count() <= SENT:
        return rows.join(F.broadcast(ids), "doc_id", how)
    return rows.join(ids, "doc_id", how).sortWithinPartitions("doc_id")


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t.as_py() or "").encode() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], ["doc_id", "n_bytes", "sha"])


def compared(columns: list[str], key: list[str]):
    """Of a sorted partition, by key, doc_id and start: ``again``, whether a row's key is that of the row before; ``edge``: 1 for
    the partition's first row, 2 for its last, 3 for both. Rows that are equal in their place, too, are one."""
    wide = [columns.index(c) for c in (*key, "doc_id", "start")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None

        def flagged(batch: pa.RecordBatch, edge_first: bool, edge_last: bool, again: np.ndarray) -> pa.RecordBatch:
            edge = np.zeros(batch.num_rows, np.int32)
            edge[0] += edge_first
            edge[-1] += 2 * edge_last
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(again), pa.array(edge)], [*columns, "again", "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            values = [batch.column(i).to_numpy(zero_copy_only=False) for i in wide]
            equal = []
            for i, x in enumerate(values):
                same = np.zeros(len(x), bool)
                same[1:] = x[1:] == x[:-1]
                same[0] = last is not None and x[0] == last[i]
                equal.append(same)
            again = np.logical_and.reduce(equal[: len(key)])
            new = ~np.logical_and.reduce(equal)
            last = [x[-1] for x in values]
            if not new.any():
                continue
            if held is not None:
                yield flagged(held[0], held[1], False, held[2])
            held = batch.filter(pa.array(new)), held is None, again[new]
        if held is not None:
            yield flagged(held[0], held[1], True, held[2])

    return run


def neighbours(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """The written rows, range-sorted by key and place, with ``again``: the row before in the whole order has the same key.

    A partition's first row is again if its key ends an earlier partition: those ends are one row for each partition."""
    order = [*key, "doc_id", "start"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    out = cut(map_arrow(dealt, compared(rows.columns, key), kinds + ", again boolean, edge int", NARROW_ROWS), name)
    place = F.struct("doc_id", "start")
    ends = out.where("edge > 1").groupBy(*key).agg(F.min(place).alias("end"))
    both = out.join(F.broadcast(ends), key, "left")
    over = F.col("edge").isin(1, 3) & F.coalesce(F.col("end") < place, F.lit(False))
    return both.select(*rows.columns, (F.col("again") | over).alias("again"))


def removals(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents' (doc_id, n_bytes, sha); doc_id of later copies of whole texts of LENGTH bytes or more; (doc_id, text,
    starts: array of (start, n)) of other documents that lose bytes."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = cut(map_arrow(docs, digest, "doc_id long, n_bytes long, sha binary"), "digests")
    able = known.where(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= LENGTH))
    first = able.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first != last")
    first = cut(first, "first")  # so that AQE may broadcast it or split a hot text's copies, as below
    copies = cut(able.join(first, "sha").where("doc_id != first").select("doc_id").distinct(), "copies")
    total = able.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    bits = max(0, int(total * len(COVER) / MODULUS / BUCKET).bit_length())
    heads = with_ids(docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)), copies, "left_anti")
    named = map_arrow(heads, name_samples(bits), "bucket long, batch long, docs binary, names binary, at binary")
    small_batches(docs.sparkSession)
    marks = named.groupBy("bucket").applyInArrow(repeated_names, MARKS)
    marks = cut(marks.groupBy("batch").applyInArrow(documents_of, "doc_id long, ordinals array<int>"), "marks")
    release(docs.sparkSession)
    ids = cut(marks.select("doc_id").distinct(), "ids")
    texts = with_ids(heads, ids, "left_semi")
    zones = marks.groupBy("doc_id").agg(F.flatten(F.collect_list("ordinals")).alias("ordinals"))
    zones = cut_by(texts.join(zones, "doc_id"), "doc_id", "zones")
    release(docs.sparkSession)
    found = neighbours(cut(map_arrow(zones.select("doc_id", "text", "ordinals"), runs, RUN), "runs"), ["name", "h", "n"], "sorted-runs")
    place = ["doc_id", "start", "n"]
    release(docs.sparkSession)
    # a join with what is aggregated on the same key: the aggregate is written first, so that AQE may broadcast it or split a hot key
    firsts = found.where("not again")
    names = firsts.groupBy("name").agg(F.count("*").alias("k"), F.max("own").alias("any_own")).where("k > 1 or any_own")
    names = cut(names.select("name", "any_own"), "names")
    open_ = cut(firsts.join(names, "name").select(*place, "any_own"), "open")
    spans = F.collect_list(F.struct("start", "n")).alias("spans")
    texts = zones.select("doc_id", "text")
    cut_up = texts.join(open_.where("not any_own").groupBy("doc_id").agg(spans), "doc_id").select("doc_id", "text", "spans")
    parts = neighbours(cut(map_arrow(cut_up, pieces, PIECES), "pieces"), ["name", "h", "n"], "sorted-pieces")
    release(docs.sparkSession)
    firsts = parts.where("not again")
    names = cut(firsts.groupBy("name").agg(F.count("*").alias("k")).where("k > 1").select("name"), "names")
    left = firsts.join(names, "name").select(*place)
    left = left.unionByName(open_.where("any_own").select(*place)).groupBy("doc_id").agg(spans)
    each = map_arrow(texts.join(left, "doc_id").select("doc_id", "text", "spans"), single_strings, "h long, l long, doc_id long, start int")
    each = neighbours(cut(each, "strings"), ["h", "l"], "sorted-strings")
    release(docs.sparkSession)
    later = found.where("again").select(*place).unionByName(parts.where("again").select(*place))
    later = later.unionByName(each.where("again").select("doc_id", "start", F.lit(1).alias("n")))
    gone = later.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("starts"))
    lost = zones.select("doc_id", "text").join(gone, "doc_id").select("doc_id", "text", "starts")
    return known, copies, lost


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (byte intervals that go) of every row."""
    known, copies, lost = removals(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, shas = [], []
            data, offsets = flat(batch.column(1))
            edges, begin, sizes = spans_of(batch.column(2), "start", "n")
            for i in range(batch.num_rows):
                text, mine = data[offsets[i] : offsets[i + 1]], slice(edges[i], edges[i + 1])
                gone, out = removed(len(text), begin[mine].astype(np.int64), sizes[mine].astype(np.int64))
                spans.append([{"start": int(a), "end": int(b)} for a, b in out])
                shas.append(hashlib.sha256(text[~gone].tobytes()).digest())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(shas, pa.binary())], ["doc_id", "spans", "new_sha"])

    changed = map_arrow(lost, run, "doc_id long, spans array<struct<start: int, end: int>>, new_sha binary").dropDuplicates(["doc_id"])
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    changed = changed.unionByName(copies.join(known, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", whole.alias("spans"), F.unhex(F.sha2(F.lit(b""), 256)).alias("new_sha")))
    both = known.join(changed, "doc_id", "left")
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return both.select("doc_id", "n_bytes", F.coalesce(n, F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), F.lower(F.hex(F.coalesce("new_sha", "sha"))).alias("kept_sha256"), "spans")

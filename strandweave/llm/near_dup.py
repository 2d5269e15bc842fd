"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

1. Each text's set of word shingles gives a signature of ``BINS`` bins from one hash; empty bins borrow from bins that a
   universal hash probes. Rows of equal sets become one class (its smallest doc_id), so copies are never compared.
2. Bands of the signature are bucket keys. A set of at most ``SMALL`` shingles, for which bins say little, has its rarest
   shingles by hash order as keys as well: two such sets that are similar enough share one of them for certain.
3. Each bucket links its members to one centre only, so pairs are as many as bucket rows. Candidates are
   confirmed on the full sets.
4. A star can miss a link between two members whose centre is like only one of them. So buckets whose members are
   still in several components get a second star, whose centre is the member with most links so far; those that
   still are in several are compared inside, in blocks of at most about ``BLOCK`` members and ``BLOCK_BYTES`` of text, until their components meet or
   every pair across them has been tried; only confirmed links leave a block.
5. Components of the links: partitions contract their own first, then one task or large-star / small-star rounds do.

No cap on bucket sizes, partners or candidates. A pair of larger sets at the threshold shares no band with
probability (1 - 0.75^4)^32 = 5e-6.

Defined cases: null text or no word: an empty set, linked with nothing; fewer words than a shingle: the whole sequence is
one; repeated rows of one doc_id are one document; null doc_id: a row of its own, never linked, component null; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import LOWER, NOT_SPACE, Hasher, chain, cut, flat, map_arrow, mix, small_batches, steps, word_spans

BINS, ROWS, SMALL, BLOCK = 128, 4, 64, 512
BANDS = BINS // ROWS
PROBES = 4096
#: Ids that are broadcast at most (some 40 bytes each where they are looked up).
SENT = 1 << 20
#: Text bytes of a block, about: a task holds two.
BLOCK_BYTES = 24 << 20
_U = np.uint64


def _probes() -> np.ndarray:
    """For each bin and attempt the bin to borrow from: a universal hash of both."""
    bins, attempts = np.meshgrid(np.arange(BINS, dtype=np.uint64), np.arange(1, PROBES + 1, dtype=np.uint64), indexing="ij")
    return (mix(bins << _U(32) | attempts) % _U(BINS)).astype(np.int64)


PROBE = _probes()


def signature(shingles: np.ndarray) -> np.ndarray:
    """shingles: sorted distinct fingerprints, at least one. Their top bits are the bin."""
    shift = _U(64 - BINS.bit_length() + 1)
    own = (shingles >> shift).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    out, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[own[first]], full[own[first]] = shingles[first], True
    todo = np.flatnonzero(~full)
    for k in range(PROBES):
        if not len(todo):
            break
        donor = PROBE[todo, k]
        found = full[donor]
        out[todo[found]] = out[donor[found]]
        todo = todo[~found]
    out[todo] = shingles[0]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.arange(1, BANDS + 1, dtype=np.uint64)
        for j in range(ROWS):
            out = mix(out * _U(0xD1342543DE82EF95) + sig[j::ROWS])
    return out


def prefix_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Of a small set: any set with percent / 100 similarity holds one of its first n - ceil(percent * n / 100) + 1."""
    n = len(shingles)
    return mix(shingles[: n - -(-percent * n // 100) + 1] ^ _U(0xA5A5A5A5A5A5A5A5))


def shingle_sets(column, size: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct fingerprints of its word shingles."""
    data, offsets = flat(column)
    for a, b in steps(offsets):
        part, at = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        s, e = word_spans(part, at, NOT_SPACE)
        words = Hasher(part)(s, e)
        first = np.searchsorted(s, at)
        grams = chain(words, size)
        for x, y in zip(first, first[1:]):
            yield np.unique(grams[x : y - size + 1]) if y - x >= size else chain(words[x:y], int(y - x)) if y > x else np.zeros(0, np.uint64)


def sketch(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ident, keys = [], [], []
            for x in shingle_sets(batch.column(1), size):
                n.append(len(x))
                if not len(x):
                    ident.append(None)
                    keys.append([])
                    continue
                with np.errstate(over="ignore"):
                    two = np.array([len(x), mix(x).sum(dtype=np.uint64), mix(x ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64)
                ident.append(two.tobytes())
                k = band_keys(signature(x))
                keys.append(np.unique(np.concatenate([k, prefix_keys(x, percent)]) if len(x) <= SMALL else k).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ident, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())], ["doc_id", "n_shingles", "same", "keys", "bytes"])

    return run


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those alike on their full sets. b's text travels once to its pairs and once to a's side, where
    pairs of one centre meet its text; a hot centre is split by AQE's skew join."""
    one = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("b_text")), "b")
    two = one.join(texts.select(F.col("id").alias("a"), F.col("text").alias("a_text")), "a").select("a", "b", "a_text", "b_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            a, fine = batch.column(0).to_numpy(), np.zeros(batch.num_rows, bool)
            new = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
            sets = shingle_sets(batch.column(2).filter(pa.array(new)), size)
            for i, other in enumerate(shingle_sets(batch.column(3), size)):
                if new[i]:
                    kept = (a[i], next(sets))
                fine[i] = alike(kept[1], other, percent)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(fine)) for c in batch.columns[:2]], ["a", "b"])

    return map_arrow(two, run, "a long, b long")


class Overlaps:
    """Exact sizes of the intersections of one set with all others of a block, by an inverted index of its shingles."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.array([len(x) for x in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        every = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.shingles, self.first, self.times = np.unique(every[order], return_index=True, return_counts=True)
        self.owner = owner[order]

    def __call__(self, i: int) -> np.ndarray:
        mine = np.searchsorted(self.shingles, self.sets[i])
        times = self.times[mine]
        at = np.arange(times.sum()) + np.repeat(self.first[mine] - np.cumsum(times) + times, times)
        return np.bincount(self.owner[at], minlength=len(self.sets))


def inside_blocks(size: int, percent: int):
    """Links across components among the members of one block pair (key: x, y). A pair whose components have met is skipped."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, comp, side = (table.column(c).to_numpy() for c in ("id", "component", "side"))
        both = table.column("x")[0].as_py() != table.column("y")[0].as_py()
        overlaps = Overlaps(list(shingle_sets(table.column("text"), size)))
        right = np.flatnonzero(side == 1) if both else np.arange(len(ids))
        parent = {int(c): int(c) for c in comp}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        out = []
        for i in np.flatnonzero(side == 0):
            far = right[comp[right] != comp[i]]
            far = far if both else far[far > i]
            if not len(far):
                continue
            common = overlaps(i)[far]
            for j in far[100 * common >= percent * (overlaps.sizes[i] + overlaps.sizes[far] - common)]:
                p, q = root(int(comp[i])), root(int(comp[j]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def with_ids(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of texts whose id is in ids. At most ``SENT`` ids go to the texts; more are shuffled with them."""
    return texts.join(F.broadcast(ids) if ids.count() <= SENT else ids, "id", "left_semi")


def mixed_buckets(rows: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, n, size (bytes) of the buckets whose members are in several components, one for each set of members; all bucket
    rows with their component."""
    placed = rows.join(comp, "id", "left").select("id", "key", "bytes", F.coalesce("component", "id").alias("component"))
    ids = F.sum(F.xxhash64("id").cast("decimal(38,0)"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"), F.sum("bytes").alias("size"), F.min("id").alias("low"), F.max("id").alias("high"), ids.alias("ids")).where("x != y")
    return cut(mixed.groupBy("n", "low", "high", "ids").agg(F.min("key").alias("key"), F.max("size").alias("size")).select("key", "n", "size"), "mixed"), placed


def classes(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = cut(map_arrow(docs, sketch(size, percent), "doc_id long, n_shingles long, same binary, keys array<long>, bytes long"), "sketch")
    groups = sketched.where("same is not null and doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("class"))
    groups = cut(groups, "classes")
    heads = sketched.where("same is not null").join(groups.select(F.col("class").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    heads = cut(heads.select(F.col("doc_id").alias("id"), "keys", "bytes"), "heads")
    keyed = heads.select("id", "bytes", F.explode("keys").alias("key"))
    rank = F.struct(F.xxhash64("key", "id").alias("order"), F.col("id").alias("centre"))
    centres = cut(keyed.groupBy("key").agg(F.min(rank).alias("r"), F.count("*").alias("n")).where("n > 1").select("key", "r.centre"), "centres")
    rows = cut(keyed.join(centres, "key"), "buckets")  # only buckets with company
    stars = rows.where("id != centre")
    rows = rows.drop("centre")
    pairs = cut(stars.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct(), "pairs")
    ends = cut(rows.select("id").distinct(), "ends")
    near = cut(with_ids(docs.withColumnRenamed("doc_id", "id"), ends), "near")
    links = cut(confirm(pairs, near, size, percent).distinct(), "links")
    comp = components(links)
    mixed, placed = mixed_buckets(rows, comp)
    if mixed.head(1):
        degree = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
        members = cut(placed.join(mixed.select("key"), "key", "left_semi").join(degree, "id", "left"), "members")
        best = F.struct((-F.coalesce("degree", F.lit(0))).alias("order"), F.xxhash64("key", "id").alias("hash"), F.col("id").alias("centre"), F.col("component").alias("own"))
        centres = cut(members.groupBy("key").agg(F.min(best).alias("r")).select("key", "r.centre", "r.own"), "centres")
        pairs2 = members.join(centres, "key").where("component != own").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
        pairs2 = cut(pairs2.join(pairs, ["a", "b"], "left_anti"), "pairs")
        more = cut(confirm(pairs2, near, size, percent), "links")
        if more.head(1):
            links = links.unionByName(more)
            comp = components(links)
            mixed, placed = mixed_buckets(rows, comp)
    if mixed.head(1):
        members = placed.join(mixed, "key")
        blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("size") / BLOCK_BYTES)).cast("int")
        members = members.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        spread = members.select("key", "id", "component", "mine", other)
        spread = spread.select("key", "id", "component", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"))
        small_batches(docs.sparkSession)
        more = spread.join(near, "id").groupBy("key", "x", "y").applyInArrow(inside_blocks(size, percent), "a long, b long")
        more = cut(more.distinct(), "more")
        if more.head(1):
            comp = components(links.unionByName(more))
    out = sketched.select("doc_id", "n_shingles", "same").join(groups, "same", "left")
    out = out.join(comp.withColumnRenamed("id", "class"), "class", "left")
    whole = F.coalesce("component", "class", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), whole).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

"""Counting: abundance, presence over datasets, minimizers, super-k-mers. All are partial and final hash aggregates on one key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, seq, stretches
from ..lineage import cut
from .runs import join_runs

#: Buckets of minimizers: what one row of a shuffle says of its place.
BUCKETS = 1 << 16


@dataclass(frozen=True)
class CounterConfig:
    """k, minimizer length, threshold (kept: more than it) and partitions of a counter."""

    k: int
    m: int = 1
    threshold: int = 1
    partitions: int = 1024

    def check(self, datasets: bool = False) -> CounterConfig:
        most_k, most_x = (32, 2**31 - 1) if datasets else (64, 255)
        for bad, what in (
            (not 1 <= self.k <= most_k, f"k must be in 1..{most_k}"),
            (not 1 <= self.m <= min(self.k, 64), "m must be in 1..k"),
            (self.partitions < 1, "partition count must be positive"),
            (not 0 <= self.threshold < most_x, f"threshold must be below {most_x}"),
        ):
            if bad:
                raise ValueError(what)
        return self


def count_kmers(reads: DataFrame, k: int, threshold: int = 0, col: str = "seq") -> DataFrame:
    """kmer, count of canonical k-mers found more than ``threshold`` times."""
    if k <= codes.MOST_K:
        return codes.summed(reads, k, threshold, col=col).withColumnRenamed("n", "count")
    w = seq.windows(seq.fragments(reads, k, seq=col), k)
    return w.groupBy("kmer").agg(F.count("*").alias("count")).where(F.col("count") > threshold)


def saturated(counts: DataFrame, threshold: int) -> DataFrame:
    """Counts as the one-byte format stores them: never above threshold + 1."""
    return counts.select("kmer", F.least(F.col("count"), F.lit(threshold + 1).cast("long")).alias("count"))


def count_datasets(reads: DataFrame, k: int, threshold: int = 0, dataset: str = "dataset_id", col: str = "seq", n_datasets: int | None = None) -> DataFrame:
    """kmer, n_datasets of k-mers found in more than ``threshold`` datasets."""
    if n_datasets is not None and threshold >= n_datasets:
        reads = reads.where(F.lit(False))
    if k <= codes.MOST_K:
        return codes.summed(reads, k, threshold, dataset, col).withColumnRenamed("n", "n_datasets")
    w = seq.windows(seq.fragments(reads, k, dataset, seq=col), k, dataset)
    return w.distinct().groupBy("kmer").agg(F.count(dataset).alias("n_datasets")).where(F.col("n_datasets") > threshold)


def distinct_kmers(reads: DataFrame, k: int, col: str = "seq") -> DataFrame:
    if k <= codes.MOST_K:
        return codes.summed(reads, k, col=col).select("kmer")
    return seq.windows(seq.fragments(reads, k, seq=col), k).distinct()


def spectrum(counts: DataFrame) -> DataFrame:
    return counts.groupBy("count").agg(F.count("*").alias("kmers"))


def minimizer_counts(reads: DataFrame, k: int, m: int, col: str = "seq") -> DataFrame:
    if m <= codes.MOST_K:
        return codes.summed(reads, k, col=col, m=m).select(F.col("kmer").alias("minimizer"), F.col("n").alias("windows"))
    return seq.minimizer_windows(seq.fragments(reads, k, seq=col), k, m).groupBy("minimizer").agg(F.count("*").alias("windows"))


def minimizer_presence(reads: DataFrame, k: int, m: int, dataset: str = "dataset_id", col: str = "seq") -> DataFrame:
    if m <= codes.MOST_K:
        return codes.summed(reads, k, -1, dataset, col, m).select(F.col("kmer").alias("minimizer"), F.col("n").alias("n_datasets"))
    w = seq.minimizer_windows(seq.fragments(reads, k, dataset, seq=col), k, m, dataset).select(dataset, "minimizer")
    return w.distinct().groupBy("minimizer").agg(F.count(dataset).alias("n_datasets"))


def prefiltered_counts(reads: DataFrame, k: int, m: int, threshold: int, col: str = "seq") -> DataFrame:
    """The same as ``count_kmers``: windows whose minimizer is too rare can't hold a frequent k-mer and are left out first.

    Up to k = 31 stretches are dealt out by minimizer, so a bucket tells rare ones before it makes its k-mers; hot ones are surely not rare."""
    if k <= codes.MOST_K:
        hot = hot_minimizers(reads, k, m, 1 / 128, 0.05, col)
        return stretches.summed(stretches.dealt(reads, k, m, hot, col=col, whole=True), k, threshold, m)
    w = seq.minimizer_windows(seq.fragments(reads, k, seq=col), k, m).select("kmer", "minimizer")
    often = w.groupBy("minimizer").agg(F.count("*").alias("n")).where(F.col("n") > threshold).select("minimizer")
    return w.join(often, "minimizer", "left_semi").groupBy("kmer").agg(F.count("*").alias("count")).where(F.col("count") > threshold)


def hot_minimizers(reads: DataFrame, k: int, m: int, share: float, sample: float, col: str = "seq") -> list[int]:
    """Codes of minimizers with more than ``share`` of the windows of a sample of records: 1 / share of them at most. They decide how
    windows are dealt out, not what is counted."""
    some = reads.sample(sample, seed=7) if sample < 1 else reads
    if k <= codes.MOST_K:
        n = codes.gathered(codes.dealt(some, k, col=col, m=m, order=codes.mixed), as_text=False).withColumnRenamed("kmer", "minimizer")
    else:
        n = seq.minimizer_pieces(seq.fragments(some, k, seq=col), k, m, order="code").select(F.explode("mins").alias("minimizer")).groupBy("minimizer").agg(F.count("*").alias("n"))
    n = cut(n, "minimizers")
    least = (n.agg(F.sum("n")).first()[0] or 0) * share
    return sorted(r["minimizer"] for r in n.where(F.col("n") > least).select("minimizer").collect())


def count_by_superkmers(reads: DataFrame, k: int, m: int, threshold: int = 0, share: float = 1 / 128, sample: float = 0.05, col: str = "seq") -> DataFrame:
    """The same as ``count_kmers`` with a small shuffle: super-k-mers, the stretches of bases whose windows have one minimizer, are dealt out by
    the minimizer's hash, packed to two bits a base, and cut into windows where they arrive; a k-mer has the same minimizer wherever it
    stands, on either strand, so they are counted there without another shuffle.

    Windows of ``hot_minimizers`` (low complexity, repeats) would be one task's: they are counted by k-mer, with partial sums before their
    shuffle. Up to k = 31 tasks make, pack and count stretches by numpy; longer windows are rows, and hot ones join the result by union."""
    hot = hot_minimizers(reads, k, m, share, sample, col)
    if k <= codes.MOST_K:
        return stretches.summed(stretches.dealt(reads, k, m, hot, col=col), k, threshold)
    p = seq.minimizer_pieces(seq.fragments(reads, k, seq=col), k, m, order="code", bases=True)
    runs = _stretches(p, lambda first, windows: F.substring("f", first + 1, windows + k - 1).cast("string").alias("seq"))
    cold = runs.where(~F.col("minimizer").isin(hot)) if hot else runs
    bucket = F.pmod(F.xxhash64("minimizer"), F.lit(BUCKETS)).cast("int")
    dealt = cold.select(bucket.alias("bucket"), seq.packed("seq").alias("packed")).repartition("bucket")
    counts = seq.windows(dealt.select("bucket", seq.unpacked("packed").alias("seq")), k, "bucket").groupBy("bucket", "kmer").agg(F.count("*").alias("count")).select("kmer", "count")
    if hot:
        rest = seq.windows(runs.where(F.col("minimizer").isin(hot)).select("seq"), k)
        counts = counts.unionByName(rest.groupBy("kmer").agg(F.count("*").alias("count")))
    return counts.where(F.col("count") > threshold)


def _stretches(pieces: DataFrame, *more) -> DataFrame:
    """All columns of pieces but mins, and minimizer and ``more`` (of a run's first window and windows) of each run of equal minimizers in one."""
    size, kept = F.size("mins"), [c for c in pieces.columns if c not in ("mins", "f")]
    changes = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get("mins", i) != F.get("mins", i - 1)))
    p = pieces.select("*", F.explode(F.array(changes)).alias("firsts"))

    def run(first, i):
        windows = F.coalesce(F.get("firsts", i + 1), size) - first
        return F.struct(F.get("mins", first).alias("minimizer"), *[x(first, windows) for x in more])

    return p.select(*kept, F.explode(F.transform("firsts", run)).alias("r")).select(*kept, "r.*")


def scanned(reads: DataFrame, k: int, m: int, col: str = "seq") -> DataFrame:
    """One row: fragments of at least k bases, their bases, runs of windows with one minimizer, windows."""
    if k <= codes.MOST_K:
        return stretches.sizes(reads, k, m, col)
    given = reads.select(F.monotonically_increasing_id().alias("row"), F.col(col).alias("seq"))
    n = seq.fragments(given, k).agg(F.count("*").alias("fragments"), F.sum(F.length("seq")).alias("bases"))
    runs = superkmers(given, k, m, "row").agg(F.count("*").alias("runs"), F.sum("windows").alias("windows"))
    return n.join(F.broadcast(runs))  # one row each


def superkmers(reads: DataFrame, k: int, m: int, record: str = "record_idx", col: str = "seq") -> DataFrame:
    """record, frag, start, windows, minimizer of maximal runs of windows with one minimizer; runs tile a fragment.

    Up to k = 31 a record's runs are found whole in its row. For longer windows they are found inside each piece, so windows aren't shuffled; only
    those at the edges of pieces of a longer fragment meet in one task."""
    if k <= codes.MOST_K:
        return stretches.superkmers(reads, k, m, record, col)
    p = seq.minimizer_pieces(seq.fragments(reads, k, record, seq=col), k, m, record, "frag")
    size = F.size("mins")
    changes = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get("mins", i) != F.get("mins", i - 1)))
    p = p.select(record, "frag", F.col("start").alias("piece"), "mins", F.explode(F.array(changes)).alias("firsts"))
    one_piece = (F.col("piece") == 0) & (size < seq.PIECE)

    def run(first, i):
        windows = F.coalesce(F.get("firsts", i + 1), size) - first
        edge = ~one_piece & ((i == 0) | (i == F.size("firsts") - 1))
        return F.struct((F.col("piece") + first).alias("start"), windows.alias("windows"), F.get("mins", first).alias("minimizer"), edge.alias("edge"))

    runs = p.select(record, "frag", F.explode(F.transform("firsts", run)).alias("r")).select(record, "frag", "r.*")
    return join_runs(runs, [record, "frag"], "minimizer")

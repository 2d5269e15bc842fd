"""Incremental job: k-mer counts of datasets whose records keep arriving.

A run takes the files that are new since the last one, as a stream with a checkpoint, and ends when there are no more. Each micro-batch's
windows are packed once (``deltas``, partitioned by batch and bucket; a bit more than a byte a window), and the datasets in it are counted anew from their deltas
(``counts``, partitioned by bucket: a hash of the dataset). Both are dynamic partition overwrites of what the batch number and its
files determine, so a batch that failed half-way is repeated with the same result, and a run that finds nothing new changes nothing.

    python -m jobs.kmer_ledger --config jobs/kmer_ledger.toml --source /data/reads --out /data/ledger

``counts``: dataset, kmer (canonical), count of k-mers found more than ``threshold`` times in that dataset. Rows without a dataset are
one of their own; null and short sequences have no k-mers. Checkpoint and output go together: an output whose batches
are ahead of the checkpoint is refused. A bucket is read by as many tasks as its files need, so a dataset that holds most rows is not one task's.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys
import tomllib

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strandweave.functions import codes, seq, stretches  # noqa: E402
from strandweave.shipping import ship  # noqa: E402

log = logging.getLogger("strandweave.jobs.kmer_ledger")

#: Packed stretches of windows (k up to 31), or counts of k-mers: of longer ones, and in outputs of earlier versions.
DELTA = f"dataset string, k int, place int, {stretches.PACKED.partition(', ')[2]}, kmer string, count long, batch long, bucket int"
COUNT = "dataset string, kmer string, count long, bucket int"


def _exists(spark: SparkSession, path: str, schema: str, *parts: str) -> None:
    """An empty table where there is none yet, so that it can be read."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*parts).parquet(path)


def _overwrite(df: DataFrame, path: str, name: str, *parts: str) -> int:
    """Replace the partitions that df has rows of; returns the rows."""
    seen = Observation(name)
    df.observe(seen, F.count("*").alias("rows")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    return seen.get.get("rows", 0)


def packed(records: DataFrame, k: int, buckets: int) -> DataFrame:
    """Deltas of records (dataset, seq) without their batch."""
    bucket = F.pmod(F.xxhash64("dataset"), F.lit(buckets)).cast("int").alias("bucket")
    if k > codes.MOST_K:
        w = seq.windows(seq.fragments(records, k, "dataset"), k, "dataset").groupBy("dataset", "kmer").agg(F.count("*").alias("count"))
        return w.select("dataset", F.lit(k).alias("k"), F.lit(None).cast("int").alias("place"), *[F.lit(None).cast("binary").alias(c) for c in ("bases", "windows", "kmers", "n")], "kmer", "count", bucket)
    rows = stretches.dealt(records, k, max(1, min(11, k - 2)), key="dataset").withColumnsRenamed({"key": "dataset", "bucket": "place"})
    return rows.select("dataset", F.lit(k).alias("k"), "place", "bases", "windows", "kmers", "n", F.lit(None).cast("string").alias("kmer"), F.lit(None).cast("long").alias("count"), bucket)


def counted(deltas: DataFrame, threshold: int) -> DataFrame:
    """dataset, kmer, count, bucket of k-mers found more than ``threshold`` times in what the deltas hold."""
    plain = deltas.where("kmer IS NOT NULL").select("dataset", "kmer", "count", "bucket")
    alone = plain.isEmpty()
    least = threshold if alone else 0

    def one(table: pa.Table) -> pa.Table:
        first = {c: table.column(c)[0] for c in ("dataset", "k", "bucket")}
        numbers, n = stretches.counted(table, first["k"].as_py(), least)
        return pa.table({"dataset": pa.repeat(first["dataset"], len(n)), "kmer": codes.letters_of(numbers), "count": pa.array(n, pa.int64()), "bucket": pa.repeat(first["bucket"], len(n))})

    ship(deltas.sparkSession)
    counts = deltas.where("kmer IS NULL").drop("kmer", "count", "batch").groupBy("dataset", "k", "place", "bucket").applyInArrow(one, COUNT)
    if alone:
        return counts
    return counts.unionByName(plain).groupBy("dataset", "kmer", "bucket").agg(F.sum("count").alias("count")).where(F.col("count") > threshold)


def run(spark: SparkSession, source: str, out: str, checkpoint: str | None = None, k: int = 21, threshold: int = 2, buckets: int = 16, files_per_batch: int | None = None, dataset: str = "source", sequence: str = "text", mapped: bool = True) -> DataFrame:
    """Bring ``out`` up to date with the Parquet files at ``source`` (a folder or a pattern), and return its counts.

    mapped: the sequence column holds text, which is mapped to DNA letter by letter; else DNA. files_per_batch: most files of one
    micro-batch; all that are new where it isn't given."""
    deltas, counts = f"{out}/deltas", f"{out}/counts"
    _exists(spark, deltas, DELTA, "batch", "bucket")
    _exists(spark, counts, COUNT, "bucket")
    sequence_of = seq.text_to_dna(sequence) if mapped else F.col(sequence)

    def batch(new: DataFrame, number: int) -> None:
        session = new.sparkSession
        done = session.read.schema(DELTA).parquet(deltas)
        if ahead := done.where(F.col("batch") > number).select("batch").limit(1).collect():
            raise RuntimeError(f"{deltas} holds batch {ahead[0][0]}, but {checkpoint or out} is at {number}: output and checkpoint don't belong together")
        records = new.select(F.col(dataset).cast("string").alias("dataset"), sequence_of.alias("seq"))
        arrived = Observation(f"records-{number}")
        records = records.observe(arrived, F.count("*").alias("rows"))
        rows = _overwrite(packed(records, k, buckets).withColumn("batch", F.lit(number).cast("long")), deltas, f"delta-{number}", "batch", "bucket")
        log.info("batch %d: read %d records, wrote %d rows to %s", number, arrived.get.get("rows", 0), rows, deltas)
        done = session.read.schema(DELTA).parquet(deltas)
        touched = sorted(r[0] for r in done.where(F.col("batch") == number).select("bucket").distinct().collect())
        if touched:
            known = done.where(F.col("bucket").isin(touched))
            rows = _overwrite(counted(known, threshold).select("dataset", "kmer", "count", "bucket"), counts, f"counts-{number}", "bucket")
            log.info("batch %d: wrote %d k-mers of %d buckets to %s", number, rows, len(touched), counts)

    stream = spark.readStream.schema(spark.read.parquet(source).schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    started = stream.parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint or f"{out}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    log.info("%s: %d batches in this run", source, sum(p["numInputRows"] > 0 for p in started.recentProgress))
    return spark.read.schema(COUNT).parquet(counts)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="kmer_ledger", description=__doc__.partition("\n")[0])
    p.add_argument("--config", help="TOML file with a value for any of run's arguments")
    for name in ("source", "out", "checkpoint", "dataset", "sequence"):
        p.add_argument(f"--{name}")
    for name in ("k", "threshold", "buckets", "files-per-batch"):
        p.add_argument(f"--{name}", type=int)
    a = vars(p.parse_args(argv))
    config = {}
    if path := a.pop("config"):
        with open(path, "rb") as f:
            config = tomllib.load(f)
    config |= {name: value for name, value in a.items() if value is not None}
    if missing := {"source", "out"} - set(config):
        p.error(f"missing: {', '.join(sorted(missing))}")
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("kmer_ledger").getOrCreate()
    try:
        run(spark, **config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

"""Presence counts over datasets that keep arriving: new files are read as a stream, each (dataset, k-mer) counts once.

A micro-batch adds its pairs to a table, packed and without a shuffle; what it repeats of earlier ones is told when they are counted. So there is no state but the
table: a store with a key for each pair took several times the input on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, seq
from ..lineage import drop_on_exit, shared_path


def presence_stream(reads: DataFrame, k: int, dataset: str = "dataset_id", col: str = "seq") -> DataFrame:
    """A stream of (dataset, kmer) pairs of a stream of records, packed by dataset and bucket (``codes.dealt``); of k-mers too long for that as they are, with one key
    of state per pair."""
    if k <= codes.MOST_K:
        return codes.dealt(reads, k, dataset, col)
    return seq.windows(seq.fragments(reads, k, dataset, seq=col), k, dataset).dropDuplicates([dataset, "kmer"])


def update(reads: DataFrame, k: int, table: str, checkpoint: str, dataset: str = "dataset_id", col: str = "seq") -> None:
    """Bring the table of pairs up to date with all files that have arrived."""
    query = presence_stream(reads, k, dataset, col).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def counts(spark: SparkSession, table: str, dataset: str = "dataset_id", threshold: int = 0) -> DataFrame:
    pairs = spark.read.parquet(table)
    if "kmers" in pairs.columns:
        return codes.gathered(pairs, threshold).withColumnRenamed("n", "n_datasets")
    return pairs.groupBy("kmer").agg(F.count(dataset).alias("n_datasets")).where(F.col("n_datasets") > threshold)


def presence_of_arrivals(spark: SparkSession, path: str, schema, k: int, threshold: int, dataset: str, text: str) -> DataFrame:
    """Run the stream over the files at ``path`` once, and count."""
    table, checkpoint = shared_path(spark, "presence"), shared_path(spark, "presence-state")
    reads = spark.readStream.schema(schema).parquet(path).select(dataset, seq.text_to_dna(text).alias("seq"))
    update(reads, k, table, checkpoint, dataset)
    drop_on_exit(spark, table)
    drop_on_exit(spark, checkpoint)
    return counts(spark, table, dataset, threshold)

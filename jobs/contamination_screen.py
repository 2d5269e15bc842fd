"""Batch job: screen records against an index of known sequences.

The index's frequent k-mers are counted; every record is marked window by window; a record of which more than ``share`` percent of windows are
known is contaminated and goes, and of the others what remains between known windows is written as segments.

    python -m jobs.contamination_screen --config jobs/contamination_screen.toml --records /data/reads --index /data/known --out /data/screened

Outputs below ``out``: ``segments`` (record, dataset, frag, start, seq) and ``records`` (record, dataset, scanned, filtered, contaminated,
segments, nucleotides; one row for each record and dataset), Parquet partitioned by bucket, a hash of the record; ``summary``, sums of ``records`` for each dataset, as
CSV. A run replaces them whole, the records after the segments that they count, so a repeated run gives the same and a failed one is repeated.

Rows that share an id are one record with several sequences; rows without an id are one, too. A null or short sequence has no windows, and
its record is clean. An empty index marks nothing.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys
import tomllib

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strandweave.functions import seq  # noqa: E402
from strandweave.operators import count, subtract  # noqa: E402
from strandweave.sources.spread import spread  # noqa: E402

log = logging.getLogger("strandweave.jobs.contamination_screen")

KEYS = ["record", "dataset"]


def _write(df: DataFrame, path: str, name: str) -> DataFrame:
    seen = Observation(name)
    df.observe(seen, F.count("*").alias("rows")).write.mode("overwrite").partitionBy("bucket").parquet(path)
    log.info("wrote %d rows to %s", seen.get.get("rows", 0), path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _same(a: DataFrame, b: DataFrame):
    return a["record"].eqNullSafe(b["record"]) & a["dataset"].eqNullSafe(b["dataset"])


def run(spark: SparkSession, records: str, index: str, out: str, k: int = 21, threshold: int = 0, share: int = 20, buckets: int = 16, record: str = "doc_id", dataset: str = "source", sequence: str = "text", mapped: bool = True) -> DataFrame:
    """Write the outputs and return ``records`` read back. threshold: index k-mers found more often count; mapped: the sequence columns
    hold text, which is mapped to DNA letter by letter; else DNA."""
    sequence_of = seq.text_to_dna(sequence) if mapped else F.col(sequence)
    known = subtract.build(count.count_kmers(spark.read.parquet(index).select(sequence_of.alias("seq")), k, threshold))
    log.info("%s: %d k-mers", index, known.kmers.count())

    rows = spread(spark.read.parquet(records).select(F.col(record).alias("record"), F.col(dataset).cast("string").alias("dataset"), sequence_of.alias("seq")))
    # a row's key: equal rows have the same windows, and others of the same id are told apart by their sequence
    keyed = rows.select(F.struct("record", "dataset", F.sha2("seq", 256).alias("text")).alias("key"), "seq")
    marks = subtract.stats(keyed, known, k, "key").groupBy(F.col("key.record").alias("record"), F.col("key.dataset").alias("dataset")).agg(F.sum("scanned").alias("scanned"), F.sum("filtered").alias("filtered"))
    all_ids = rows.select(*KEYS).distinct()
    seen = all_ids.join(marks, _same(all_ids, marks), "left").select(all_ids["record"], all_ids["dataset"], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("scanned", "filtered")])
    bucket = F.pmod(F.xxhash64("record"), F.lit(buckets)).cast("int").alias("bucket")
    judged = seen.withColumn("contaminated", F.col("filtered") * 100 > F.col("scanned") * share)

    dirty = judged.where("contaminated").select(*KEYS)
    segments = subtract.segments(keyed, known, k, "key").select(F.col("key.record").alias("record"), F.col("key.dataset").alias("dataset"), "frag", "start", "seq")
    segments = _write(segments.join(dirty, _same(segments, dirty), "left_anti").select("*", bucket), f"{out}/segments", "segments")

    parts = segments.groupBy(*KEYS).agg(F.count("*").alias("segments"), F.sum(F.length("seq")).alias("nucleotides"))
    whole = judged.join(parts, _same(judged, parts), "left").select(judged["record"], judged["dataset"], "scanned", "filtered", "contaminated", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("segments", "nucleotides")])
    whole = _write(whole.select("*", bucket), f"{out}/records", "records")

    sums = [F.sum(c).alias(c) for c in ("scanned", "filtered", "segments", "nucleotides")]
    summary = whole.groupBy("dataset").agg(F.count("*").alias("records"), F.count_if("contaminated").alias("contaminated"), *sums).orderBy("dataset")
    summary.write.mode("overwrite").option("header", True).csv(f"{out}/summary")
    log.info("wrote sums of each dataset to %s", f"{out}/summary")
    return whole


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="contamination_screen", description=__doc__.partition("\n")[0])
    p.add_argument("--config", help="TOML file with a value for any of run's arguments")
    for name in ("records", "index", "out", "record", "dataset", "sequence"):
        p.add_argument(f"--{name}")
    for name in ("k", "threshold", "share", "buckets"):
        p.add_argument(f"--{name}", type=int)
    a = vars(p.parse_args(argv))
    config = {}
    if path := a.pop("config"):
        with open(path, "rb") as f:
            config = tomllib.load(f)
    config |= {name: value for name, value in a.items() if value is not None}
    if missing := {"records", "index", "out"} - set(config):
        p.error(f"missing: {', '.join(sorted(missing))}")
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("contamination_screen").getOrCreate()
    try:
        run(spark, **config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

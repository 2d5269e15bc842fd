"""The jobs as queries: each run twice into a new folder below spark.checkpoint.dir, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandweave.lineage import shared_path
from strandweave.plans import catalog

from . import contamination_screen, kmer_ledger

SHARE = 20


def job1_kmer_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run finds no new file and leaves the ledger as it is."""
    out = shared_path(spark, "kmer-ledger")
    for _ in range(2):  # a pattern, as a stream's source can't be named as one file
        ledger = kmer_ledger.run(spark, f"{sf_dir}/documents.parque[t]", out, k=catalog.K, threshold=catalog.X)
    return ledger.select("dataset", "kmer", "count")


def job2_contamination_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run replaces the first one's output."""
    out = shared_path(spark, "contamination-screen")
    for _ in range(2):
        records = contamination_screen.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out, k=catalog.K, share=SHARE)
    return records.drop("bucket")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_kmer_ledger, job2_contamination_screen)}

ORACLE_SQL: dict[str, str] = {
    "job1_kmer_ledger": f"SELECT dataset_id AS dataset, kmer, count(*) AS count FROM {catalog._DOCS} GROUP BY dataset_id, kmer HAVING count(*) > {catalog.X}",
    "job2_contamination_screen": f"""
WITH m AS (SELECT record_idx, {catalog._STATS} FROM {catalog._MARK} GROUP BY record_idx),
s AS (SELECT record_idx, count(*) AS segments, sum(length(seq))::BIGINT AS nucleotides FROM {catalog._SEGS} GROUP BY record_idx),
r AS (SELECT d.doc_id AS record, d.source AS dataset, coalesce(scanned, 0)::BIGINT AS scanned, coalesce(filtered, 0)::BIGINT AS filtered, segments, nucleotides
  FROM documents d LEFT JOIN m ON m.record_idx = d.doc_id LEFT JOIN s ON s.record_idx = d.doc_id)
SELECT record, dataset, scanned, filtered, 100 * filtered > {SHARE} * scanned AS contaminated,
  CASE WHEN 100 * filtered > {SHARE} * scanned THEN 0 ELSE coalesce(segments, 0) END AS segments, CASE WHEN 100 * filtered > {SHARE} * scanned THEN 0 ELSE coalesce(nucleotides, 0) END AS nucleotides FROM r""",
}

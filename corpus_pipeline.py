"""A corpus pipeline of five stages: language ID, line dedup, near-dedup, decontamination, and a mix of sources.

Every stage gets all rows that the one before kept, read back from Parquet, and returns the columns of ``documents`` (the last:
the mix's as well)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.lineage import drop, scratch
from strandweave.llm import decontam, langid, line_dedup, mixing, near_dup
from strandweave.llm.common import cut, map_arrow, same, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is in ids (doc_id)."""
    ids = ids.select(F.col("doc_id").alias("k_id")).distinct()
    return docs.select(*COLUMNS).join(ids, same(F.col("doc_id"), F.col("k_id")), "left_semi")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that language ID rejects: no letters, or too far from every language's centroids."""
    model = langid.fit(docs.where(langid.train_rows(F.col("doc_id"))))
    return langid.predict(docs, model, tuple(COLUMNS)).where("not rejected").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document holds; n_chars follows. A document of which nothing but white
    space is left goes, unless it had nothing else before."""
    maps = line_dedup.bitmaps(docs.select("doc_id", "text"))
    both = docs.select(*COLUMNS).join(maps, F.col("doc_id") == F.col("b_doc"), "left").select(*COLUMNS, "drops")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, fine = [], []
            for text, drops in zip(batch.column(1), batch.column(5)):
                text, drops = text.as_py(), drops.as_py()
                new = text if drops is None else line_dedup.kept_text(text, drops)[0]
                texts.append(new)
                fine.append(drops is None or bool(new.strip(line_dedup.SPACES)))
            sizes = [n if d is None else len(t) for n, d, t in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), texts)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2), batch.column(3), pa.array(sizes, pa.int64())], COLUMNS)
            yield out.filter(pa.array(fine, pa.bool_()))

    return map_arrow(both, run, "doc_id long, text string, lang string, source string, n_chars long")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near-duplicates."""
    return keep(docs, near_dup.classes(docs).where("kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold ten consecutive words of a benchmark item."""
    found = decontam.matches(docs, table(spark, sf_dir, "benchmark"), columns=tuple(COLUMNS))
    return found.where(F.size("matches") == 0).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document and round in which the mix takes words of it: text holds those words, taken their number,
    shard and place where the row belongs."""
    mixed = mixing.mix(docs).where("taken > 0").select(F.col("doc_id").alias("m_id"), "round", "taken", "size", "source_size", "target", "shard", "place")
    out = docs.select(*COLUMNS).join(cut(mixed, "mixed"), same(F.col("doc_id"), F.col("m_id"))).drop("m_id")
    whole = F.col("taken") == F.col("size")
    return out.withColumn("text", F.coalesce(mixing.first_words(F.when(~whole, F.col("text")), F.col("taken")), "text")).withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long")))


STAGES = [
    ("language ID", language_id),
    ("line dedup", dedup_lines),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("source mix", mix_sources),
]

#: SQL can't say what the classifier rejects or which documents the mix draws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written besides its result goes when the result is written, and that when the next one's is."""
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch() as mine:
            docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        drop(spark, last + mine[:-1])
        last = mine[-1:]
    return docs

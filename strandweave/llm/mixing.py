"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source's documents stand in a permuted order (by a hash of doc_id) on a line that is as long as
the source's words; a mix takes the first ``target`` words of that line, going round it again where the
target is longer. The line is cut into blocks, runs of documents that share the top bits of their hash.
How many of each source's blocks every output shard gets is drawn by a tree: each node splits its exact
counts between two halves of its shards by one multivariate hypergeometric draw, so counts always add up.
Shards then take disjoint runs of each source's permuted blocks, and rows are shuffled inside a shard.

A shard takes what its quota draws and nothing else: a block slot that no shard's quota reaches gives no words, and the last slot
of a source is cut at the source's target, so words are met as exactly as quotas are.

Only sums per (source, block) are shuffled; blocks are bounded, so a hot source is spread over tasks.
The driver holds one row per source and the shards' quotas (64 numbers a source): the mixture's definition, checked against
``max_sources``.

Defined cases: a null text has size 0; a null source is a source, last in order; a document of size 0 takes
0 words; equal rows each count, and so do rows without a doc_id, in one block (``row_id`` tells them apart); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, same

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_DOCS = 512
#: Blocks whose sums are added up together.
GROUP = 1024


def fill(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Targets by weight that sum to ``share`` of all sizes; none is above ``most`` times its size, and what
    is cut off goes to the others by weight until none is above."""
    total, targets, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(targets[i] for i in range(len(sizes)) if i not in open_)
        weight = sum(weights[i] for i in sorted(open_))
        above = {i for i in open_ if left * weights[i] / weight > most * sizes[i]}
        for i in open_:
            targets[i] = most * sizes[i] if i in above else left * weights[i] / weight
        if not above:
            break
        open_ -= above
    return targets


def split_quotas(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """counts: blocks of each source. Returns (shards, sources): how many of them each shard gets."""
    out = np.zeros((shards, len(counts)), np.int64)
    todo = [(0, shards, np.asarray(counts, np.int64))]
    while todo:
        low, high, have = todo.pop()
        if high - low == 1:
            out[low] = have
            continue
        mid = (low + high) // 2
        draw = np.random.default_rng([seed, low, high]).multivariate_hypergeometric
        total = int(have.sum())
        left = draw(have, total * (mid - low) // (high - low), method="marginals") if total else have
        todo += [(low, mid, left), (mid, high, have - left)]
    return out


def placed_blocks(blocks: DataFrame) -> DataFrame:
    """Adds start and nth (words and blocks of the source before the block) and per_round (the source's blocks). Sums go up
    in two levels, so that a hot source's blocks are many windows' and only one row for each ``GROUP`` blocks is in one."""
    group = F.floor(F.col("block") / GROUP)
    groups = blocks.groupBy("source", group.alias("group")).agg(F.sum("words").alias("words"), F.count("*").alias("n"))
    before, all_ = Window.partitionBy("source").orderBy("group"), Window.partitionBy("source")
    sums = [(F.sum(c).over(before) - F.col(c)).alias(f"g_{c}") for c in ("words", "n")]
    groups = groups.select(F.col("source").alias("g_source"), F.col("group").alias("g_group"), *sums, F.sum("n").over(all_).alias("per_round"))
    blocks = blocks.join(groups, same(F.col("source"), F.col("g_source")) & (group == F.col("g_group")))
    inside = Window.partitionBy("source", "g_group").orderBy("block")
    start, nth = F.col("g_words") + F.sum("words").over(inside) - F.col("words"), F.col("g_n") + F.row_number().over(inside) - 1
    return blocks.select("source", "block", "line", "quota", start.alias("start"), nth.alias("nth"), "per_round")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, shards: int = 64, seed: int = 7, max_sources: int = 20_000) -> DataFrame:
    """One row for each document and round (0 .. repeats-1) of which words are taken, and one with taken 0 for a
    document of which none are: row_id (the document's row, whatever its doc_id), doc_id, source, size, source_size, target, round, taken (the first words of
    the document), shard, place (order inside the shard)."""
    spark = docs.sparkSession
    bits = F.xxhash64(F.lit(seed), "doc_id")
    narrow = cut(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix")
    by_source = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    if (n := by_source.count()) > max_sources:
        raise ValueError(f"{n} sources; a mixture has at most max_sources = {max_sources}: group them first")
    rows = sorted(by_source.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["source_size"] for r in rows]
    targets = fill(sizes, [weights[i % len(weights)] for i in range(len(rows))], share, repeats)
    plan = spark.createDataFrame(
        [(r["source"], s, float(t), round(t), max(0, (max(1, r["docs"] // BLOCK_DOCS)).bit_length() - 1)) for r, s, t in zip(rows, sizes, targets)],
        "p_source string, source_size long, target double, quota long, depth int",
    )
    placed = narrow.join(F.broadcast(plan), same(F.col("source"), F.col("p_source"))).drop("p_source")
    placed = placed.withColumn("bits", bits).withColumn("block", F.expr("shiftrightunsigned(shiftrightunsigned(bits, 1), 63 - depth)"))
    blocks = placed.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("line"), F.first("quota").alias("quota"))
    blocks = placed_blocks(cut(blocks, "mix-sums"))
    rounds = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("round"))
    rounds = rounds.select("source", "block", "round", "quota", (F.col("start") + F.col("round") * F.col("line")).alias("from"), (F.col("nth") + F.col("round") * F.col("per_round")).alias("nth"))
    rounds = cut(rounds.where(F.col("from") < F.col("quota")), "mix-blocks")
    counts = {r["source"]: r["n"] for r in rounds.groupBy("source").agg(F.count("*").alias("n")).collect()}
    names = [r["source"] for r in rows]
    tree = split_quotas(np.array([counts.get(s, 0) for s in names], np.int64), shards, seed)
    cuts = spark.createDataFrame([(s, [int(x) for x in np.cumsum(tree[:, i])]) for i, s in enumerate(names)], "c_source string, cuts array<long>")
    drawn = rounds.join(F.broadcast(cuts), same(F.col("source"), F.col("c_source")))
    shard = F.size(F.filter("cuts", lambda c: c <= F.col("nth")))
    drawn = drawn.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "round", "from", shard.alias("shard")).where(F.col("shard") < shards)
    inside = Window.partitionBy("source", "block").orderBy("bits", "doc_id", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("offset", F.sum("size").over(inside) - F.col("size"))
    taken = placed.join(drawn, same(F.col("source"), F.col("b_source")) & (F.col("block") == F.col("b_block")), "left")
    words = F.greatest(F.lit(0), F.least("size", F.col("quota") - F.col("from") - F.col("offset")))
    taken = taken.withColumn("taken", F.coalesce(words, F.lit(0)).cast("long"))
    keep = (F.col("taken") > 0) | F.coalesce(F.col("round") == 0, F.lit(True))
    return taken.where(keep).select("row_id", "doc_id", "source", "size", "source_size", "target", F.coalesce("round", F.lit(0)).alias("round"), "taken", "shard", F.xxhash64(F.lit(seed + 1), "doc_id", "round", "shard").alias("place"))


def write_shards(mixed: DataFrame, docs: DataFrame, path: str) -> None:
    """Texts of the mix, a folder for each shard, shuffled inside it."""
    full = mixed.where("taken > 0").drop("row_id").join(docs.select(F.col("doc_id").alias("d_id"), "text"), same(F.col("doc_id"), F.col("d_id"))).drop("d_id")
    part = first_words(F.when(F.col("taken") < F.col("size"), F.col("text")), F.col("taken"))
    full.withColumn("text", F.coalesce(part, "text")).repartition("shard").sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(path)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word; null stays null."""

    @F.pandas_udf("string")
    def head(texts: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for text, count in zip(texts, counts):
            end = 0
            for m in islice(re.finditer(WORD, text), int(count)) if text is not None else ():
                end = m.end()
            out.append(None if text is None else text[:end])
        return pd.Series(out, dtype=object)

    return head(text, n)

"""Compaction of a k-mer set into simplitigs: sequences whose k-mers are members, each in exactly one of them.

An extension only ever reaches k-mers that overlap by k-1 bases, so greedy walks inside connected components, seeds in
ascending order, give what one walk over the whole set would give. A component of at most ``MOST`` k-mers is one task's group;
a larger one, as a genome is, is made into its unitigs, the paths without a branch, by pointer doubling over all tasks
(each k-mer is in one of them, too). ``by_minimizer`` groups by a hash of the minimizer instead: more and shorter sequences, the same k-mer set.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq
from ..lineage import cut
from ..shipping import ship
from .chains import places
from .graph import components
from .rank import number_rows

_STRAND = str.maketrans("ACGT", "TGCA")
OUT = "seed string, seq string, kmers long"
#: K-mers of a component that one task walks at most.
MOST = 1 << 20


def rc(s: str) -> str:
    return s.translate(_STRAND)[::-1]


def walk(kmers: list[str]) -> list[tuple[str, str]]:
    """(seed, simplitig) of a set of canonical k-mers."""
    left, out = dict.fromkeys(sorted(kmers)), []

    def extend(s: str, k: int) -> str:
        parts, end = [s], s[-(k - 1) :] if k > 1 else ""
        while True:
            for base in "ACGT":
                kmer = end + base
                kmer = min(kmer, rc(kmer))
                if kmer in left:
                    del left[kmer]
                    parts.append(base)
                    end = (end + base)[-(k - 1) :] if k > 1 else ""
                    break
            else:
                return "".join(parts)

    for seed in list(left):
        if seed in left:
            del left[seed]
            k = len(seed)
            out.append((seed, rc(extend(rc(extend(seed, k)), k))))
    return out


def _group(pdf: pd.DataFrame) -> pd.DataFrame:
    found = walk(pdf["kmer"].tolist())
    k = len(pdf["kmer"].iloc[0])
    return pd.DataFrame({"seed": [a for a, _ in found], "seq": [b for _, b in found], "kmers": [len(b) - k + 1 for _, b in found]})


def overlap_edges(kmers: DataFrame) -> DataFrame:
    """a, b: k-mers that share a canonical (k-1)-mer at an end; each links to the smallest that does (a star)."""
    k = F.length("kmer")
    ends = kmers.select("kmer", F.explode(F.array_distinct(F.array(seq.canonical(F.substring("kmer", F.lit(1), k - 1)), seq.canonical(F.substring("kmer", F.lit(2), k - 1))))).alias("end"))
    low = ends.groupBy("end").agg(F.min("kmer").alias("a"))
    return ends.join(low, "end").select("a", F.col("kmer").alias("b")).where("a != b")


def numbered(simplitigs: DataFrame, start: int = 0) -> DataFrame:
    """idx: 1.. in order of seeds."""
    return number_rows(simplitigs, [F.col("seed").asc()], "idx", start)


def unitigs(kmers: DataFrame) -> DataFrame:
    """seed, seq, kmers of the maximal paths without a branch, each on the strand on which its first k-mer is smaller; circles are opened
    at their smallest k-mer. No step gathers more than one path's k-mers.

    Both strands of each k-mer are nodes; one is linked to the next where neither has another neighbour on that side. A
    k-mer that is its own reverse complement, and a link of a k-mer to itself on either strand, end a path."""
    k = F.length("kmer")
    other = lambda c: seq.reverse_complement(c)
    nodes = kmers.select("kmer").distinct().select(F.explode(F.array_distinct(F.array("kmer", other("kmer")))).alias("kmer"))
    ends = nodes.select("kmer", F.explode(F.array(F.struct(F.substring("kmer", F.lit(1), k - 1).alias("key"), F.lit(True).alias("into")), F.struct(F.substring("kmer", F.lit(2), k - 1).alias("key"), F.lit(False).alias("into")))).alias("e"))
    only = [F.count_if(F.col("e.into")).alias("n_in"), F.count_if(~F.col("e.into")).alias("n_out"), F.min(F.when(F.col("e.into"), F.col("kmer"))).alias("id"), F.min(F.when(~F.col("e.into"), F.col("kmer"))).alias("before")]
    links = ends.groupBy("e.key").agg(*only).where("n_in = 1 and n_out = 1").select("id", "before")
    links = cut(links.where((seq.canonical("id") != seq.canonical("before")) & (F.col("id") != other("id")) & (F.col("before") != other("before"))), "links")
    ranked, circles = places(links, seq.canonical("id"))
    if circles.head(1):
        opened = links.join(circles, "id").where((F.col("id") != F.col("low")) & (F.col("before") != other("low")))
        ranked = ranked.unionByName(places(opened.select("id", "before"))[0])
    ranked = ranked.select(F.col("id").alias("kmer"), "head", "place")
    placed = nodes.join(ranked, "kmer", "left").select("kmer", F.coalesce("head", "kmer").alias("head"), F.coalesce("place", F.lit(0)).alias("place"))
    parts = F.array_sort(F.collect_list(F.struct("place", F.right("kmer", F.lit(1)).alias("base"))))
    paths = placed.groupBy("head").agg(parts.alias("parts"), F.max_by("kmer", "place").alias("tail"), F.count("*").alias("kmers"))
    paths = paths.where(F.col("head") <= other("tail"))  # else it is the other strand of a path
    text = F.concat(F.expr("left(head, length(head) - 1)"), F.array_join("parts.base", ""))
    return paths.select(seq.canonical("head").alias("seed"), text.alias("seq"), "kmers")


def simplitigs(kmers: DataFrame, most: int | None = None) -> DataFrame:
    """seed, seq, kmers of a table of canonical k-mers (kmer): greedy simplitigs of the components of at most ``most`` k-mers, unitigs of larger ones."""
    ship(kmers.sparkSession)
    kmers = kmers.select("kmer").distinct()
    comp = components(overlap_edges(kmers)).withColumnRenamed("id", "kmer")
    placed = kmers.join(comp, "kmer", "left").select("kmer", F.coalesce("component", "kmer").alias("component"))
    giant = cut(comp.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > (most or MOST)).select("component"), "giants")
    if not giant.head(1):
        return placed.groupBy("component").applyInPandas(_group, OUT)
    small = placed.join(giant, "component", "left_anti").groupBy("component").applyInPandas(_group, OUT)
    return small.unionByName(unitigs(placed.join(giant, "component", "left_semi")))


def by_minimizer(kmers: DataFrame, m: int, partitions: int = 1024) -> DataFrame:
    """The same set from walks inside groups of k-mers by a hash of their minimizer."""
    ship(kmers.sparkSession)
    k = F.length("kmer")
    mm = F.array_min(F.transform(F.sequence(F.lit(1), k - m + 1), lambda i: seq.canonical(F.substring("kmer", i, F.lit(m)))))
    return kmers.select("kmer").distinct().withColumn("part", F.pmod(F.hash(mm), F.lit(partitions))).groupBy("part").applyInPandas(_group, OUT)


def kmers_of(sequences: DataFrame, k: int, col: str = "seq") -> DataFrame:
    return seq.windows(seq.fragments(sequences, k, seq=col), k)

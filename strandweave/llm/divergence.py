"""Source divergence audit: how much the term frequencies of the sources of a language differ, by a heavy-light split.

A language keeps the terms that at least ``min_docs`` of its documents hold. Every (lang, source) group gives each kept term a smoothed
frequency in billionths, a whole number; two groups differ by the sum of absolute differences over all kept terms.

Most groups lack most terms, and a term that a group lacks has the group's base frequency there. Terms are therefore split by the
number of groups that hold them:

- heavy terms (more than ``light`` groups): dense tiles of numpy, ``TERMS`` terms x (``SIDE`` + ``SIDE``) groups, in which a term that a
  group lacks stands at the group's base;
- light terms: of each group pair what the groups' bases alone would give, corrected for a group's own postings (from its sorted
  frequencies and their prefix sums) and for terms that both hold (from pairs of a term's postings, ``light`` at most).

All partial sums are whole numbers and are added up exactly. Counting is one pass over whole texts with a sum for each batch before the only
large shuffle, whose key is (lang, source, term), so no group, however large, is one task's. Tiles hold a bounded number of rows
each, and are dealt by hashes of term and source; only the result itself has a row for each pair of sources of a language. Nothing is
broadcast unless Spark does so under its own threshold, and the driver gets nothing.

Defined cases: null text, lang and source are as ''; equal rows are a document each; a group without terms has base frequencies, or none
where its language keeps no term (its pairs differ by 0); a language with one source has no pairs; an empty table gives no rows; other
columns are ignored. Ties are ranked by item as UTF-8. A long text takes about 30 bytes of memory for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, byte_class, cut, flat, map_arrow, steps, word_spans

#: `[^\x00-\x40\x5B-\x60\x7B-\x7F]`: letters, and bytes of characters beyond ASCII.
TERM = byte_class([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: Terms and groups of a dense tile, about: both are dealt by hash.
TERMS, SIDE = 256, 64
PAIR = "lang string, x string, y string, value long"


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it), written. Each group has a row with term '' as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(2))
            groups = pa.table({"lang": batch.column(0), "source": batch.column(1), "row": pa.array(np.arange(batch.num_rows))})
            for low, high in steps(offsets):
                part, own = LOWER[data[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low]
                starts, ends = word_spans(part, own, TERM)
                row = np.searchsorted(own, starts, "right") - 1 + low
                # a term's bytes, then those between it and the next one, which are left out
                edges = np.empty(2 * len(starts) + 1, np.int64)
                edges[0:-1:2], edges[1::2], edges[-1] = starts, ends, len(part)
                pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(edges), pa.py_buffer(part)])
                terms = pieces.take(pa.array(np.arange(0, 2 * len(starts), 2)))
                each = pa.table({"row": pa.array(row), "term": terms}).group_by(["row", "term"]).aggregate([([], "count_all")])
                named = groups.take(each.column("row"))
                sums = pa.table({"lang": named.column("lang"), "source": named.column("source"), "term": each.column("term"), "n": each.column("count_all")})
                sums = sums.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ([], "count_all")])
                yield from pa.table({"lang": sums.column("lang"), "source": sums.column("source"), "term": pc.cast(sums.column("term"), pa.string()), "n": sums.column("n_sum"), "docs": pc.cast(sums.column("count_all"), pa.int64())}).to_batches()
            marks = groups.group_by(["lang", "source"]).aggregate([])
            zero = pa.array(np.zeros(marks.num_rows, np.int64))
            yield from pa.table({"lang": marks.column("lang"), "source": marks.column("source"), "term": pa.array([""] * marks.num_rows), "n": zero, "docs": zero}).to_batches()

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    counted = map_arrow(docs.select(*text), run, "lang string, source string, term string, n long, docs long")
    return cut(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")


def frequency(n: str, total: str, kept: str):
    """Smoothed, in billionths; exact for any counts."""
    return F.expr(f"cast(1 + (cast(1000000000 as decimal(10, 0)) * cast({n} + 5 as decimal(20, 0))) div cast({total} + 5 * {kept} as decimal(20, 0)) as long)")


def _dense(pdf: pd.DataFrame) -> pd.DataFrame:
    """One tile: rows of groups (p the base, terms how many the slice has) and of postings (term); pairs of a group of its left and one of its right block."""
    lang, left = pdf["lang"].iloc[0], pdf["left"].iloc[0] == pdf["right"].iloc[0]
    is_group = pdf["term"].isna()
    groups = pdf[is_group].sort_values("source")
    names, side = groups["source"].to_numpy(object), groups["block"].to_numpy()
    at = {name: i for i, name in enumerate(names)}
    held = pdf[~is_group]
    terms, column = np.unique(held["term"].to_numpy(object), return_inverse=True)
    p = np.repeat(groups["p"].to_numpy(np.int64)[:, None], len(terms), axis=1)
    p[held["source"].map(at).to_numpy(np.int64), column] = held["p"].to_numpy(np.int64)
    base, absent = groups["p"].to_numpy(np.int64), int(groups["terms"].iloc[0]) - len(terms)  # terms of the slice that no group of the tile holds
    xs = np.flatnonzero(side == pdf["left"].iloc[0])
    ys = xs if left else np.flatnonzero(side == pdf["right"].iloc[0])
    out = []
    for x in xs:
        other = ys[ys > x] if left else ys
        value = np.abs(p[other] - p[x]).sum(axis=1) + absent * np.abs(base[other] - base[x])
        out.append(pd.DataFrame({"x": names[x], "y": names[other], "value": value}))
    table = pd.concat(out) if out else pd.DataFrame({"x": names[:0], "y": names[:0], "value": base[:0]})
    return table.assign(lang=lang)[["lang", "x", "y", "value"]]


def _own(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a left and a right block: light terms' bases, corrected for the left groups' own postings, and for the right ones'.

    Rows of groups have n null, p the base and terms the language's light terms; others: n postings of the group at frequency p."""
    lang, first, second = pdf["lang"].iloc[0], pdf["left"].iloc[0], pdf["right"].iloc[0]
    is_group = pdf["n"].isna()
    groups = pdf[is_group].sort_values("source")
    names, side, base = groups["source"].to_numpy(object), groups["block"].to_numpy(), groups["p"].to_numpy(np.int64)
    light = int(groups["terms"].iloc[0])
    held = {s: (g["p"].to_numpy(np.int64), g["n"].to_numpy(np.int64)) for s, g in pdf[~is_group].sort_values("p").groupby("source")}
    none = np.zeros(0, np.int64)

    def correction(i: int, bases: np.ndarray) -> np.ndarray:
        """Of group i's postings, as others with these bases, which lack the terms, differ from them."""
        p, n = held.get(names[i], (none, none))
        below = np.concatenate([[0], np.cumsum(n)])
        sums = np.concatenate([[0], np.cumsum(n * p)])
        k = np.searchsorted(p, bases)
        away = sums[-1] - 2 * sums[k] - bases * (below[-1] - 2 * below[k])
        return away - below[-1] * np.abs(base[i] - bases)

    xs, ys = np.flatnonzero(side == first), np.flatnonzero(side == second)
    value = light * np.abs(base[xs][:, None] - base[ys][None, :])
    for i, x in enumerate(xs):
        value[i] += correction(x, base[ys])
    for j, y in enumerate(ys):
        value[:, j] += correction(y, base[xs])
    i, j = np.nonzero(xs[:, None] < ys[None, :]) if first == second else np.indices(value.shape).reshape(2, -1)
    return pd.DataFrame({"lang": lang, "x": names[xs[i]], "y": names[ys[j]], "value": value[i, j]})


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections for terms that both groups of a pair hold: what they differ by there, instead of what each was taken to differ by
    from the other's base. Rows: lang, postings (source, p, base) of a light term; summed up for each batch."""
    for batch in batches:
        lang, lists = batch.column(0), batch.column(1)
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        posts = lists.flatten()
        source, p, base = posts.field(0), posts.field(1).to_numpy(), posts.field(2).to_numpy()
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        left, right, row = [], [], []
        for k in np.unique(size):  # lists of one length have the same pairs
            rows = np.flatnonzero(size == k)
            a, b = np.triu_indices(k, 1)
            left.append((begin[rows][:, None] + a).ravel())
            right.append((begin[rows][:, None] + b).ravel())
            row.append(np.repeat(rows, len(a)))
        if not left:
            continue
        a, b = np.concatenate(left), np.concatenate(right)
        value = np.abs(p[a] - p[b]) - np.abs(p[a] - base[b]) - np.abs(p[b] - base[a]) + np.abs(base[a] - base[b])
        sums = pa.table({"lang": lang.take(pa.array(np.concatenate(row))), "x": source.take(pa.array(a)), "y": source.take(pa.array(b)), "value": pa.array(value)})
        yield from sums.group_by(["lang", "x", "y"]).aggregate([("value", "sum")]).rename_columns(["lang", "x", "y", "value"]).to_batches()


def _tiled(rows: DataFrame, blocks: DataFrame, *keys: str) -> DataFrame:
    """rows (lang, source, block, ...) once for each pair of blocks (left <= right) that their block is in."""
    n = blocks.select("lang", F.col("blocks").alias("_blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    return rows.join(n, "lang").select("*", other).select(F.least("block", "_other").alias("left"), F.greatest("block", "_other").alias("right"), *rows.columns)


def divergence(docs: DataFrame, min_docs: int = 30, light: int = 8, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair``, every other source of the language; ``term``, the ``top`` kept terms that a
    source uses most above its language."""
    counted = count_terms(docs)
    has = counted.where("term != ''")
    kept = has.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.count("*").alias("groups")).where(F.col("docs") >= min_docs)
    kept = cut(kept.select("lang", "term", "lang_n", "groups"), "kept")
    found = cut(has.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "groups"), "postings")

    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"), F.count_if(F.col("groups") <= light).alias("light_terms"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counted.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = groups.select("lang", "source", *map(zero, ("total", "terms", "lang_total", "light_terms")))
    base = F.when(F.col("terms") > 0, frequency("0", "total", "terms")).otherwise(0).alias("base")
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
    groups = cut(groups.join(sizes, "lang").select("lang", "source", "total", "terms", "lang_total", "light_terms", base, block, "blocks"), "groups")
    blocks = groups.select("lang", "blocks").distinct()

    known = groups.select("lang", "source", "total", "terms", "lang_total", "base", "block")
    p = frequency("n", "total", "terms").alias("p")
    q = frequency("lang_n", "lang_total", "terms").alias("q")
    found = cut(found.join(known, ["lang", "source"]).select("lang", "source", "term", "groups", "base", "block", p, q), "frequencies")

    # heavy terms
    many = kept.where(F.col("groups") > light)
    slices = many.groupBy("lang").agg(F.ceil(F.count("*") / TERMS).cast("int").alias("slices"))
    piece = F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice")
    heavy = found.where(F.col("groups") > light).join(slices, "lang").select("lang", "source", "block", piece, "term", "p", F.lit(None).cast("long").alias("terms"))
    sliced = many.join(slices, "lang").groupBy("lang", piece).agg(F.count("*").alias("terms"))
    bases = groups.drop("terms").join(sliced, "lang").select("lang", "source", "block", "slice", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"), "terms")
    dense = _tiled(bases.unionByName(heavy), blocks).groupBy("lang", "slice", "left", "right").applyInPandas(_dense, PAIR)

    # light terms
    few = found.where(F.col("groups") <= light)
    own = few.groupBy("lang", "source", "block", "p").agg(F.count("*").alias("n")).select("lang", "source", "block", "p", "n", F.lit(None).cast("long").alias("terms"))
    each = groups.select("lang", "source", "block", F.col("base").alias("p"), F.lit(None).cast("long").alias("n"), F.col("light_terms").alias("terms"))
    alone = _tiled(each.unionByName(own), blocks).groupBy("lang", "left", "right").applyInPandas(_own, PAIR)
    lists = few.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "base"))).alias("posts"))
    both = map_arrow(lists.where(F.size("posts") > 1).select("lang", "posts"), _together, PAIR)

    pairs = dense.unionByName(alone).unionByName(both)
    pairs = pairs.select("lang", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "value").groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item")))).alias("e")
    pairs = pairs.select("lang", ends, "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    terms = found.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item")))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))

"""Subtraction of a k-mer set from a stream of records: distinct, per occurrence, counters only, or as segments.

The index is made distinct and written once (``build``), so a probe never multiplies and Spark knows the index's size: it is
broadcast under Spark's own threshold, and windows are not shuffled then; else both sides are shuffled on the k-mer, and AQE
can split the windows of a hot k-mer, as it couldn't beside an aggregate made in the same plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from ..functions import codes, marks, seq
from ..lineage import cut

#: Bits of a probe filter for each k-mer, those of one of its bitmaps (the built-in aggregate's size), and the bytes that are sent at most.
FILTER_BITS = 16
MAP_BITS = 32768
FILTER_BYTES = 256 << 20


@dataclass(frozen=True)
class Index:
    """Distinct k-mers (kmer) in the shared folder, for any number of queries."""

    kmers: DataFrame


def build(index: DataFrame | Index) -> Index:
    return index if isinstance(index, Index) else Index(cut(index.select("kmer").distinct(), "index"))


def check_k(k: int, m: int | None = None) -> int:
    """Odd k in 3..63; returns m, by default the largest odd one up to 19 and k - 2."""
    if not 3 <= k <= 63 or k % 2 == 0:
        raise ValueError("k must be odd and in 3..63")
    if m is None:
        m = min(19, k - 2)
        m -= m % 2 == 0
    if not 0 < m < k:
        raise ValueError("m must be in 1..k-1")
    return m


def subtract_distinct(reads: DataFrame, index: DataFrame | Index, k: int, col: str = "seq") -> DataFrame:
    """Distinct k-mers of the records that the index (kmer) lacks."""
    known = build(index).kmers
    if k <= codes.MOST_K:
        found = codes.summed(reads, k, col=col, as_text=False).select("kmer")
        return codes.with_text(found.join(known.select(codes.number("kmer", k).alias("kmer")), "kmer", "left_anti"), k)
    return seq.windows(seq.fragments(reads, k, seq=col), k).distinct().join(known, "kmer", "left_anti")


def absent_windows(reads: DataFrame, index: DataFrame | Index, k: int, *keys: str, col: str = "seq") -> DataFrame:
    """Every window occurrence that the index lacks."""
    return seq.windows(seq.fragments(reads, k, *keys, seq=col), k, *keys).join(build(index).kmers, "kmer", "left_anti")


def marked(reads: DataFrame, index: DataFrame | Index, k: int, *keys: str, place: bool = False, col: str = "seq") -> DataFrame:
    """Windows with ``hit``: the index has them."""
    w = seq.windows(seq.fragments(reads, k, *[x for x in keys if x != "frag"], seq=col), k, *keys, place=place)
    return w.join(build(index).kmers.withColumn("in_index", F.lit(True)), "kmer", "left").withColumn("hit", F.coalesce("in_index", F.lit(False))).drop("in_index")


def stats(reads: DataFrame, index: DataFrame | Index, k: int, *keys: str, col: str = "seq") -> DataFrame:
    """Per keys (or in all): scanned, filtered and not_filtered window occurrences.

    An index of some megabytes is sent to the tasks (``marks.sent``), which sum up each row's windows; a larger one is joined."""
    index = build(index)
    if (known := marks.sent(index.kmers, k)) is not None:
        each = marks.sums(reads, k, known, list(keys), col)
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
        both = each.groupBy(*keys).agg(total("scanned"), total("filtered")) if keys else each.agg(total("scanned"), total("filtered"))
        return both.withColumn("not_filtered", F.col("scanned") - F.col("filtered"))
    w = marked(reads, index, k, *keys, col=col)
    out = [F.count("*").alias("scanned"), F.count_if("hit").alias("filtered"), F.count_if(~F.col("hit")).alias("not_filtered")]
    return w.groupBy(*keys).agg(*out) if keys else w.agg(*out)


def segments(reads: DataFrame, index: DataFrame | Index, k: int, record: str = "record_idx", col: str = "seq") -> DataFrame:
    """record, frag, start, seq: what remains of each fragment, for each maximal run of windows that the index lacks.

    Only windows that the index has are kept, as sorted lists for each piece of a fragment; what lies between them is cut from the piece. Runs that
    touch a piece's edge are joined by fragment afterwards, so the work is in proportion to a record's length. Equal rows of one record each have their segments;
    rows of one record with different sequences must have different ids.

    With an index of some megabytes, which is sent to the tasks, a record's segments are found whole in its row."""
    index = build(index)
    if (known := marks.sent(index.kmers, k)) is not None:
        return marks.segments(reads, k, known, record, col)
    frags = seq.fragments(reads, k, record, seq=col)
    block = F.floor(F.col("pos") / seq.PIECE).cast("int")
    hits = seq.windows(frags, k, record, "frag", place=True).join(build(index).kmers, "kmer", "left_semi")
    hits = hits.groupBy(F.col(record).alias("h_record"), F.col("frag").alias("h_frag"), block.alias("h_block")).agg(F.sort_array(F.collect_list((F.col("pos") % seq.PIECE).cast("int"))).alias("hits"))
    p = seq.pieces(frags, k, record, "frag")
    here = F.col(record).eqNullSafe(F.col("h_record")) & (F.col("frag") == F.col("h_frag")) & ((F.col("start") / seq.PIECE).cast("int") == F.col("h_block"))
    n = F.octet_length("f") - k + 1
    p = p.join(hits, here, "left").select(record, "frag", F.col("start").alias("piece"), "f", n.alias("n"), F.explode(F.array(F.coalesce("hits", F.expr("cast(array() as array<int>)")))).alias("hits"))
    gaps = F.zip_with(F.concat(F.array(F.lit(-1)), "hits"), F.concat("hits", F.array("n")), lambda a, b: F.struct((a + 1).alias("at"), (b - a - 1).alias("windows")))
    p = p.select(record, "frag", "piece", "f", "n", F.explode(F.filter(gaps, lambda g: g["windows"] > 0)).alias("g"))
    edge = ((F.col("g.at") == 0) & (F.col("piece") > 0)) | (F.col("g.at") + F.col("g.windows") == seq.PIECE)
    part = F.substring("f", F.col("g.at") + 1, F.col("g.windows") + k - 1).cast("string")
    runs = p.select(record, "frag", (F.col("piece") + F.col("g.at")).alias("start"), F.col("g.windows").alias("windows"), part.alias("seq"), edge.alias("edge"))
    return runs.where("not edge").select(record, "frag", "start", "seq").unionByName(_joined(runs.where("edge"), record, k))


def _joined(runs: DataFrame, record: str, k: int) -> DataFrame:
    """Runs that follow one another in a fragment as one: each but the first gives up the k-1 bases that it shares with the one before. Rows
    with equal starts are those of equal records, told apart by their number."""
    copy = F.row_number().over(Window.partitionBy(record, "frag", "start").orderBy("windows"))
    order = Window.partitionBy(record, "frag", "copy").orderBy("start")
    goes_on = F.lag(F.col("start") + F.col("windows")).over(order) == F.col("start")
    runs = runs.withColumn("copy", copy).withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    runs = runs.withColumn("seq", F.when(F.col("new") == 1, F.col("seq")).otherwise(F.substring("seq", k, seq.PIECE)))
    whole = runs.groupBy(record, "frag", "copy", "run").agg(F.min("start").alias("start"), F.array_sort(F.collect_list(F.struct("start", "seq"))).alias("parts"))
    return whole.select(record, "frag", "start", F.array_join("parts.seq", "").alias("seq"))


def filter_bits(kmers: int, most: int | None = None) -> int | None:
    """Bits of a probe filter of so many k-mers: 16 for each, in whole bitmaps; None if they are more than ``most`` bytes (by default ``FILTER_BYTES``)."""
    maps = max(1, -(-kmers * FILTER_BITS // MAP_BITS))
    return maps * MAP_BITS if maps * MAP_BITS // 8 <= (FILTER_BYTES if most is None else most) else None


def _probe(windows: DataFrame, kmers: DataFrame, bits: int) -> DataFrame:
    """The windows with ``may_be``: false or null for those that the k-mers' filter lacks.

    The filter has a bit for each k-mer's hash, made by tasks as bitmaps of 4 KB and looked up by a broadcast join on the bitmap's number."""
    bit = F.pmod(F.xxhash64("kmer"), F.lit(bits))
    number, place = F.floor(bit / MAP_BITS), (bit % MAP_BITS).cast("int")
    maps = cut(kmers.groupBy(number.alias("map")).agg(F.bitmap_construct_agg(bit % MAP_BITS).alias("bits")), "filter")
    byte = F.conv(F.hex(F.substring("bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may_be = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), place % 8 + 1)) != 0
    return windows.withColumn("map", number).join(F.broadcast(maps), "map", "left").withColumn("may_be", may_be)


def probed_stats(reads: DataFrame, index: DataFrame | Index, k: int, *keys: str, col: str = "seq", most: int | None = None) -> DataFrame:
    """Like ``stats``, for an index too large to be sent but whose probe filter isn't (``filter_bits``; a larger one is ``stats``).

    Windows that the filter lacks are surely absent, and are only counted; others are counted by k-mer before they are shuffled to the index. With
    16 bits a k-mer, one in 16 absent windows passes, and is told by the join: counts are exact.

    Up to k = 31 and with one key of text or numbers at most, tasks look up packed numbers (``marks.probed``); else a window is a row."""
    built = build(index)
    bits = filter_bits(built.kmers.count(), most)
    if bits is None:
        return stats(reads, built, k, *keys, col=col)
    if k <= codes.MOST_K and len(keys) < 2 and all(isinstance(reads.schema[x].dataType, StringType | IntegralType) for x in keys):
        each = marks.probed(reads, built.kmers, k, bits, keys[0] if keys else None, col)
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("scanned", "filtered")]
        both = each.groupBy(F.col("key").alias(keys[0])).agg(*sums) if keys else each.agg(*sums)
        return both.withColumn("not_filtered", F.col("scanned") - F.col("filtered"))
    w = seq.windows(seq.fragments(reads, k, *keys, seq=col), k, *keys)
    probe = _probe(w, built.kmers, bits).withColumn("probe", F.when(F.col("may_be"), F.col("kmer")))
    counted = probe.groupBy(*keys, "probe").agg(F.count("*").alias("n"))
    met = counted.join(built.kmers.withColumn("hit", F.lit(True)), F.col("probe") == F.col("kmer"), "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    hit = F.when(F.col("hit"), F.col("n")).otherwise(0)
    out = [total(F.col("n")).alias("scanned"), total(hit).alias("filtered"), total(F.col("n") - hit).alias("not_filtered")]
    return met.groupBy(*keys).agg(*out) if keys else met.agg(*out)


def probed_absent(reads: DataFrame, index: DataFrame | Index, k: int, *keys: str, col: str = "seq", most: int | None = None) -> DataFrame:
    """Like ``absent_windows``, for such an index: windows that the filter lacks are part of the result as they are, and only the others, at
    most those in the index and one in 16 of the rest, are shuffled to it. Both parts make the windows, which costs CPU for the network's sake.
    sf0.1 with nothing else sent: 26 MB of shuffle instead of 150 MB, 9.3 s instead of 5.8 s on 8 cores."""
    built = build(index)
    bits = filter_bits(built.kmers.count(), most)
    if bits is None:
        return absent_windows(reads, built, k, *keys, col=col)
    probe = _probe(seq.windows(seq.fragments(reads, k, *keys, seq=col), k, *keys), built.kmers, bits)
    sure = probe.where(~F.coalesce("may_be", F.lit(False)))
    # an anti join would be pushed below the filter's join, and shuffle every window
    others = probe.where("may_be").join(built.kmers.withColumn("in_index", F.lit(True)), "kmer", "left").where("in_index IS NULL")
    return sure.select("kmer", *keys).unionByName(others.select("kmer", *keys))


def nucleotides(segs: DataFrame) -> DataFrame:
    return segs.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long").alias("nucleotides"))

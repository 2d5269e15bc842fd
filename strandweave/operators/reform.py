"""Reforming: records that overlap by exactly k-1 bases are linked end to start, on either strand, into longer ones.

Endpoints, candidates, strands, abundances and orders are column expressions. Which links are taken is a sequential choice in
order of keys; keys that can't touch each other's paths are decided together, in rounds, on ids and keys alone
(``links``). Places along a path come from the links by pointer doubling; sequences are joined afterwards.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq
from ..lineage import cut
from ..shipping import ship
from .chains import places
from .rank import number_rows

RUNS = "array<struct<value: double, len: long>>"
_LINK = "link boolean, a long, a_reverse boolean, b long, b_reverse boolean"
_LINKS = ["link", "a", "a_reverse", "b", "b_reverse"]
#: Open ends and starts that one task links at most.
LOCAL_ENDS = 1 << 20
MODES = ("simplitig", "unitig")


def parse_abundance(header: Column, kmers: Column) -> Column:
    """Runs of the first `km:f:` or `ka:f:` tag: one value, or value:length pairs that sum to the record's k-mers."""
    tag = F.regexp_extract(header, r"(?:^|\s)k[ma]:f:(\S+)", 1)
    parts = F.split(tag, ":")
    number = lambda x: x.cast("double")
    one = F.array(F.struct(number(parts[0]).alias("value"), kmers.cast("long").alias("len")))
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size(parts) / 2).cast("int")), lambda i: F.struct(F.element_at(parts, i * 2 - 1).cast("double").alias("value"), F.element_at(parts, i * 2).cast("long").alias("len")))
    total = F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + x["len"])
    fail = lambda what: F.raise_error(F.concat(F.lit(what + ": "), header)).cast(RUNS)
    wild = lambda runs: F.exists(runs, lambda x: F.isnan(x["value"]) | (F.abs(x["value"]) == float("inf")))
    return (
        F.when(tag == "", fail("missing abundance"))
        .when(F.size(parts) == 1, F.when(wild(one), fail("non-finite abundance")).otherwise(one))
        .when((F.size(parts) % 2 != 0) | F.exists(pairs, lambda x: x["len"] <= 0), fail("malformed runs"))
        .when(total != kmers, F.raise_error(F.concat(F.lit("runs sum to "), total.cast("string"), F.lit(", not to the k-mers of "), header)).cast(RUNS))
        .when(wild(pairs), fail("non-finite abundance"))
        .otherwise(pairs)
    )


def validate(records: DataFrame, k: int, abundance: bool = True) -> DataFrame:
    """unitig_id, seq, kmers, runs (if asked) of records (unitig_id, header, seq)."""
    if not 2 <= k <= 64:
        raise ValueError("k must be in 2..64")
    s = F.upper("seq")
    s = F.when(F.length(s) < k, F.raise_error(F.concat(F.lit(f"record shorter than k={k}: "), F.col("header")))).when(s.rlike("[^ACGT]"), F.raise_error(F.concat(F.lit("non-ACGT base in "), F.col("header")))).otherwise(s).cast("string")
    kmers = (F.length("seq") - k + 1).cast("long")
    return records.select("unitig_id", s.alias("seq"), kmers.alias("kmers"), *([parse_abundance(F.col("header"), kmers).alias("runs")] if abundance else []))


def endpoints(units: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Starts and ends: (key, unitig_id, reverse) of each record on either strand."""
    first, last = F.substring("seq", 1, k - 1), F.right("seq", F.lit(k - 1))
    both = lambda a, b: units.select("unitig_id", F.explode(F.array(F.struct(a.alias("key"), F.lit(False).alias("reverse")), F.struct(seq.reverse_complement(b).alias("key"), F.lit(True).alias("reverse")))).alias("e")).select("e.key", "unitig_id", "e.reverse")
    return both(first, last), both(last, first)


def candidates(units: DataFrame, k: int) -> DataFrame:
    """key, from_id, from_reverse, to_id, to_reverse: ends and starts of different records on one key."""
    starts, ends = endpoints(units, k)
    return ends.select("key", F.col("unitig_id").alias("from_id"), F.col("reverse").alias("from_reverse")).join(starts.select("key", F.col("unitig_id").alias("to_id"), F.col("reverse").alias("to_reverse")), "key").where("from_id != to_id")


class _Linker:
    """Links taken so far: taken ends, fixed strands, and which records are already in one path (a record's label is any of its path's)."""

    def __init__(self, labels: Iterable[tuple[int, int]] = ()):
        self.links: list[tuple[int, bool, int, bool]] = []
        self.out: set[int] = set()
        self.into: set[int] = set()
        self.strand: dict[int, bool] = {}
        self.top: dict[int, int] = dict(labels)

    def root(self, x: int) -> int:
        while (up := self.top.setdefault(x, x)) != x:
            self.top[x] = x = self.top.setdefault(up, up)
        return x

    def open(self, x: tuple[int, bool], taken: set[int]) -> bool:
        return x[0] not in taken and self.strand.get(x[0], x[1]) == x[1]

    def fitting(self, x: tuple[int, bool], others: deque, taken: set[int], most: int) -> list[tuple[int, bool]]:
        """The first ``most`` of ``others`` in another path than x's; what is over for good leaves ``others``. At most two open ones
        are in x's own path, so the work over a key is in proportion to its records."""
        found, kept = [], []
        while others and len(found) < most:
            y = others.popleft()
            if self.open(y, taken):
                kept.append(y)
                if self.root(x[0]) != self.root(y[0]):
                    found.append(y)
        others.extendleft(reversed(kept))
        return found

    def link_key(self, ends: list[tuple[int, bool]], starts: list[tuple[int, bool]], greedy: bool) -> None:
        """The ends of one key in order. greedy: each takes the first start that fits; else only a pair whose end fits exactly one start,
        and whose start fits exactly one end, in the state reached so far."""
        order, es, ss = sorted(ends), deque(sorted(ends)), deque(sorted(starts))
        for e in order:
            if self.open(e, self.out):
                fit = self.fitting(e, ss, self.into, 1 if greedy else 2)
                if len(fit) == 1 and (greedy or len(self.fitting(fit[0], es, self.out, 2)) == 1):
                    s = fit[0]
                    self.links.append((*e, *s))
                    self.out.add(e[0])
                    self.into.add(s[0])
                    self.strand[e[0]], self.strand[s[0]] = e[1], s[1]
                    self.top[self.root(e[0])] = self.root(s[0])


def _linked(pdf: pd.DataFrame, mode: str) -> _Linker:
    """Keys ascending, of open ends and starts (key, unit_id, reverse, is_end, path, alone)."""
    keys: dict[str, tuple[list, list, bool]] = {}
    for key, unit, rev, end, alone in zip(pdf["key"], pdf["unit_id"], pdf["reverse"], pdf["is_end"], pdf["alone"]):
        keys.setdefault(key, ([], [], bool(alone)))[0 if end else 1].append((int(unit), bool(rev)))
    state = _Linker(zip(pdf["unit_id"].tolist(), pdf["path"].tolist()))
    for key in sorted(keys):
        ends, starts, alone = keys[key]
        state.link_key(ends, starts, mode == "simplitig" or alone)
    return state


def _step(mode: str):
    """Links of one key, and the new labels of the paths that they join."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state = _linked(pdf, mode)
        moved = [(False, p, False, top, False) for p in sorted(set(pdf["path"].tolist())) if (top := state.root(p)) != p]
        return pd.DataFrame([(True, *x) for x in state.links] + moved, columns=_LINKS)

    return run


def _finish(mode: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if held:
            yield pd.DataFrame([(True, *x) for x in _linked(pd.concat(held), mode).links], columns=_LINKS)

    return run


def links(units: DataFrame, k: int, mode: str = "simplitig") -> DataFrame:
    """from_id, from_reverse, to_id, to_reverse: the links that a pass over all keys in ascending order takes, without a circle.

    A key's choice looks at the open ends and starts on it and at the paths these are in, of which a path has two (a single record
    four). So a key may be decided as soon as it is the smallest open key of every path on it: smaller keys can't touch those paths. A round
    decides all such keys at once, each a group (at most 4 ends and 4 starts if k-mers are distinct, as in simplitigs; ids
    only), joins the paths' labels and closes what their links take. The smallest open key is always decided; on keys in random order rounds are
    few, on a chain whose keys ascend there is one for each key. ``LOCAL_ENDS`` open ends and starts or fewer are finished by one task."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spark = units.sparkSession
    ship(spark)
    starts, ends = endpoints(units, k)
    rows = starts.withColumn("is_end", F.lit(False)).unionByName(ends.withColumn("is_end", F.lit(True)))
    n_ends, n = F.count_if("is_end"), F.count("*")
    keys = cut(rows.groupBy("key").agg(n_ends.alias("e"), (n - n_ends).alias("s")).where("e > 0 and s > 0").select("key", F.expr("e = 1 and s = 1").alias("alone")), "keys")
    state = cut(rows.join(keys, "key").select("key", F.col("unitig_id").alias("unit_id"), "reverse", "is_end", F.col("unitig_id").alias("path"), "alone"), "ends")
    steps = []
    while state.count() > LOCAL_ENDS:
        on_key, on_path = Window.partitionBy("key"), Window.partitionBy("path")
        both = state.withColumn("both", F.max("is_end").over(on_key) & ~F.min("is_end").over(on_key)).where("both").drop("both")
        ready = F.min(F.col("key") == F.col("low")).over(on_key)
        marked = cut(both.withColumn("low", F.min("key").over(on_path)).withColumn("ready", ready).drop("low"), "marked")
        step = cut(marked.where("ready").groupBy("key").applyInPandas(_step(mode), _LINK), "links")
        steps.append(step.where("link"))
        side = lambda at, out: steps[-1].select(F.col(at).alias("unit_id"), F.col(at + "_reverse").alias("strand"), F.lit(out).alias("out"), F.lit(not out).alias("into"))
        fixed = side("a", True).unionByName(side("b", False)).groupBy("unit_id").agg(F.max("strand").alias("strand"), F.max("out").alias("out"), F.max("into").alias("into"))
        moved = step.where("not link").select(F.col("a").alias("path"), F.col("b").alias("top"))
        left = marked.where("not ready").join(fixed, "unit_id", "left").where("strand is null or strand = reverse and not if(is_end, out, into)")
        state = cut(left.join(moved, "path", "left").select("key", "unit_id", "reverse", "is_end", F.coalesce("top", "path").alias("path"), "alone"), "ends")
    steps.append(state.coalesce(1).mapInPandas(_finish(mode), _LINK))
    taken = reduce(DataFrame.unionByName, steps)
    return cut(taken.select(F.col("a").alias("from_id"), F.col("a_reverse").alias("from_reverse"), F.col("b").alias("to_id"), F.col("b_reverse").alias("to_reverse")), "taken")


def paths(units: DataFrame, k: int, mode: str = "simplitig") -> DataFrame:
    """path_id (its head's unitig_id: discovery order), path_idx, unitig_id, reverse; places along a path by pointer doubling over the links."""
    taken = links(units, k, mode)
    place, _ = places(taken.select(F.col("to_id").alias("id"), F.col("from_id").alias("before")))
    strand = taken.select(F.col("from_id").alias("unitig_id"), F.col("from_reverse").alias("reverse")).unionByName(taken.select(F.col("to_id").alias("unitig_id"), F.col("to_reverse").alias("reverse"))).distinct()
    all_ = units.select("unitig_id").join(strand, "unitig_id", "left").join(place.withColumnRenamed("id", "unitig_id"), "unitig_id", "left")
    return all_.select(F.coalesce("head", "unitig_id").alias("path_id"), F.coalesce("place", F.lit(0)).cast("int").alias("path_idx"), "unitig_id", F.coalesce("reverse", F.lit(False)).alias("reverse"))


def reverse_runs(runs: Column) -> Column:
    return F.reverse(runs)


def render(units: DataFrame, path_rows: DataFrame, k: int) -> DataFrame:
    """path_id, seq, unitigs, kmers, mean, runs: later records give up the k-1 bases that they share."""
    one = path_rows.join(units, "unitig_id")
    has_runs = "runs" in units.columns
    s = F.when(F.col("reverse"), seq.reverse_complement("seq")).otherwise(F.col("seq"))
    own = F.when(F.col("path_idx") == 0, s).otherwise(F.substring(s, F.lit(k), F.length("seq")))
    cols = [F.col("path_idx"), own.alias("part"), F.col("kmers")] + ([F.when(F.col("reverse"), reverse_runs(F.col("runs"))).otherwise(F.col("runs")).alias("runs")] if has_runs else [])
    p = one.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("p"), F.count("*").alias("unitigs"), F.sum("kmers").alias("kmers"))
    out = [F.col("path_id"), F.array_join(F.col("p.part"), "").alias("seq"), F.col("unitigs"), F.col("kmers")]
    if has_runs:
        out.append(F.flatten(F.col("p.runs")).alias("runs"))
    return p.select(*out)


def mean_abundance(runs: Column) -> Column:
    """Weighted by k-mers, rounded half away from zero."""
    return F.round(F.aggregate(runs, F.lit(0.0), lambda s, x: s + x["value"] * x["len"]) / F.aggregate(runs, F.lit(0).cast("long"), lambda s, x: s + x["len"])).cast("long")


def coalesced(runs: Column) -> Column:
    """Values rounded, then equal neighbours merged."""
    start = F.expr("cast(array() as array<struct<value: long, len: long>>)")

    def step(s: Column, x: Column) -> Column:
        v = F.round(x["value"]).cast("long")
        last = F.element_at(s, -1)
        item = lambda n: F.array(F.struct(v.alias("value"), n.alias("len")))
        return F.when(F.size(s) == 0, item(x["len"])).when(last["value"] == v, F.concat(F.slice(s, F.lit(1), F.size(s) - 1), item(last["len"] + x["len"]))).otherwise(F.concat(s, item(x["len"])))

    return F.aggregate(runs, start, step)


def abundance_tag(runs: Column, mode: str = "mean") -> Column:
    if mode == "mean":
        return F.concat(F.lit("km:f:"), mean_abundance(runs).cast("string"))
    c = coalesced(runs)
    many = F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["value"].cast("string"), x["len"].cast("string"))), ":")
    return F.concat(F.lit("km:f:"), F.when(F.size(c) == 1, c[0]["value"].cast("string")).otherwise(many))


def strand_reversed(s: Column, tiebreak: str = "none") -> Column:
    """Whether a record is written as its reverse complement: fewer than half of its bases are A or C; on a tie by its prefix."""
    r = seq.reverse_complement(s)
    twice, n = seq.ac_count(s) * 2, F.length(s)
    prefix = seq.prefix_key(r) < seq.prefix_key(s)
    p_ac, r_ac = seq.ac_count(F.substring(s, 1, 32)), seq.ac_count(F.substring(r, 1, 32))
    tie = {"none": F.lit(False), "prefix": prefix, "prefix-ac": F.when(p_ac != r_ac, r_ac > p_ac).otherwise(prefix)}[tiebreak]
    return F.when(twice < n, F.lit(True)).when(twice > n, F.lit(False)).otherwise(tie)


def stranded(rendered: DataFrame, tiebreak: str = "none") -> DataFrame:
    flip = rendered.withColumn("flip", strand_reversed(F.col("seq"), tiebreak))
    out = flip.withColumn("seq", F.when(F.col("flip"), seq.reverse_complement("seq")).otherwise(F.col("seq")))
    if "runs" in rendered.columns:
        out = out.withColumn("runs", F.when(F.col("flip"), reverse_runs(F.col("runs"))).otherwise(F.col("runs")))
    return out.drop("flip")


def sort_keys(mode: str) -> list[Column]:
    """Order of one of the output sorts, over seq and unitigs; ties fall back to path_id, the discovery order."""
    n, s = F.col("unitigs"), F.col("seq")
    size, p, ps, d = F.length(s), seq.prefix_key(s), seq.prefix_suffix_key(s), seq.ac_density(s)
    bucket = lambda b: F.floor(size / b).desc()
    table = {
        "none": [],
        "length": [size.desc(), n.asc()], "length-asc": [size.asc(), n.asc()],
        "unitigs": [n.desc(), size.desc()], "unitigs-asc": [n.asc(), size.asc()],
        "sequence-prefix": [p.asc(), size.asc()], "sequence-suffix": [seq.suffix_key(s).asc(), size.asc()],
        "prefix-length": [p.asc(), size.desc(), n.asc()],
        "length-bucket-prefix": [bucket(64), p.asc()], "length-bucket-prefix-fast": [bucket(64), p.asc()],
        "length-bucket-prefix-suffix": [bucket(64), ps.asc(), size.desc()],
        "length-bucket-prefix-ac": [bucket(64), p.asc(), d.desc()],
        "length-bucket-unitigs-prefix": [bucket(64), n.desc(), p.asc()],
        "length-bucket-unitigs-prefix-suffix": [bucket(64), n.desc(), ps.asc()],
        "length-unitigs-prefix": [size.desc(), n.desc(), p.asc()],
        "unitigs-length-prefix": [n.desc(), size.desc(), p.asc()],
        "ac-richness": [d.desc(), size.desc()],
    }
    for b in (16, 32, 128, 256):
        table[f"length-bucket{b}-prefix"] = [bucket(b), p.asc()]
    for b in (16, 32, 128):
        table[f"length-bucket{b}-unitigs-prefix"] = [bucket(b), n.desc(), p.asc()]
    if mode not in table:
        raise ValueError(f"output sort must be one of {sorted(table)}")
    return [*table[mode], F.col("path_id").asc()]


SORTS = ["none", "length", "length-asc", "unitigs", "unitigs-asc", "sequence-prefix", "sequence-suffix", "prefix-length", "length-bucket-prefix", "length-bucket-prefix-fast", *(f"length-bucket{b}-prefix" for b in (16, 32, 128, 256)), "length-bucket-prefix-suffix", "length-bucket-prefix-ac", "length-bucket-unitigs-prefix", *(f"length-bucket{b}-unitigs-prefix" for b in (16, 32, 128)), "length-bucket-unitigs-prefix-suffix", "length-unitigs-prefix", "unitigs-length-prefix", "ac-richness"]


def ranked(rendered: DataFrame, mode: str) -> DataFrame:
    return number_rows(rendered, sort_keys(mode))


def reform(records: DataFrame, k: int, mode: str = "simplitig", abundance: str | None = "mean", tiebreak: str = "none", sort: str = "none") -> DataFrame:
    """rank, header, seq of the reformed records (unitig_id, header, seq in)."""
    units = validate(records, k, abundance is not None)
    out = stranded(render(units, paths(units, k, mode), k), tiebreak)
    header = F.concat(F.lit("A "), abundance_tag(F.col("runs"), abundance)) if abundance else F.lit("A")
    return ranked(out, sort).select("rank", header.alias("header"), "seq", "unitigs", "kmers")


def summary(reformed: DataFrame) -> DataFrame:
    return reformed.agg(F.count("*").alias("records"), F.coalesce(F.sum("unitigs"), F.lit(0)).alias("unitigs"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long").alias("bases"))

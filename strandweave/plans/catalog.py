"""Queries of the k-mer operators over the test tables, and the same in SQL.

The tables hold no DNA: texts are mapped letter by letter (``seq.text_to_dna``). Documents are records, their source is the
dataset, ``benchmark`` is the index, ``conversations`` a second query; runs of bases in ``benchmark`` are the sequence records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq
from ..lineage import drop_on_exit, shared_path
from ..operators import compact, count, reform, subtract
from ..sources import kff
from ..sources.spread import spread
from ..streaming import presence, pruned

K, M, X = 21, 11, 2
UNIT_K = 7


def reads(spark: SparkSession, sf_dir: str, table: str = "documents", text: str = "text", **ids: str) -> DataFrame:
    ids = ids or {"record_idx": "doc_id", "dataset_id": "source"}
    t = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(t.select(*[F.col(v).alias(k) for k, v in ids.items()], F.col(text).alias("text"))).select(*ids, seq.text_to_dna("text").alias("seq"))


def index(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return count.distinct_kmers(reads(spark, sf_dir, "benchmark", record_idx="item_id"), k)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unitig_id, header with abundance runs, seq of the bases' runs in the test items."""
    f = seq.fragments(reads(spark, sf_dir, "benchmark", record_idx="item_id"), UNIT_K + 1, "record_idx")
    n = F.length("seq") - UNIT_K + 1
    half = F.floor(n / 2)
    value = F.pmod(F.col("record_idx"), F.lit(7))
    header = F.concat_ws(":", F.lit("u km:f"), (value + 0.5).cast("string"), half.cast("string"), (value + F.pmod(F.col("frag"), F.lit(2))).cast("double").cast("string"), (n - half).cast("string"))
    return f.select((F.col("record_idx") * 1000 + F.col("frag")).alias("unitig_id"), header.alias("header"), "seq")


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    return u.select(F.col("unitig_id").alias("path_id"), "seq", (F.pmod("unitig_id", F.lit(3)) + 1).alias("unitigs"))


def _sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = rendered(spark, sf_dir)
    out = None
    for mode in reform.SORTS:
        one = reform.ranked(table, mode).select(F.lit(mode).alias("mode"), "path_id", "rank")
        out = one if out is None else out.unionByName(one)
    return out


def _strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).select("unitig_id", *[reform.strand_reversed(F.col("seq"), t).alias(t.replace("-", "_")) for t in ("none", "prefix", "prefix-ac")])


def _abundance(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        u = reform.validate(units(spark, sf_dir), UNIT_K)
        return u.select("unitig_id", reform.abundance_tag(F.col("runs"), mode).alias("tag"))

    return run


def _reformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reform.reform(units(spark, sf_dir), UNIT_K, abundance="runs", tiebreak="prefix", sort="length")


def _conserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases of the reformed records and of what they are made of."""
    out = reform.reform(units(spark, sf_dir), UNIT_K, abundance=None)
    shared = (F.col("unitigs") - 1) * (UNIT_K - 1)
    return out.agg(F.sum(F.length("seq") + shared).cast("long").alias("bases"), F.sum("unitigs").alias("unitigs"))


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    return u.select("unitig_id", seq.prefix_key("seq").alias("prefix_key"), seq.suffix_key("seq").alias("suffix_key"), seq.prefix_suffix_key("seq").alias("both_key"))


def _presence_above_300(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's sources are counted first: where they are too few, no window is made."""
    r = reads(spark, sf_dir)
    return count.count_datasets(r, K, 300, n_datasets=r.agg(F.count_distinct("dataset_id")).first()[0])


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = index(spark, sf_dir)
    return k.select("kmer", seq.encode("kmer").alias("number")).select("kmer", "number", seq.decode("number", K).alias("back"))


def _kff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent k-mers written as KFF by many tasks, and read back."""
    path = shared_path(spark, "kff")
    kff.write(count.count_kmers(reads(spark, sf_dir), K, X), path, K, M, X)
    drop_on_exit(spark, path)
    return kff.read(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "count_kmers_gt_x": lambda s, d: count.count_kmers(reads(s, d), K, X),
    "count_kmers_superkmer": lambda s, d: count.count_by_superkmers(reads(s, d), K, M, X),
    "count_kmers_k31": lambda s, d: count.count_kmers(reads(s, d), 31, 1),
    "count_kmers_even_k": lambda s, d: count.count_kmers(reads(s, d), 4, 0),
    "kff_saturated_counts": lambda s, d: count.saturated(count.count_kmers(reads(s, d), K, X), X),
    "kff_round_trip": _kff,
    "dataset_presence_gt_x": lambda s, d: count.count_datasets(reads(s, d), K, X),
    "dataset_presence_threshold_too_high": _presence_above_300,
    "streaming_presence": lambda s, d: presence.presence_of_arrivals(s, f"{d}/documents.parque[t]", s.read.parquet(f"{d}/documents.parquet").schema, K, X, "source", "text"),
    "streaming_presence_pruned": lambda s, d: pruned.presence_in_arrivals(reads(s, d), K, X),
    "distinct_kmers": lambda s, d: index(s, d),
    "kmer_spectrum_histogram": lambda s, d: count.spectrum(count.count_kmers(reads(s, d), K)),
    "minimizer_window_counts": lambda s, d: count.minimizer_counts(reads(s, d), K, M),
    "minimizer_presence": lambda s, d: count.minimizer_presence(reads(s, d), K, M),
    "distinct_minimizers": lambda s, d: count.minimizer_counts(reads(s, d), K, M).agg(F.count("*").alias("minimizers")),
    "minimizer_prefiltered_counts": lambda s, d: count.prefiltered_counts(reads(s, d), K, M, X),
    "superkmer_runs": lambda s, d: count.superkmers(reads(s, d), K, M),
    "minimizer_scan": lambda s, d: count.scanned(reads(s, d), K, M),
    "canonical_windows": lambda s, d: seq.windows(seq.fragments(reads(s, d, "benchmark", record_idx="item_id"), K, "record_idx"), K, "record_idx", "frag", place=True),
    "reverse_complement": lambda s, d: seq.fragments(reads(s, d), K, "record_idx").select("record_idx", "frag", seq.reverse_complement("seq").alias("rc")),
    "encode_decode": _encoded,
    "subtract_distinct": lambda s, d: subtract.subtract_distinct(reads(s, d), index(s, d), K),
    "subtract_bag": lambda s, d: subtract.absent_windows(reads(s, d, "conversations", record_idx="conv_id"), index(s, d), K, "record_idx").groupBy("record_idx").agg(F.count("*").alias("absent")),
    "subtract_bag_probed": lambda s, d: subtract.probed_absent(reads(s, d, "conversations", record_idx="conv_id"), index(s, d), K, "record_idx").groupBy("record_idx").agg(F.count("*").alias("absent")),
    "subtract_bag_stats": lambda s, d: subtract.stats(reads(s, d), index(s, d), K),
    "subtract_stats_probed": lambda s, d: subtract.probed_stats(reads(s, d), index(s, d), K, "dataset_id"),
    "subtract_empty_index": lambda s, d: subtract.stats(reads(s, d), index(s, d).where("false"), K),
    "per_query_stats": lambda s, d: subtract.stats(reads(s, d), index(s, d), K, "dataset_id"),
    "regular_segments": lambda s, d: subtract.segments(reads(s, d), index(s, d), K),
    "regular_nucleotides": lambda s, d: subtract.nucleotides(subtract.segments(reads(s, d), index(s, d), K)),
    "shared_kmers": lambda s, d: count.distinct_kmers(reads(s, d), K).join(index(s, d), "kmer", "left_semi"),
    "simplitig_kmer_set": lambda s, d: compact.kmers_of(compact.simplitigs(index(s, d)), K),
    "unitig_kmer_set": lambda s, d: compact.kmers_of(compact.unitigs(index(s, d)), K),
    "simplitig_by_minimizer_kmer_set": lambda s, d: compact.kmers_of(compact.by_minimizer(index(s, d), M), K),
    "simplitigs": lambda s, d: compact.numbered(compact.simplitigs(index(s, d))).select("idx", "seq", "kmers"),
    "ac_density": lambda s, d: units(s, d).select("unitig_id", seq.ac_count("seq").alias("ac"), seq.ac_density("seq").alias("density")),
    "prefix_suffix_keys": _keys,
    "strand_choice": _strands,
    "overlap_candidates": lambda s, d: reform.candidates(units(s, d), UNIT_K).groupBy("key").agg(F.count("*").alias("pairs")),
    "abundance_mean": _abundance("mean"),
    "abundance_runs": _abundance("runs"),
    "output_sorts": _sorts,
    "reform_base_conservation": _conserved,
    "reformed_records": _reformed,
}


def _frags(table: str, ids: str, k: int, text: str = "text") -> str:
    return f"""(SELECT * FROM (SELECT {ids}, unnest(range(len(fs)))::INT AS frag, unnest(fs) AS seq FROM
  (SELECT *, regexp_extract_all(translate(coalesce({text}, ''), '{seq.LETTERS}', '{seq.BASES}'), '[ACGT]+') AS fs FROM {table})) WHERE length(seq) >= {k})"""


def _windows(table: str, ids: str, out: str, k: int) -> str:
    return f"""(SELECT {out}, frag, pos, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS kmer FROM
  (SELECT *, substr(seq, pos + 1, {k}) AS w FROM (SELECT *, unnest(range(length(seq) - {k} + 1))::INT AS pos FROM {_frags(table, ids, k)})))"""


_DOCS = _windows("documents", "doc_id AS record_idx, source AS dataset_id", "record_idx, dataset_id", K)
_ITEMS = _windows("benchmark", "item_id AS record_idx", "record_idx", K)
_INDEX = f"(SELECT DISTINCT kmer FROM {_ITEMS})"
_MIN = f"""(SELECT *, list_min(list_transform(range(1, {K - M + 2}), lambda i: least(substr(kmer, i, {M}), reverse(translate(substr(kmer, i, {M}), 'ACGT', 'TGCA'))))) AS minimizer FROM {_DOCS})"""
_MARK = f"(SELECT w.*, i.kmer IS NOT NULL AS hit FROM {_DOCS} w LEFT JOIN {_INDEX} i ON i.kmer = w.kmer)"
_STATS = "count(*) AS scanned, count(*) FILTER (WHERE hit) AS filtered, count(*) FILTER (WHERE NOT hit) AS not_filtered"
_SEGS = f"""(SELECT r.record_idx, r.frag, r.start, substr(f.seq, r.start + 1, r.last - r.start + {K}) AS seq FROM
  (SELECT record_idx, frag, min(pos) AS start, max(pos) AS last FROM (SELECT *, pos - row_number() OVER (PARTITION BY record_idx, frag ORDER BY pos) AS g FROM {_MARK} WHERE NOT hit) GROUP BY record_idx, frag, g) r
  JOIN {_frags("documents", "doc_id AS record_idx", K)} f ON f.record_idx = r.record_idx AND f.frag = r.frag)"""
_RUNS = f"""(SELECT record_idx, frag, min(pos) AS start, count(*) AS windows, min(minimizer) AS minimizer FROM (SELECT *, sum(new) OVER (PARTITION BY record_idx, frag ORDER BY pos) AS run FROM
  (SELECT *, CASE WHEN minimizer = lag(minimizer) OVER (PARTITION BY record_idx, frag ORDER BY pos) THEN 0 ELSE 1 END AS new FROM {_MIN})) GROUP BY record_idx, frag, run)"""
_UNITS = f"(SELECT record_idx * 1000 + frag AS unitig_id, record_idx, frag, seq, length(seq) - {UNIT_K} + 1 AS n FROM {_frags('benchmark', 'item_id AS record_idx', UNIT_K + 1)})"
_RC = "reverse(translate(seq, 'ACGT', 'TGCA'))"
_PRE = "rpad(substr({0}, 1, 32), 32, 'A')"
_SUF = "rpad(right({0}, 32), 32, 'A')"
_AC = "length({0}) - length(translate({0}, 'AC', ''))"
_V1, _V2, _L1 = "record_idx % 7 + 0.5", "record_idx % 7 + frag % 2", "n // 2"


def _order(mode: str) -> str:
    size, n = "length(seq)", "unitigs"
    p, s, d = _PRE.format("seq"), _SUF.format("seq"), f"({_AC.format('seq')}) * 1000000 // length(seq)"
    ps = f"substr({p}, 1, 16) || substr({s}, 1, 16)"
    fixed = {
        "none": [], "length": [size + " DESC", n], "length-asc": [size, n], "unitigs": [n + " DESC", size + " DESC"], "unitigs-asc": [n, size],
        "sequence-prefix": [p, size], "sequence-suffix": [s, size], "prefix-length": [p, size + " DESC", n],
        "length-unitigs-prefix": [size + " DESC", n + " DESC", p], "unitigs-length-prefix": [n + " DESC", size + " DESC", p], "ac-richness": [d + " DESC", size + " DESC"],
    }
    if mode in fixed:
        keys = fixed[mode]
    else:
        head, _, tail = mode.removeprefix("length-bucket").partition("-")
        keys = [f"length(seq) // {head or 64} DESC"] + {"prefix": [p], "prefix-fast": [p], "prefix-suffix": [ps, size + " DESC"], "prefix-ac": [p, d + " DESC"], "unitigs-prefix": [n + " DESC", p], "unitigs-prefix-suffix": [n + " DESC", ps]}[tail]
    return ", ".join([*keys, "path_id"])


_RENDERED = f"(SELECT unitig_id AS path_id, seq, unitig_id % 3 + 1 AS unitigs FROM {_UNITS})"
_LESS = f"2 * ({_AC.format('seq')}) < length(seq)"
_TIE = f"2 * ({_AC.format('seq')}) = length(seq)"
_PRE_LESS = f"{_PRE.format(_RC)} < {_PRE.format('seq')}"
_AC32 = f"({_AC.format('substr(' + _RC + ', 1, 32)')})", f"({_AC.format('substr(seq, 1, 32)')})"
_PRESENCE = f"SELECT kmer, count(DISTINCT dataset_id) AS n_datasets FROM {_DOCS} GROUP BY kmer HAVING count(DISTINCT dataset_id) > {X}"

ORACLE_SQL: dict[str, str] = {
    "count_kmers_gt_x": f"SELECT kmer, count(*) AS count FROM {_DOCS} GROUP BY kmer HAVING count(*) > {X}",
    "count_kmers_superkmer": f"SELECT kmer, count(*) AS count FROM {_DOCS} GROUP BY kmer HAVING count(*) > {X}",
    "count_kmers_k31": f"SELECT kmer, count(*) AS count FROM {_windows('documents', 'doc_id', 'doc_id', 31)} GROUP BY kmer HAVING count(*) > 1",
    "count_kmers_even_k": f"SELECT kmer, count(*) AS count FROM {_windows('documents', 'doc_id', 'doc_id', 4)} GROUP BY kmer",
    "kff_saturated_counts": f"SELECT kmer, least(count(*), {X + 1}) AS count FROM {_DOCS} GROUP BY kmer HAVING count(*) > {X}",
    "kff_round_trip": f"SELECT kmer, least(count(*), {X + 1}) AS count FROM {_DOCS} GROUP BY kmer HAVING count(*) > {X}",
    "dataset_presence_gt_x": _PRESENCE,
    "dataset_presence_threshold_too_high": _PRESENCE.replace(f"> {X}", "> 300"),
    "streaming_presence": _PRESENCE,
    "streaming_presence_pruned": _PRESENCE,
    "distinct_kmers": f"SELECT kmer FROM {_INDEX}",
    "kmer_spectrum_histogram": f"SELECT count, count(*) AS kmers FROM (SELECT count(*) AS count FROM {_DOCS} GROUP BY kmer) GROUP BY count",
    "minimizer_window_counts": f"SELECT minimizer, count(*) AS windows FROM {_MIN} GROUP BY minimizer",
    "minimizer_presence": f"SELECT minimizer, count(DISTINCT dataset_id) AS n_datasets FROM {_MIN} GROUP BY minimizer",
    "distinct_minimizers": f"SELECT count(DISTINCT minimizer) AS minimizers FROM {_MIN}",
    "minimizer_prefiltered_counts": f"SELECT kmer, count(*) AS count FROM {_DOCS} GROUP BY kmer HAVING count(*) > {X}",
    "superkmer_runs": f"SELECT * FROM {_RUNS}",
    "minimizer_scan": f"SELECT * FROM (SELECT count(*) AS fragments, sum(length(seq))::BIGINT AS bases FROM {_frags('documents', 'doc_id', K)}), (SELECT count(*) AS runs, sum(windows)::BIGINT AS windows FROM {_RUNS})",
    "canonical_windows": f"SELECT record_idx, frag, pos, kmer FROM {_ITEMS}",
    "reverse_complement": f"SELECT record_idx, frag, {_RC} AS rc FROM {_frags('documents', 'doc_id AS record_idx', K)}",
    "encode_decode": f"SELECT kmer, list_sum(list_transform(range(1, {K + 1}), lambda i: (instr('ACGT', substr(kmer, i, 1)) - 1) * (1::BIGINT << (2 * ({K} - i)))))::BIGINT::VARCHAR AS number, kmer AS back FROM {_INDEX}",
    "subtract_distinct": f"SELECT DISTINCT kmer FROM {_DOCS} EXCEPT SELECT kmer FROM {_INDEX}",
    "subtract_bag": f"SELECT record_idx, count(*) AS absent FROM {_windows('conversations', 'conv_id AS record_idx', 'record_idx', K)} WHERE kmer NOT IN (SELECT kmer FROM {_INDEX}) GROUP BY record_idx",
    "subtract_bag_probed": f"SELECT record_idx, count(*) AS absent FROM {_windows('conversations', 'conv_id AS record_idx', 'record_idx', K)} WHERE kmer NOT IN (SELECT kmer FROM {_INDEX}) GROUP BY record_idx",
    "subtract_bag_stats": f"SELECT {_STATS} FROM {_MARK}",
    "subtract_empty_index": f"SELECT count(*) AS scanned, 0::BIGINT AS filtered, count(*) AS not_filtered FROM {_DOCS}",
    "per_query_stats": f"SELECT dataset_id, {_STATS} FROM {_MARK} GROUP BY dataset_id",
    "subtract_stats_probed": f"SELECT dataset_id, {_STATS} FROM {_MARK} GROUP BY dataset_id",
    "regular_segments": f"SELECT * FROM {_SEGS}",
    "regular_nucleotides": f"SELECT coalesce(sum(length(seq)), 0)::BIGINT AS nucleotides FROM {_SEGS}",
    "shared_kmers": f"SELECT DISTINCT kmer FROM {_DOCS} WHERE kmer IN (SELECT kmer FROM {_INDEX})",
    "simplitig_kmer_set": f"SELECT kmer FROM {_INDEX}",
    "unitig_kmer_set": f"SELECT kmer FROM {_INDEX}",
    "simplitig_by_minimizer_kmer_set": f"SELECT kmer FROM {_INDEX}",
    "ac_density": f"SELECT unitig_id, ({_AC.format('seq')})::BIGINT AS ac, (({_AC.format('seq')}) * 1000000 // length(seq))::BIGINT AS density FROM {_UNITS}",
    "prefix_suffix_keys": f"SELECT unitig_id, {_PRE.format('seq')} AS prefix_key, {_SUF.format('seq')} AS suffix_key, substr({_PRE.format('seq')}, 1, 16) || substr({_SUF.format('seq')}, 1, 16) AS both_key FROM {_UNITS}",
    "strand_choice": f"""SELECT unitig_id, {_LESS} AS none, {_LESS} OR ({_TIE} AND {_PRE_LESS}) AS prefix,
  {_LESS} OR ({_TIE} AND CASE WHEN {_AC32[0]} <> {_AC32[1]} THEN {_AC32[0]} > {_AC32[1]} ELSE {_PRE_LESS} END) AS prefix_ac FROM {_UNITS}""",
    "overlap_candidates": f"""WITH u AS (SELECT unitig_id, seq, {_RC} AS rc FROM {_UNITS}),
s AS (SELECT substr(seq, 1, {UNIT_K - 1}) AS key, unitig_id FROM u UNION ALL SELECT substr(rc, 1, {UNIT_K - 1}), unitig_id FROM u),
e AS (SELECT right(seq, {UNIT_K - 1}) AS key, unitig_id FROM u UNION ALL SELECT right(rc, {UNIT_K - 1}), unitig_id FROM u)
SELECT e.key, count(*) AS pairs FROM e JOIN s ON s.key = e.key AND s.unitig_id <> e.unitig_id GROUP BY e.key""",
    "abundance_mean": f"SELECT unitig_id, 'km:f:' || round((({_V1}) * ({_L1}) + ({_V2}) * (n - {_L1})) / n)::BIGINT AS tag FROM {_UNITS}",
    "abundance_runs": f"""SELECT unitig_id, 'km:f:' || CASE WHEN a = b THEN a::VARCHAR ELSE a || ':' || l1 || ':' || b || ':' || l2 END AS tag FROM
  (SELECT unitig_id, round({_V1})::BIGINT AS a, round({_V2})::BIGINT AS b, {_L1} AS l1, n - {_L1} AS l2 FROM {_UNITS})""",
    "output_sorts": " UNION ALL ".join(f"SELECT '{m}' AS mode, path_id, row_number() OVER (ORDER BY {_order(m)}) AS rank FROM {_RENDERED}" for m in reform.SORTS),
    "reform_base_conservation": f"SELECT sum(length(seq))::BIGINT AS bases, count(*) AS unitigs FROM {_UNITS}",
}

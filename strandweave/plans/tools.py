"""The four tools as functions over DataFrames and files: counter, subtractor, pipeline, reformer; and their command line."""

from __future__ import annotations

import argparse
import os
import resource
import sys
import time
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import compact, count, reform, subtract
from ..sources import fastx, kff, sinks


# Names in lines of statistics, warnings and outputs; a line's parts are separated by tabs.
STAT, WARN, OUTPUT = "STAT", "WARN", "OUTPUT"
SCANNED, FILTERED, NOT_FILTERED = "query_kmers_scanned", "query_kmers_filtered_by_zi", "query_kmers_not_filtered_by_zi"
NUCLEOTIDES, UNIQUE = "query_regular_output_nucleotides", "query_unique_kmers_not_filtered_by_zi"
# Short names of phases.
PHASES = {"index_kmer_counting": "kmer count", "kmer_counting": "kmer count", "query_subtraction": "query subtraction", "query_subtraction_no_output": "query scan no output", "regular_output": "regular output", "simplitig_output": "simplitig output", "reform_output": "reform output", "total": "total"}


def say(*parts: object) -> None:
    print(*parts, sep="\t", file=sys.stderr)


def stat(name: str, value: int) -> str:
    return f"{STAT}\t{name}\t{value:,}"


def phase_name(name: str) -> str:
    """``2_kmer_counting`` is ``phase2 kmer count``; a name that has no short one stays."""
    number, _, rest = name.partition("_")
    if rest and number[:1].isdigit() and number.isalnum():
        return f"phase{number} {PHASES.get(rest, rest)}"
    return PHASES.get(name, name)


@contextmanager
def phase(name: str):
    """Tells a phase's seconds, the driver's CPU seconds and its largest memory."""
    wall, cpu = time.time(), time.process_time()
    yield
    mb = -(-resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
    say(f"{phase_name(name)} {time.time() - wall:.3f}s CPU {time.process_time() - cpu:.3f}s {mb}MB RAM")


@dataclass
class QueryStats:
    """Window occurrences of a query; nucleotides only where segments are made, unique ones only for simplitigs."""

    scanned: int = 0
    filtered: int = 0
    not_filtered: int = 0
    nucleotides: int | None = None
    unique: int | None = None

    def lines(self) -> list[str]:
        values = {SCANNED: self.scanned, FILTERED: self.filtered, NOT_FILTERED: self.not_filtered, NUCLEOTIDES: self.nucleotides, UNIQUE: self.unique}
        return [stat(k, v) for k, v in values.items() if v is not None]


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of the files that are sequences; the others are told."""
    for path in fastx.invalid(spark, paths):
        say(WARN, "skipped_invalid_fastx_input", "path", path, "error", "Invalid record start")
    return fastx.read_fastx(spark, paths, "skip")


#: Compaction: walks in connected components, or in groups of k-mers by their minimizer where a component may be too large for a task.
COMPACTIONS = ("components", "minimizer")


def compacted(kmers: DataFrame, m: int = 1, partitions: int = 1024, by: str = "components") -> DataFrame:
    if by not in COMPACTIONS:
        raise ValueError(f"compaction must be one of {COMPACTIONS}")
    return compact.simplitigs(kmers) if by == "components" else compact.by_minimizer(kmers, m, partitions)


def counter(spark: SparkSession, inputs: list[str], k: int, output: str, m: int = 1, threshold: int = 1, fmt: str = "fasta", fofn: bool = False, partitions: int = 1024, compaction: str = "components", parts: bool = False) -> int:
    """Frequent k-mers of files as simplitigs, with their counts (``counts``) or as KFF; with ``fofn`` k-mers of more than
    ``threshold`` datasets."""
    count.CounterConfig(k, m, threshold, partitions).check(fofn)
    if fofn:
        paths = fastx.expand_fofns(inputs)
        reads = fastx.read_datasets(spark, paths, "skip")
        found = count.count_datasets(reads, k, threshold, n_datasets=len(paths)).withColumnRenamed("n_datasets", "count")
    else:
        found = count.count_kmers(read(spark, inputs), k, threshold)
    with phase("kmer_counting_and_output"):
        if fmt == "kff":
            write = kff.write if parts else sinks.write_kff
            return write(found, output, k, m, threshold, 4 if fofn else None, not fofn)
        if fmt == "counts":
            return sinks.write_counts(found, output, parts)
        return sinks.write_simplitigs(compacted(found.select("kmer"), m, partitions, compaction), output, k, parts=parts)


def subtractor(spark: SparkSession, index: str, inputs: list[str], k: int, output: str, m: int | None = None, fofn: bool = False, kmers: str = "simplitig", compaction: str = "components", parts: bool = False) -> int:
    """What the inputs have and the index lacks: as simplitigs, as ``distinct`` k-mers, or ``all`` of their occurrences."""
    m = subtract.check_k(k, m)
    reads = fastx.read_fastx(spark, fastx.expand_fofns(inputs) if fofn else inputs)
    known = compact.kmers_of(fastx.read_fastx(spark, [index]), k)
    if kmers == "all":
        return sinks.write_kmers(subtract.absent_windows(reads, known, k), output, parts)
    left = subtract.subtract_distinct(reads, known, k)
    if kmers == "distinct":
        return sinks.write_kmers(left, output, parts)
    return sinks.write_simplitigs(compacted(left, m, by=compaction), output, k, parts=parts)


def with_ids(records: DataFrame) -> DataFrame:
    """unitig_id: number of the record in its file order."""
    return records.withColumn("unitig_id", F.col("record_idx"))


def reformer(spark: SparkSession, path: str, k: int, output: str, mode: str = "simplitig", abundance: str | None = "mean", tiebreak: str = "none", sort: str = "none", zstd_workers: int = 0, parts: bool = False) -> int:
    records = with_ids(fastx.read_fastx(spark, [path]))
    if not records.head(1):
        raise ValueError("no records")
    made = reform.reform(records, k, mode, abundance, tiebreak, sort)
    with phase("reform_output"):
        n = sinks.write_reformed(made, output, zstd_workers, parts)
    for name, value in zip(("output_records", "output_unitigs", "output_bases"), reform.summary(made).first()):
        say(stat(name, value))
    return n


def pipeline(spark: SparkSession, index: list[str], queries: list[str], k: int, m: int | None = None, threshold: int = 1, output: str | None = None, suffix: str = "filtered", mode: str = "simplitig", reform_output: bool = False, abundance: str | None = None, index_fofn: bool = False, query_fofn: bool = False, partitions: int = 1024, compaction: str = "components", parts: bool = False) -> list[QueryStats]:
    """Index k-mers, then each query without them: as simplitigs, as segments (``regular``) or as counters only (``no-output``)."""
    m = subtract.check_k(k, m)
    count.CounterConfig(k, m, threshold, partitions).check(index_fofn)
    if mode not in ("simplitig", "regular", "no-output"):
        raise ValueError("unknown output mode")
    if mode == "no-output" and (output or reform_output) or abundance and (not reform_output or mode != "regular"):
        raise ValueError("these output options exclude each other")
    if index_fofn:
        paths = fastx.expand_fofns(index)
        if threshold >= len(paths):
            say(WARN, "index_fofn_threshold_excludes_all_kmers", "index_inputs", len(paths), "threshold", threshold)
        found = count.count_datasets(fastx.read_datasets(spark, paths, "skip"), k, threshold, n_datasets=len(paths)).select("kmer")
    else:
        found = count.count_kmers(read(spark, index), k, threshold).select("kmer")
    with phase("1_index_kmer_counting"):
        found = subtract.build(found)
    silent = output == os.devnull or mode == "no-output"
    jobs = [[q] for q in fastx.expand_fofns(queries)] if query_fofn and not silent else [fastx.expand_fofns(queries) if query_fofn else queries]
    outs = [None] * len(jobs) if silent else sinks.plan_outputs([j[0] for j in jobs], output, suffix) if query_fofn or output is None else [output]
    done = []
    for job, out in zip(jobs, outs):
        reads = read(spark, job)
        if out and any(map(fastx.codec_of, job)):
            reads = cut(reads, "scan")  # it is read several times; decompressed and parsed once
        stats = QueryStats(*subtract.stats(reads, found, k).first())
        if out and mode == "regular":
            ids = ["path", "record_idx"]
            keyed = reads.withColumn("rec", F.struct(*ids))
            segs = subtract.segments(keyed.select("rec", "seq"), found, k, "rec").join(keyed.select("rec", "header"), "rec").select("rec.*", "frag", "start", "header", "seq")
            stats.nucleotides = subtract.nucleotides(segs).first()[0]
            if reform_output:
                order = [F.col(c) for c in ("path", "record_idx", "frag", "start")]
                from ..operators.rank import number_rows

                sinks.write_reformed(reform.reform(number_rows(segs, order, "unitig_id"), k, "simplitig", abundance), out, parts=parts)
            else:
                sinks.write_segments(segs, out, parts)
        elif out:
            left = cut(subtract.subtract_distinct(reads, found, k), "left")
            stats.unique = left.count()
            made = compacted(left, m, partitions, compaction)
            if reform_output:
                units = compact.numbered(made).select(F.col("idx").alias("unitig_id"), F.lit("").alias("header"), "seq")
                sinks.write_reformed(reform.reform(units, k, "simplitig", None), out, parts=parts)
            else:
                sinks.write_simplitigs(made, out, k, parts=parts)
        if out:
            say(OUTPUT, job[0], out)
        done.append(stats)
    return done


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandweave")
    tools = p.add_subparsers(dest="tool", required=True)

    def tool(name: str, *more):
        t = tools.add_parser(name)
        t.add_argument("-k", type=int, required=True)
        t.add_argument("-t", "--threads", type=int)
        t.add_argument("-o", "--output")
        t.add_argument("--parts", action="store_true", help="outputs are folders of parts that the tasks write")
        for args, kw in more:
            t.add_argument(*args, **kw)

    x = (("-x", "--threshold"), {"type": int, "default": 1})
    m = (("-m",), {"type": int})
    ram, parts = (("--ram-limit-gib",), {"type": int, "default": 8}), (("--partition-count",), {"type": int, "default": 1024})
    walks = (("--compaction",), {"choices": COMPACTIONS, "default": "components"})
    inputs, fofn = (("-i", "--input"), {"nargs": "+", "default": []}), (("--fofn",), {"nargs": "+", "default": []})
    tool("count", inputs, fofn, m, x, parts, walks, (("--format",), {"choices": ["fasta", "kff", "counts"], "default": "fasta"}))
    tool("subtract", inputs, fofn, m, ram, walks, (("--index",), {"required": True}), (("--output-kmers",), {"choices": ["simplitig", "distinct", "all"], "default": "simplitig"}))
    sides = [((f"--{s}-{kind}",), {"nargs": "+", "default": []}) for s in ("index", "query") for kind in ("input", "fofn")]
    tool("pipeline", *sides, m, x, parts, ram, walks, (("--output-suffix",), {"default": "filtered"}), (("--output-mode",), {"choices": ["simplitig", "regular", "no-output"], "default": "simplitig"}), (("--reform-output",), {"action": "store_true"}), (("--reform-abundance-mode",), {"choices": ["mean", "runs"]}))
    tool("reform", (("-i", "--input"), {"required": True}), (("--zstd-workers",), {"type": int, "default": 0}), (("--output-mode",), {"choices": reform.MODES, "default": "simplitig"}), (("--sequence-store",), {"choices": ["disk", "memory"], "default": "disk"}), (("--output-sort",), {"choices": reform.SORTS, "default": "none"}), (("--strand-tiebreak",), {"choices": ["none", "prefix", "prefix-ac"], "default": "none"}), (("--abundance-mode",), {"choices": ["mean", "runs"], "default": "mean"}), (("--no-abundance",), {"action": "store_true"}))
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.threads is not None and a.threads < 1:
        raise SystemExit("--threads must be positive")
    builder = SparkSession.builder.appName("strandweave")
    if a.threads:  # asked for this machine's threads; else the master that the session is submitted to, or all of this machine
        builder = builder.master(f"local[{a.threads}]")
    spark = builder.getOrCreate()
    if a.tool == "count":
        counter(spark, a.fofn or a.input, a.k, a.output, 1 if a.m is None else a.m, a.threshold, a.format, bool(a.fofn), a.partition_count, a.compaction, a.parts)
    elif a.tool == "subtract":
        subtractor(spark, a.index, a.fofn or a.input, a.k, a.output, a.m, bool(a.fofn), a.output_kmers, a.compaction, a.parts)
    elif a.tool == "reform":
        reformer(spark, a.input, a.k, a.output, a.output_mode, None if a.no_abundance else a.abundance_mode, a.strand_tiebreak, a.output_sort, sinks.zstd_workers(a.zstd_workers, a.threads), a.parts)
    else:
        for s in pipeline(spark, a.index_fofn or a.index_input, a.query_fofn or a.query_input, a.k, a.m, a.threshold, a.output, a.output_suffix, a.output_mode, a.reform_output, a.reform_abundance_mode, bool(a.index_fofn), bool(a.query_fofn), a.partition_count, a.compaction, a.parts):
            print("\n".join(s.lines()))


if __name__ == "__main__":
    main()

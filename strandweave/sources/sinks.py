"""Outputs in record order: FASTA in several codecs, and the KFF binary format; and names of output files.

A FASTA output is one file, to which rows come through ``toLocalIterator``, a partition at a time; or, with ``parts``, a folder of parts that
the tasks write themselves, for outputs of any size: in name order they are the same file, also where they are gzip.
"""

from __future__ import annotations

import gzip
import lzma
import os
import re
import shutil
import struct
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.rank import number_rows
from .fastx import codec_of

# Line width and labels of the FASTA formats.
WIDTH = 80
SIMPLITIG_LABEL, KMER_LABEL = "MC_simplitig", "MC_kmer"


@contextmanager
def output(path: str, zstd_workers: int = 0):
    codec = codec_of(path)
    if codec == "gzip":
        with gzip.open(path, "wb", compresslevel=1) as f:
            yield f
    elif codec == "xz":
        with lzma.open(path, "wb", preset=6) as f:
            yield f
    elif codec == "zstd":
        import zstandard

        with open(path, "wb") as raw, zstandard.ZstdCompressor(level=1, threads=zstd_workers).stream_writer(raw) as f:
            yield f
    else:
        with open(path, "wb") as f:
            yield f


def wrapped(seq: str, width: int | None = WIDTH) -> str:
    return seq if not width else "\n".join(seq[i : i + width] for i in range(0, len(seq), width))


def write_records(rows: Iterable[tuple[str, str]], path: str, width: int | None = WIDTH, zstd_workers: int = 0) -> int:
    n = 0
    with output(path, zstd_workers) as f:
        for header, seq in rows:
            f.write(f">{header}\n{wrapped(seq, width)}\n".encode())
            n += 1
    return n


def write_parts(records: DataFrame, path: str, width: int | None = WIDTH, mode: str = "error") -> int:
    """A folder of parts of records (header, seq, and columns of their order before them), whose bytes one after the other are the single file's.

    One range sort; sequences are wrapped and written where they are. gzip by the path's extension, else plain."""
    codec = codec_of(path)
    if codec not in (None, "gzip"):
        raise ValueError("parts are plain or gzip")
    text = F.col("seq")
    if width:
        text = F.regexp_replace(text, f"(.{{{width}}})(?=.)", "$1\n")
    seen = Observation(path)
    order = [c for c in records.columns if c not in ("header", "seq")]
    lines = records.orderBy(*order).observe(seen, F.count("*").alias("rows")).select(F.concat(F.lit(">"), "header", F.lit("\n"), text).alias("value"))
    lines.write.mode(mode).option("compression", codec or "none").text(path)
    return seen.get.get("rows", 0)


def _numbered(df: DataFrame, order: str, label: str, seq: str, start: int = 0, more: Column | None = None) -> DataFrame:
    """n, header, seq: numbers follow the order."""
    name = F.concat(F.lit(label + "_"), F.col("n"), *([] if more is None else [F.lit(" "), more]))
    return number_rows(df, [F.col(order)], "n", start).select("n", name.alias("header"), F.col(seq).alias("seq"))


def write_simplitigs(simplitigs: DataFrame, path: str, k: int, start: int = 0, label: str = SIMPLITIG_LABEL, parts: bool = False) -> int:
    if parts:
        return write_parts(_numbered(simplitigs, "seed", label, "seq", start, F.concat(F.lit("kmers="), F.length("seq") - k + 1)), path)
    rows = simplitigs.orderBy("seed").select("seq").toLocalIterator()
    return write_records(((f"{label}_{i} kmers={len(r['seq']) - k + 1}", r["seq"]) for i, r in enumerate(rows, start + 1)), path)


def write_counts(counts: DataFrame, path: str, parts: bool = False) -> int:
    if parts:
        return write_parts(_numbered(counts, "kmer", KMER_LABEL, "kmer", more=F.concat(F.lit("count="), F.col("count"))), path)
    rows = counts.orderBy("kmer").toLocalIterator()
    return write_records(((f"{KMER_LABEL}_{i} count={r['count']}", r["kmer"]) for i, r in enumerate(rows, 1)), path)


def write_kmers(kmers: DataFrame, path: str, parts: bool = False) -> int:
    """A record for each row (kmer), in order."""
    if parts:
        return write_parts(_numbered(kmers, "kmer", KMER_LABEL, "kmer"), path)
    rows = kmers.orderBy("kmer").toLocalIterator()
    return write_records(((f"{KMER_LABEL}_{i}", r["kmer"]) for i, r in enumerate(rows, 1)), path)


def zstd_workers(asked: int, threads: int | None) -> int:
    """Workers of the zstd encoder: as asked, else one for each thread, 16 at most."""
    return asked if asked > 0 else min(threads, 16) if threads and threads > 1 else 0


def copy(source: str, path: str, workers: int = 0) -> None:
    """An existing file through the codec of the output's extension."""
    with open(source, "rb") as f, output(path, workers) as out:
        shutil.copyfileobj(f, out, 1 << 20)


def write_segments(segments: DataFrame, path: str, parts: bool = False) -> int:
    """Records (header, seq) in order of their place columns."""
    order = [c for c in ("path", "record_idx", "frag", "start") if c in segments.columns]
    if parts:
        return write_parts(segments.select(*order, "header", "seq"), path)
    return write_records(((r["header"], r["seq"]) for r in segments.orderBy(*order).toLocalIterator()), path)


def write_reformed(reformed: DataFrame, path: str, zstd_workers: int = 0, parts: bool = False) -> int:
    if parts:
        return write_parts(reformed.select("rank", "header", "seq"), path, None)
    return write_records(((r["header"], r["seq"]) for r in reformed.orderBy("rank").toLocalIterator()), path, None, zstd_workers)


# Fixed values of the KFF 1.0 layout: marker, version, base codes, unique and canonical flags.
KFF_MARK, KFF_HEAD = b"KFF", bytes([1, 0, 0x1B, 1, 1])


def pack_bases(kmer: str) -> bytes:
    """Right-aligned big-endian 2-bit bases."""
    return int(kmer.translate(str.maketrans("ACGT", "0123")), 4).to_bytes(-(-len(kmer) // 4), "big")


def write_kff(counts: DataFrame, path: str, k: int, m: int = 1, threshold: int = 1, data_size: int | None = None, ordered: bool = True, producer: str = "strandweave") -> int:
    """Counted k-mers. data_size: bytes of a count; by default 1 for k up to 32, where every count is threshold + 1 as a
    counter that stops there has it, and 8 above."""
    size = data_size or (1 if k <= 32 else 8)
    total = counts.count()
    text = f"producer={producer}\nk={k}\nm={m}\nthreshold={threshold}\nfilter=count>threshold\ncanonical=1\n".encode()
    with output(path) as f:
        f.write(KFF_MARK + KFF_HEAD + struct.pack(">I", len(text)) + text)
        values = {"k": k, "max": 1, "data_size": size, "ordered": int(ordered), "m": m, "threshold": threshold}
        f.write(b"v" + struct.pack(">Q", len(values)) + b"".join(n.encode() + b"\0" + struct.pack(">Q", v) for n, v in values.items()))
        f.write(b"r" + struct.pack(">Q", total))
        for r in counts.orderBy("kmer").select("kmer", F.col(counts.columns[1]).alias("n")).toLocalIterator():
            n = threshold + 1 if data_size is None and size == 1 else r["n"]
            f.write(pack_bases(r["kmer"]) + int(n).to_bytes(size, "big"))
        f.write(KFF_MARK)
    return total


def split_name(name: str) -> tuple[str, str, str]:
    """Stem, sequence extension, compression extension."""
    comp = re.search(r"(?i)(?<=.)\.(?:zstd|gzip|zst|gz|xz)$", name)
    rest = name[: comp.start()] if comp else name
    ext = re.search(r"(?i)(?<=.)\.(?:fasta|fastq|fna|fa|fq)$", rest)
    return rest[: ext.start()] if ext else rest, ext[0] if ext else "", comp[0] if comp else ""


def suffixed(name: str, suffix: str) -> str:
    suffix = suffix.strip()
    suffix = suffix[1:] if suffix.startswith(".") else suffix
    if not suffix or "/" in suffix or os.sep in suffix:
        raise ValueError("the output suffix must be a name")
    stem, ext, comp = split_name(name)
    return f"{stem}.{suffix}{ext}{comp}"


def plan_outputs(queries: list[str], output_dir: str | None, suffix: str = "filtered") -> list[str]:
    """An output path for each query file."""
    if output_dir is not None and os.path.exists(output_dir) and not os.path.isdir(output_dir):
        raise ValueError("the output exists and is no directory")
    out = [os.path.join(output_dir if output_dir is not None else os.path.dirname(q), suffixed(os.path.basename(q), suffix)) for q in queries]
    if len(set(out)) != len(out):
        raise ValueError("two inputs have one output")
    if {os.path.abspath(p) for p in out} & {os.path.abspath(q) for q in queries}:
        raise ValueError("an output is an input")
    return out

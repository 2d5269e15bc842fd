"""Secret scans: fixed patterns, and tokens that a character Markov model of secrets explains better than one of
ordinary identifiers.

The models are first-order chains over ASCII characters with end marks. They are fitted on labelled samples: values that the
fixed patterns find (secrets) and the other tokens, and identifiers made of the words (ordinary), of about ``sample`` documents,
chosen by a hash of doc_id, besides generated strings that make the random class independent of what a corpus holds. Transition counts are
summed by Spark; at most 2 x 96^2 sums reach the driver. A scan is one pass over whole texts without a shuffle.

A token without a digit or without a letter is more often a word or a number, so it needs ``STRONG`` instead of the usual
thresholds, and separators in at most a quarter of it and five different characters (rules,
headings and fillers are not scored).

Defined cases: null text is empty; equal rows give equal results; without documents to learn from, the generated strings and a
short list of identifiers are the sample; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of at least 16 are the maximal runs that are long enough, as `[0-9a-f]+` takes whole runs.
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Identifiers that hold digits, as a start for the ordinary class.
ORDINARY = "item_count_1 user_name_02 http2_server_config utf8_string_reader test_case_number_12 version_2_release_notes page1_section2_title chapter-12-section-3 2024-01-01T00-00-00 base64_encode_string sha256_checksum_file".split()
SIZE = 96
#: Least mean and total of a token without a digit or without a letter, where those asked for aren't higher.
STRONG = (1.0, 20.0)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    low = text.lower()
    out = []
    if any(k in low for k in KEYS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def codes(token: str) -> np.ndarray:
    """Characters as 1..95, other ones and both ends as 0."""
    x = np.frombuffer(token.encode("ascii", "replace"), np.uint8).astype(np.int64) - 31
    return np.concatenate([[0], np.where((x > 0) & (x < SIZE), x, 0), [0]])


def transitions(tokens: list[str]) -> np.ndarray:
    out = np.zeros(SIZE * SIZE, np.int64)
    if tokens:
        x = np.concatenate([codes(t) for t in tokens])
        out += np.bincount(x[:-1] * SIZE + x[1:], minlength=SIZE * SIZE)
    return out.reshape(SIZE, SIZE)


def generated(n: int = 3000, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    sets = [digits + "abcdef", upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "-_", upper + digits, lower + digits]
    return ["".join(rng.choices(sets[i % len(sets)], k=rng.randint(16, 64))) for i in range(n)]


#: Ways in which words are joined to an identifier.
STYLES = ("_".join, "-".join, "/".join, lambda w: w[0].lower() + "".join(x.title() for x in w[1:]), lambda w: "_".join(w).upper(), lambda w: "".join(x.title() for x in w), lambda w: "_".join(w) + "_" + str(len(w[0])))


def identifiers(text: str) -> list[str]:
    """Identifiers made of a text's words, four in a row, each in another way."""
    words = re.findall(r"[A-Za-z]{2,12}", text)
    return [STYLES[i // 4 % len(STYLES)](words[i : i + 4]) for i in range(0, len(words) - 3, 4)]


def fit(docs: DataFrame, sample: int = 2000) -> np.ndarray:
    """Log-likelihood ratio of each transition, secrets against ordinary tokens. sample: documents to learn from, about."""
    n = docs.count()
    hashed = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(n, 1)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SIZE, SIZE), np.int64)
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py() or ""
                spans = base_spans(text)
                sums[1] += transitions([text[a:b] if k else ASSIGN.match(text, a, b)[2] for a, k, b in spans])
                sums[0] += transitions([m.group() for m in re.finditer(r"[A-Za-z0-9+/_=-]{6,}", text) if not any(a < m.end() and m.start() < b for a, _, b in spans)])
                sums[0] += transitions(identifiers(text))
        at = np.flatnonzero(sums.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums.ravel()[at])], ["at", "n"])

    got = map_arrow(docs.where(hashed).select("text"), count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(2 * SIZE * SIZE)
    for r in got:
        sums[r["at"]] = r["n"]
    sums = sums.reshape(2, SIZE, SIZE)
    made = transitions(generated())
    # the generated strings count as much as the found ones do, at least
    sums[1] = sums[1] * min(1.0, made.sum() / max(sums[1].sum(), 1)) + made
    sums[0] += transitions(ORDINARY) * 10
    p = (sums + 0.5) / (sums + 0.5).sum(axis=2, keepdims=True)
    return np.log(p[1] / p[0])


def markov_spans(text: str, ratio: np.ndarray, base: list[tuple[int, int, int]], mean: float, total: float) -> list[tuple[int, int, int]]:
    out = []
    for m in TOKEN.finditer(text):
        t = m.group()
        plain = not any(c.isdigit() for c in t) or not any(c.isalpha() for c in t)
        if plain and (4 * sum(c.isalnum() for c in t) < 3 * len(t) or len(set(t)) < 5):
            continue
        if any(a < m.end() and m.start() < b for a, _, b in base):
            continue
        x = codes(t)
        score = float(ratio[x[:-1], x[1:]].sum())
        least = (max(mean, STRONG[0]), max(total, STRONG[1])) if plain else (mean, total)
        if score >= least[1] and score / (len(x) - 1) >= least[0]:
            out.append((m.start(), 3, m.end()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"


def secrets(docs: DataFrame, ratio: np.ndarray | None = None, mean: float = 0.4, total: float = 12.0) -> DataFrame:
    """Spans in code points. mean, total: least log-likelihood ratio per character and of a token."""
    ratio = fit(docs) if ratio is None else ratio

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                more = markov_spans(text, ratio, base, mean, total)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, types)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, FOUND)

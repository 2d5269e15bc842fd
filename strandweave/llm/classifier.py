"""Quality classifier: regularised quadratic discriminant analysis over transformed statistics of a document.

One pass over whole texts makes ``FEATURES`` numbers a document (smoothed log odds of kinds of characters, words and repeats, so that
they hold for a text of one word and for one of a million) as whole numbers of 1 / ``UNIT``; they are written, and everything after
reads that narrow table. Learning needs only counts, sums and sums of products of each class, which Spark adds up exactly over all
labelled rows that aren't held out, in any order, so reruns agree to the bit; no sample is drawn. The driver holds those sums: 2 x
105 numbers for 13 features.

Covariances are shrunk twice: the pooled one towards its diagonal, a class's one towards the pooled one (in coordinates in which
that is the unit matrix), each by the oracle approximating weight for its number of rows and by ``LEAST`` at least, which keeps
clean documents of a rare kind (a few words, an address, a key) near their class. A score is the logistic function
of the difference of the two log densities (Mahalanobis distances by the inverse Cholesky factors, which are made once and sent with the
model, and log determinants) plus the log odds of the classes.

Defined cases: a null text is as an empty one, whose features are those of no words, and is scored like any other; a null quality or a quality
other than 0 and 1 and a null doc_id teach nothing; a label that occurs twice, or whose document does, counts as often;
a document with two different labels teaches both; if a class has no row, every score is the smoothed share of class 1 among the labels (0.5
without any); ties between the classes give the share's odds; equal texts get equal scores; an empty table gives no rows; other
columns are ignored. A text of any length is one step of a task: it takes about 50 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, Hasher, chain, cut, flat, map_arrow, steps, word_spans

#: Features are whole numbers of 1 / UNIT.
UNIT = 1024
#: Least weight of what a covariance is shrunk to.
LEAST = 0.05
#: Scores of at least this are predicted 1.
THRESHOLD = 0.3



def marked(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


SYMBOL, LOUD, STOP = marked(b"#*$%&|<>@^~_=+\\/{}[]"), marked(b"!?"), marked(b".,;:")
UPPER, DIGIT, SPACE = marked(bytes(range(65, 91))), marked(bytes(range(48, 58))), marked(b" \t\n\v\f\r")
LETTER = marked(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
FIRST = 1 - marked(bytes(range(0x80, 0xC0)))  # not a continuation byte: a character begins

#: Names of the features, in their order.
FEATURES = ("words", "symbols", "loud", "stops", "upper", "digits", "capitals", "short_words", "same_word", "variety", "repeated_pairs", "line_words", "repeated_lines")


def odds(part: np.ndarray, whole: np.ndarray, expect: float, weight: float) -> np.ndarray:
    """Log odds of a share, drawn towards ``expect`` as by ``weight`` more cases."""
    a, b = part + expect * weight, whole - part + (1 - expect) * weight
    return np.log(a / b)


def per_row(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of marks between offsets."""
    out = np.zeros(len(offsets) - 1, np.int64)
    some = offsets[1:] > offsets[:-1]
    if some.any():
        out[some] = np.add.reduceat(marks, offsets[:-1][some], dtype=np.int64)
    return out


def distinct(row: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Different keys of each of n rows."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    return np.bincount(r[new], minlength=n)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rows' features in UNITs."""
    n = len(offsets) - 1
    starts, ends = word_spans(data, offsets, NOT_SPACE)
    row = np.searchsorted(offsets, starts, "right") - 1
    words = np.bincount(row, minlength=n)
    per = lambda kind: per_row(kind[data], offsets)
    visible = per(1 - SPACE)
    at = np.concatenate([[0], np.cumsum(FIRST[data], dtype=np.int64)])
    short = np.bincount(row[at[ends] - at[starts] <= 3], minlength=n)
    hashes = Hasher(LOWER[data])
    word = hashes(starts, ends)
    together = row[1:] == row[:-1]
    same = np.bincount(row[1:][together & (word[1:] == word[:-1])], minlength=n)
    pairs = np.bincount(row[1:][together], minlength=n)
    kinds = distinct(row, word, n)
    pair_kinds = distinct(row[1:][together], chain(word, 2)[together], n)
    capitals = np.bincount(row, UPPER[data[starts]], n)
    # lines with a word: from its first word to its last one
    line = np.concatenate([[0], np.cumsum(data == 10)])
    first = np.ones(len(starts), bool)
    first[1:] = ~together | (line[starts[1:]] != line[starts[:-1]])
    head = np.flatnonzero(first)
    tail = np.concatenate([head[1:], [len(starts)]])[: len(head)] - 1
    lines = np.bincount(row[head], minlength=n)
    line_kinds = distinct(row[head], hashes(starts[head], ends[tail]), n)
    out = np.stack(
        [
            np.log1p(words),
            odds(per(SYMBOL), visible, 0.002, 50),
            odds(per(LOUD), visible, 0.002, 50),
            odds(per(STOP), visible, 0.02, 50),
            odds(per(UPPER), per(LETTER), 0.03, 50),
            odds(per(DIGIT), visible, 0.005, 50),
            odds(capitals, words, 0.1, 10),
            odds(short, words, 0.4, 10),
            odds(same, pairs, 0.01, 10),
            np.log((kinds + 4) / (words + 4) ** 0.85),
            odds(pairs - pair_kinds, pairs, 0.05, 10),
            np.log((words + 10) / (lines + 1)),
            odds(lines - line_kinds, lines, 0.02, 10),
        ],
        axis=1,
    )
    return np.rint(out * UNIT).astype(np.int32)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, f (the features) of every row, written."""
    names = ["doc_id", "f"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for low, high in steps(offsets):
                part = data[offsets[low] : offsets[high]]
                f = features(part, offsets[low : high + 1] - offsets[low])
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, f.shape[1], dtype=np.int32)), pa.array(f.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), values], names)

    return cut(map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, f array<int>"), "features")


@dataclass(frozen=True)
class Model:
    """odds: of class 1. If both classes were learned: means, inverse Cholesky factors and half log determinants of classes 0 and 1."""

    odds: float
    means: tuple[np.ndarray, ...] = ()
    inverse: tuple[np.ndarray, ...] = ()
    half_logdet: tuple[float, ...] = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), 1 / (1 + math.exp(-self.odds)))
        density = []
        for mean, inverse, half in zip(self.means, self.inverse, self.half_logdet):
            z = (x - mean) @ inverse.T
            density.append(-0.5 * np.einsum("ij,ij->i", z, z) - half)
        t = np.clip(density[1] - density[0] + self.odds, -700, 700)
        return 1 / (1 + np.exp(-t))


def weight(s: np.ndarray, n: int) -> float:
    """How much of its mean diagonal a covariance of n rows takes over: the oracle approximating shrinkage, and ``LEAST``."""
    p, t, t2 = len(s), np.trace(s), float((s * s).sum())
    low = (n + 1 - 2 / p) * (t2 - t * t / p)
    return 1.0 if low <= 0 else min(1.0, max(LEAST, ((1 - 2 / p) * t2 + t * t) / low))


def discriminant(n: list[int], sums: list[np.ndarray], products: list[np.ndarray]) -> Model:
    """The model of two classes from their counts, sums and sums of products of features."""
    share = math.log((n[1] + 1) / (n[0] + 1))
    if min(n) == 0:
        return Model(share)
    means = [s / k for s, k in zip(sums, n)]
    scatter = [m - np.outer(s, s) / k for m, s, k in zip(products, sums, n)]
    pooled = sum(scatter) / sum(n)
    size = np.sqrt(np.maximum(np.diag(pooled), 1e-4))  # a feature that never varies gets a small size
    unit = pooled / np.outer(size, size)
    unit[np.diag_indices_from(unit)] = 1.0
    take = weight(unit, sum(n))
    pooled = (1 - take) * unit + take * np.eye(len(unit))
    factor = np.linalg.cholesky(pooled)
    white = np.linalg.inv(factor) / size
    inverse, half = [], []
    for s, k in zip(scatter, n):
        own = white @ (s / k) @ white.T
        take = weight(own, k)
        own = (1 - take) * own + take * max(np.trace(own) / len(own), 1e-2) * np.eye(len(own))
        low = np.linalg.cholesky(own)
        inverse.append(np.linalg.inv(low) @ white)
        half.append(float(np.log(np.diag(low)).sum()))
    return Model(share, tuple(means), tuple(inverse), tuple(half))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; those without a doc_id have no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """From all labelled rows that aren't held out: one sum for each class, feature and pair of features."""
    known = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & ~held_out(F.col("l_id")))
    rows = stats.join(known, F.col("doc_id") == F.col("l_id")).select("quality", F.transform("f", lambda x: x.cast("long")).alias("f"))
    p = len(FEATURES)
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    sums = [exact(F.col("f")[i]).alias(f"s{i}") for i in range(p)]
    products = [exact(F.col("f")[i] * F.col("f")[j]).alias(f"p{i}_{j}") for i in range(p) for j in range(i + 1)]
    n, s, m = [0, 0], [np.zeros(p), np.zeros(p)], [np.zeros((p, p)), np.zeros((p, p))]
    for r in rows.groupBy("quality").agg(F.count("*").alias("n"), *sums, *products).collect():
        q = r["quality"]
        n[q] = r["n"]
        s[q] = np.array([float(r[f"s{i}"]) for i in range(p)]) / UNIT
        for i in range(p):
            for j in range(i + 1):
                m[q][i, j] = m[q][j, i] = float(r[f"p{i}_{j}"]) / UNIT**2
    return discriminant(n, s, m)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) / UNIT
            got = model.score(f) if len(f) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got), pa.array((got >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = map_arrow(stats, run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a model of the labels that aren't held out."""
    stats = statistics(docs)
    return score(stats, fit(stats, labels))

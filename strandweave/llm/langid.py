"""Language ID by nearest centroid: hashed byte n-grams, TF-IDF, several clustered centroids per language, cosine,
and rejection by distance for a text's length.

The classifier is fitted on a bounded sample: about ``per_lang`` labelled documents of each language, chosen
by a hash of doc_id; their whole texts are vectorised on the executors and only the vectors (per_lang x
languages x ``FEATURES``, and those of a document's first bytes) reach the driver, where each language's vectors are clustered.
A cosine grows with the number of different n-grams, so texts are rejected below a low quantile of what held-aside documents of
the language, and their beginnings, with about as many different n-grams have. Prediction is one pass
over whole texts in any number of tasks, without a shuffle; the centroids (languages x clusters x FEATURES
float32) are the only thing that is sent to tasks.

Defined cases: a text that is null or has no letter gets ``und``, score 0, rejected; a null lang is not learned from;
if nothing is learned, every document is ``und``; a language whose sample is in one half, as a single document is, is held against itself; equal rows get equal results; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, flat, map_arrow, steps

FEATURES = 4096
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"
#: Beginnings of sample documents, in bytes, that stand for short texts.
CUTS = tuple(int(4 * 2 ** (i / 2)) for i in range(21))
#: Length classes: half octaves of the number of different n-grams; one of fewer rows takes the longest shorter ones in.
CLASSES, CLASS_ROWS = 2 * 12 + 1, 20

#: Letters keep their lower-case byte, bytes beyond ASCII stay, all else is a gap (0).
LETTERS = np.zeros(256, np.uint32)
LETTERS[97:123] = LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def counts(data: np.ndarray) -> np.ndarray:
    """Hashed n-gram counts of one text, in slices so that memory is bounded; n-grams don't cross gaps but
    at their end (a word's edge is a feature)."""
    out = np.zeros(FEATURES, np.int64)
    for at in range(0, len(data), STEP_BYTES):
        letters = LETTERS[data[max(0, at - max(ORDERS) + 1) : at + STEP_BYTES]]
        old = min(at, max(ORDERS) - 1)  # bytes of the slice before
        code = np.zeros(len(letters), np.uint32)
        for n in ORDERS:
            # n-gram that ends at i: its earlier n-1 bytes must be letters
            if n == 1:
                code = letters.copy()
                fine = letters > 0
            else:
                code = code[:-1] * np.uint32(0x01000193) + letters[n - 1 :] + np.uint32(1)
                fine = fine[:-1] & (letters[n - 2 : -1] > 0)
            new = np.arange(n - 1, n - 1 + len(code)) >= old if old else slice(None)
            some = code[new][fine[new]]
            out += np.bincount((some * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12), minlength=FEATURES)
    return out


def packed(tf: np.ndarray) -> bytes:
    return zlib.compress(np.minimum(tf, 65535).astype(np.uint16).tobytes(), 1)


def unpacked(tf: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(tf), np.uint16)


def has_letter(data: np.ndarray) -> bool:
    low = data[data < 128]
    if (LETTERS[low] > 0).any():
        return True
    return len(low) < len(data) and any(c.isalpha() for c in data.tobytes().decode(errors="ignore"))


@dataclass
class Centroids:
    langs: list[str]  # of each centroid
    idf: np.ndarray
    matrix: np.ndarray  # (FEATURES, centroids), columns of length 1
    least: dict[str, np.ndarray]  # by length class: below this cosine a document of the language is rejected

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        x = np.log1p(tf.astype(np.float32)) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, seed: int = 11, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out starts; rows of length 1."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    while len(centres) < min(k, len(x)):
        near = np.max(x @ np.array(centres).T, axis=1)
        gap = np.maximum(1 - near, 0) ** 2
        if gap.sum() <= 1e-9:
            break
        centres.append(x[rng.choice(len(x), p=gap / gap.sum())])
    c = np.array(centres)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.array([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def length_class(tf: np.ndarray) -> np.ndarray:
    """By different n-grams: repeating a word doesn't make a text longer."""
    return np.floor(2 * np.log2(np.maximum((tf > 0).sum(axis=-1), 1))).astype(np.int64)


def thresholds(lengths: np.ndarray, cosines: np.ndarray, quantile: float, slack: float) -> np.ndarray:
    """For each length class slack times the quantile; where even shorter rows are too few, nothing is rejected."""
    order = np.argsort(lengths, kind="stable")
    lengths, cosines, out = lengths[order], cosines[order], np.zeros(CLASSES)
    for k in range(CLASSES):
        low, high = np.searchsorted(lengths, [k, k + 1])
        if (low := min(low, high - CLASS_ROWS)) >= 0:
            out[k] = slack * float(np.quantile(cosines[low:high], quantile))
    return out


def train_rows(doc_id: Column) -> Column:
    """Rows that may be learned from; the rest is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(True))


def fit(docs: DataFrame, per_lang: int = 400, clusters: int = 4, quantile: float = 0.005, slack: float = 0.7, max_langs: int = 1000, sample: int = 20_000) -> Centroids:
    """per_lang: documents of each language in the sample, about, and sample: of all languages (the driver holds 8 KB for
    each); clusters: centroids of each language. A document is rejected if
    its cosine is below slack times this quantile of held-aside documents of its language and length: each half of the
    sample is held against centroids of the other half."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    seen = own.groupBy("lang").count().limit(max_langs + 1).collect()
    if len(seen) > max_langs:
        raise ValueError(f"more than max_langs = {max_langs} languages")
    seen = {r["lang"]: r["count"] for r in seen}
    per_lang = min(per_lang, sample / max(len(seen), 1))
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, per_lang / n))) for x, n in sorted(seen.items())], F.lit(0.0))
    hashed = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            pairs = list(zip(offsets, offsets[1:]))
            tf = [packed(counts(data[a:b])) for a, b in pairs]
            cuts = [[packed(counts(data[a : a + n])) for n in CUTS if n < b - a] for a, b in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tf, pa.binary()), pa.array(cuts, pa.list_(pa.binary()))], ["lang", "tf", "cuts"])

    got = map_arrow(own.where(hashed < share).select("lang", "text"), vectorise, "lang string, tf binary, cuts array<binary>").collect()
    got = sorted((r["lang"], bytes(r["tf"]), [bytes(x) for x in r["cuts"]]) for r in got)
    tf = np.array([unpacked(x) for _, x, _ in got], np.uint16).reshape(-1, FEATURES)
    lang, cuts = np.array([x for x, *_ in got], object), [x for *_, x in got]
    some = np.flatnonzero(tf.any(axis=1))
    tf, lang, cuts = tf[some], lang[some], [cuts[i] for i in some]
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))) + 1).astype(np.float32)
    model = Centroids([], idf, np.zeros((FEATURES, 0), np.float32), {})
    columns = []
    for x in sorted(set(lang)):
        v = model.vectors(tf[lang == x])
        c = cluster(v, clusters)
        columns.append(c)
        model.langs += [x] * len(c)
        half = np.array([zlib.crc32(t) % 2 for t in tf[lang == x]])  # copies are in the same one
        halves = [half == 0, half == 1] if 0 < half.sum() < len(half) else [half >= 0] * 2
        lengths, cosines = [], []
        for ours, others in (halves, halves[::-1]):
            other = cluster(v[others], clusters).T
            for i in np.flatnonzero(lang == x)[ours]:
                own_tf = np.array([tf[i], *map(unpacked, cuts[i])])
                own_tf = own_tf[own_tf.any(axis=1)]
                lengths.append(length_class(own_tf))
                cosines.append(np.max(model.vectors(own_tf) @ other, axis=1))
        model.least[x] = thresholds(np.concatenate(lengths), np.concatenate(cosines), quantile, slack)
    if columns:
        model.matrix = np.ascontiguousarray(np.concatenate(columns).T.astype(np.float32))
    return model


def predict(docs: DataFrame, model: Centroids, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """columns, lang_pred (nearest centroid's language; ``und`` for a text without letters), score (cosine), rejected. What is
    asked for passes through, so that a filter on the verdict needs no join with the texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # clusters x FEATURES floats for each of max_langs languages at most
    docs = docs.select(*dict.fromkeys([*columns, "text"]))
    at, n = docs.columns.index("text"), len(columns)
    names = [*columns, "lang_pred", "score", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        langs, least = np.array(model.langs, object), model.least
        for batch in batches:
            data, offsets = flat(batch.column(at))
            pred, score, bad = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            for low in range(0, batch.num_rows, 256):
                rows = [i for i in range(low, min(low + 256, batch.num_rows)) if has_letter(data[offsets[i] : offsets[i + 1]])]
                if rows and len(langs):
                    tf = np.array([counts(data[offsets[i] : offsets[i + 1]]) for i in rows])
                    near = model.vectors(tf) @ model.matrix
                    best = np.argmax(near, axis=1)
                    pred[rows], score[rows] = langs[best], np.clip(near[np.arange(len(rows)), best], 0, 1)
                    bad[rows] = score[rows] < np.array([least[p][k] for p, k in zip(langs[best], length_class(tf))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(pred, pa.string()), pa.array(score), pa.array(bad, pa.bool_())], names)

    kinds = dict(docs.dtypes)
    return map_arrow(docs, run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", lang_pred string, score double, rejected boolean")


def held_out_row(doc_id: int) -> bool:
    """The same split in plain Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def identify(docs: DataFrame, model: Centroids | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row; fits on the rows that aren't held out."""
    model = model or fit(docs.where(train_rows(F.col("doc_id"))))
    out = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", (~train_rows(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "rejected")

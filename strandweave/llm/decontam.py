"""Benchmark decontamination: word-level suffix arrays of the training texts, searched with every test suffix.

Each Arrow batch of documents is a shard. Its suffix array holds the suffixes that can begin a window: those whose first
words (as many as the shortest window has, 10 at most) all occur in the test set and whose first two words
stand together there; other suffixes can match no test suffix for the needed length. Every test suffix is
binary-searched in it. Suffixes with equal first words are sorted by the word before them, so only those places are taken
from a range at which the match can't be extended to the left: each gives one longest verbatim match, whose length is found by
bisection on fingerprints of word runs. So work grows with the matches, not with their words. Words are
confirmed byte by byte where a match covers them. No shuffle; a shard's memory is bounded by the batch size.

The test set goes to the tasks in blocks of at most ``block_mb`` MB of item text (its size is summed first). Blocks are
passes over the documents, which are numbered and written once, one after the other: each writes its matches, which are joined at the end, so a worker holds one block.

Defined cases: null texts have no words; an item with fewer than ``window`` words, but not none, is one window; equal
items each count; empty tables give no rows (documents) or no matches (test set); other columns are ignored; a text is searched
whole, however long (some 100 bytes of memory for each of its words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, Hasher, cut, flat, map_arrow, mix, steps, word_spans

MATCH = "array<struct<item_id: long, item_word: int, doc_word: int, n_words: int>>"
_MATCH = pa.struct([("item_id", pa.int64()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())])


def words_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, words' starts and ends in them, their fingerprints, and the first word of each row (n + 1)."""
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, prints = [], [], []
    for a, b in steps(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a]
        s, e = word_spans(part, offsets[a : b + 1] - at, ALNUM)
        prints.append(Hasher(part)(s, e))
        starts.append(s + at)
        ends.append(e + at)
    none = [np.zeros(0, np.int64)]
    s, e = np.concatenate(starts or none), np.concatenate(ends or none)
    return data, s, e, np.concatenate(prints or [np.zeros(0, np.uint64)]), np.searchsorted(s, offsets)


class TestSet:
    """A block of test items: its vocabulary, words of all items in one row, and its suffixes that are at least a window long."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]], window: int):
        items = sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        data, s, e, prints, self.first = words_of(pa.array([t for _, t in items], pa.string()))
        self.window, self.ids = window, [i for i, _ in items]
        self.vocabulary, one = np.unique(prints, return_index=True)
        self.words = [data[s[i] : e[i]].tobytes() for i in one]
        self.number = (np.searchsorted(self.vocabulary, prints) + 1).astype(np.int64)
        n = np.diff(self.first)
        size = np.repeat(np.minimum(window, n), n)
        last = np.repeat(self.first[1:], n)
        self.suffix = np.flatnonzero(np.arange(len(prints)) + size <= last)  # places in the row of all words
        self.size, last = size[self.suffix], last[self.suffix]
        self.least = int(self.size.min()) if len(self.size) else 0
        at = self.suffix[:, None] + np.arange(window)
        low = np.where(at < (self.suffix + self.size)[:, None], self.number[np.minimum(at, len(prints) - 1)], 0) if len(at) else np.zeros((0, window), np.int64)
        self.low = key(low)
        self.high = key(np.where(np.arange(window)[None, :] < self.size[:, None], low, 0xFFFFFFFF))
        self.bits = np.zeros(1 << 20, bool)
        if self.least > 1:
            self.bits[pair(low[:, 0], low[:, 1])] = True
        starts = np.isin(self.suffix, self.first[:-1])
        self.before = np.where(starts, 0, self.number[self.suffix - 1]) if len(self.suffix) else self.suffix
        self.last = last
        self._runs: Hasher | None = None  # made where it is used

    def runs(self) -> Hasher:
        self._runs = self._runs or Hasher(self.number)
        return self._runs


def key(ids: np.ndarray) -> np.ndarray:
    """Rows of word numbers as bytes that sort like them."""
    return np.ascontiguousarray(ids.astype(">u4")).view(f"S{4 * ids.shape[1]}").ravel() if len(ids) else np.zeros(0, f"S{4 * ids.shape[1]}")


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mix(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)


def suffix_array(number: np.ndarray, first: np.ndarray, last: np.ndarray, test: TestSet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the shard, sorted by their next ``window`` words and then the word before; those words; the word before (0: none, or
    unknown); first, last: the ends of each word's row."""
    known = np.concatenate([[0], np.cumsum(number > 0)])
    at = np.arange(len(number) - test.least + 1)
    at = at[(known[at + test.least] - known[at] == test.least) & (at + test.least <= last[at])]
    if test.least > 1:
        at = at[test.bits[pair(number[at], number[at + 1])]]
    next_ = at[:, None] + np.arange(test.window)
    inside = next_ < last[at][:, None]
    keys = key(np.where(inside, number[np.minimum(next_, len(number) - 1)], 0))
    before = np.where(at > first[at], number[at - 1], 0)
    order = np.lexsort((before, keys))
    return at[order], keys[order], before[order]


def starts_of(test: TestSet, at: np.ndarray, keys: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (test suffix, place) whose windows are equal and which no equal words precede."""
    low, high = np.searchsorted(keys, test.low, "left"), np.searchsorted(keys, test.high, "right")
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))  # in each of these runs places are sorted by the word before
    tests, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for t in np.flatnonzero(high > low):
        if test.before[t] == 0:
            parts = [at[low[t] : high[t]]]
        else:
            runs = new[np.searchsorted(new, low[t]) : np.searchsorted(new, high[t])]
            parts = []
            for a, b in zip(runs, np.append(runs[1:], high[t])):
                x, y = a + np.searchsorted(before[a:b], test.before[t]), a + np.searchsorted(before[a:b], test.before[t], "right")
                parts += [at[a:x], at[y:b]]
        parts = np.concatenate(parts)
        tests.append(np.full(len(parts), t))
        places.append(parts)
    return np.concatenate(tests), np.concatenate(places)


def lengths(test: TestSet, number: np.ndarray, last: np.ndarray, tests: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Words that are equal from each pair on: by bisection, a window at least."""
    mine = Hasher(number)
    at = test.suffix[tests]
    low, high = test.size[tests].copy(), np.minimum(test.last[tests] - at, last[places] - places)
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_] + 1) // 2
        same = test.runs()(at[open_], at[open_] + mid) == mine(places[open_], places[open_] + mid)
        low[open_[same]] = mid[same]
        high[open_[~same]] = mid[~same] - 1
    return low


def search(column, test: TestSet) -> tuple[np.ndarray, list[tuple[int, int, int, int, int]]]:
    """Words of each row, and matches (row, item's index, its word, the row's word, length), longest ones."""
    data, s, e, prints, first = words_of(column)
    n_words = np.diff(first)
    if not len(test.size) or not len(prints):
        return n_words, []
    number = np.searchsorted(test.vocabulary, prints)
    number = np.where(test.vocabulary[np.minimum(number, len(test.vocabulary) - 1)] == prints, number + 1, 0).astype(np.int64)
    start, last = np.repeat(first[:-1], n_words), np.repeat(first[1:], n_words)
    while True:
        tests, places = starts_of(test, *suffix_array(number, start, last, test))
        size = lengths(test, number, last, tests, places)
        edge = np.bincount(places, minlength=len(number) + 1) - np.bincount(places + size, minlength=len(number) + 1)
        covered = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        wrong = [i for i in covered if data[s[i] : e[i]].tobytes() != test.words[number[i] - 1]]
        if not wrong:
            break
        number[wrong] = 0  # another word has the fingerprint of one of the test set's: search without it
    row = np.searchsorted(first, places, "right") - 1
    item = np.searchsorted(test.first, test.suffix[tests], "right") - 1
    return n_words, sorted(zip(row.tolist(), item.tolist(), (test.suffix[tests] - test.first[item]).tolist(), (places - first[row]).tolist(), size.tolist()))


#: Number of a row where the test set is searched in blocks.
ROW = "decontam_row"


def one_pass(docs: DataFrame, test: TestSet, out: list[str]) -> DataFrame:
    """docs: columns, text among them, then n_words and matches, to which the test set's are added; out: columns to return."""
    at, keep = docs.columns.index("text"), [docs.columns.index(c) for c in out]
    sent = docs.sparkSession.sparkContext.broadcast(test)  # at most block_mb of text, see matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = sent.value
        for batch in batches:
            n_words, found = search(batch.column(at), test)
            mine: list[list] = [[] for _ in range(batch.num_rows)]
            for row, item, j, place, size in found:
                mine[row].append({"item_id": test.ids[item], "item_word": j, "doc_word": place, "n_words": size})
            old = batch.column(batch.num_columns - 1).to_pylist()
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(n_words, pa.int64()), pa.array([(a or []) + b for a, b in zip(old, mine)], pa.list_(_MATCH))], [*out, "n_words", "matches"])

    kinds = dict(docs.dtypes)
    return map_arrow(docs, run, ", ".join(f"`{c}` {kinds[c]}" for c in out) + f", n_words long, matches {MATCH}")


def matches(docs: DataFrame, items: DataFrame, window: int = 10, block_mb: float = 32, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """columns (what is asked for passes through, so that a filter needs no join with the texts), n_words and the longest verbatim matches of at least a window with test items."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // int(block_mb * (1 << 20))))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    names = list(dict.fromkeys([*columns, "text"]))
    none = [F.lit(0).cast("long").alias("n_words"), F.expr(f"cast(array() as {MATCH})").alias("matches")]
    test_set = lambda b: TestSet([tuple(r) for r in items.where(block == b).collect()], window)
    if blocks == 1:
        return one_pass(docs.select(*names, *none), test_set(0), list(columns))
    # rows get a number and are written once; what a block finds is written without them
    rows, found = cut(docs.select(*names).withColumn(ROW, F.monotonically_increasing_id()), "numbered"), None
    for b in range(blocks):
        one = one_pass(rows.select(ROW, "text", *none), test_set(b), [ROW])
        one = cut(one.where(F.size("matches") > 0) if b else one, "matches")  # the first has a row for each
        found = one if found is None else found.unionByName(one)
    found = found.groupBy(ROW).agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))
    return rows.join(found, ROW).select(*columns, "n_words", "matches")


def spans_hit(spans: list[tuple[int, int]]) -> int:
    """Words in the union of (start, length)."""
    hit = end = 0
    for a, n in sorted(spans):
        hit += max(0, a + n - max(a, end))
        end = max(end, a + n)
    return hit

"""Presence over arriving datasets with a state that shrinks: against counting at once, and what remains after each arrival."""

import random

import pytest

from strandweave.operators import count
from strandweave.streaming import pruned

SCHEMA = "ordinal long, seq string"


def arrive(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def update(spark, tmp_path, n, x, k=3, **more):
    return pruned.update(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), k, n, x, str(tmp_path / "out"), **more)


def counted(spark, tmp_path, x):
    return sorted(map(tuple, pruned.counts(spark, str(tmp_path / "out"), x).collect()))


@pytest.mark.parametrize("n, x, shares", [(6, 0, (2, 4, 6)), (6, 2, (1, 3, 3, 6)), (6, 5, (6,)), (6, 6, (3, 6))])
def test_arrivals_match_counting_at_once(spark, tmp_path, n, x, shares):
    rng = random.Random(n * 10 + x)
    rows = [(rng.randint(1, n), "".join(rng.choices("ACGT", (5, 3, 2, 1), k=12))) for _ in range(40)] + [(2, None), (3, ""), (4, "AC"), (None, "ACGTACGT"), (n + 1, "AAAAA")]
    before = 0
    for upto in shares:
        arrive(spark, tmp_path, [r for r in rows if r[0] is None or before < r[0] <= upto or (upto == n < r[0])])
        update(spark, tmp_path, n, x)
        before = upto
    valid = spark.createDataFrame([r for r in rows if r[0] is not None and r[0] <= n], "dataset_id long, seq string")
    assert counted(spark, tmp_path, x) == sorted(map(tuple, count.count_datasets(valid, 3, x).collect()))


def test_state_shrinks(spark, tmp_path):
    """Each dataset has a k-mer that all have, and others; threshold 2 of 4. What is new in the third is of no use, and
    what was found once goes with the fourth, as the third might have gone on."""
    texts = {1: "AAAAAANACGTAGCTN", 2: "AAAAAANGGGATCN", 3: "AAAAAANCCTTGAN", 4: "AAAAAANACTCAN"}
    kept, whole = [], []
    for i, t in texts.items():
        for out, prune in ((kept, True), (whole, False)):
            arrive(spark, tmp_path / str(prune), [(i, t)])
            out.append(update(spark, tmp_path / str(prune), 4, 2, k=5, prune=prune))
    assert whole == sorted(whole) and whole[-1] > kept[-1] == 1
    assert kept[:2] == whole[:2] and kept[2] == kept[1] < whole[2]
    assert counted(spark, tmp_path / "True", 2) == counted(spark, tmp_path / "False", 2) == [("AAAAA", 4)]


def test_a_dataset_in_several_batches_counts_once(spark, tmp_path):
    for ordinal, text in ((1, "AAAA"), (1, "AAAACCC"), (2, "AAAA"), (2, "CCC"), (1, "CCC"), (2, "CCCC")):  # 1 after 2 is late
        arrive(spark, tmp_path, [(ordinal, text)])
        update(spark, tmp_path, 2, 1)
    assert counted(spark, tmp_path, 1) == [("AAA", 2), ("CCC", 2)]



def test_nothing_new(spark, tmp_path):
    arrive(spark, tmp_path, [(1, "AAAA"), (2, "AAAA")])
    update(spark, tmp_path, 2, 1)
    once = counted(spark, tmp_path, 1)
    update(spark, tmp_path, 2, 1)
    assert counted(spark, tmp_path, 1) == once == [("AAA", 2)]


def test_a_repeated_batch_writes_the_same(spark, tmp_path, monkeypatch):
    """The run fails after a version is written, before its batch is marked as done."""
    arrive(spark, tmp_path, [(1, "AAAAC"), (2, "AAAA")])
    update(spark, tmp_path, 3, 1)
    arrive(spark, tmp_path, [(3, "AAAAC")])
    update(spark, tmp_path, 3, 1)
    arrive(spark, tmp_path, [(3, "AACTT")])

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(pruned, "drop", fail)
        with pytest.raises(Exception, match="lost"):
            update(spark, tmp_path, 3, 1)
    update(spark, tmp_path, 3, 1)
    rows = [(1, "AAAAC"), (2, "AAAA"), (3, "AAAAC"), (3, "AACTT")]
    want = count.count_datasets(spark.createDataFrame(rows, "dataset_id long, seq string"), 3, 1)
    assert counted(spark, tmp_path, 1) == sorted(map(tuple, want.collect()))


def test_no_datasets(spark):
    records = spark.createDataFrame([(None, "AAAA")], "dataset_id string, seq string")
    assert pruned.presence_in_arrivals(records, 3, 0).count() == 0


def test_state_holds_numbers(spark, tmp_path):
    arrive(spark, tmp_path, [(1, "AAAAC"), (2, "AAAA")])
    update(spark, tmp_path, 2, 1)
    assert dict(spark.read.parquet(str(tmp_path / "out" / "state" / "0")).dtypes)["kmer"] == "bigint"
    assert counted(spark, tmp_path, 1) == [("AAA", 2)]

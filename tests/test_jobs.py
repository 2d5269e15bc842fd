"""The jobs on growing copies of small inputs: runs that find new files, none, or the leftovers of one that failed."""

import logging
import os
import random
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

from jobs import contamination_screen, kmer_ledger, queries

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ROWS = "doc_id long, text string, source string"
K = 5


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def kmers(s, k=K):
    return [min(s[i : i + k], rc(s[i : i + k])) for i in range(len(s) - k + 1)]


def dna(seed, n):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
    assert before == {k: spark.conf.get(k, None) for k in before}


def expected(rows, threshold):
    counts = {}
    for _, text, source in rows:
        counts.setdefault(source, Counter()).update(kmers(text or ""))
    return sorted(((s, m, n) for s, c in counts.items() for m, n in c.items() if n > threshold), key=repr)


def ledger(df):
    return sorted(((r["dataset"], r["kmer"], r["count"]) for r in df.collect()), key=repr)


def arrive(spark, path, rows):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(path)


def test_ledger_grows(spark, tmp_path, caplog):
    source, out = f"file://{tmp_path}/reads", f"file://{tmp_path}/ledger"
    run = lambda: kmer_ledger.run(spark, source, out, k=K, threshold=1, buckets=4, mapped=False)
    first = [(1, dna(1, 300), "a"), (2, dna(2, 200), "b"), (3, None, "c"), (4, "AC", ""), (5, dna(3, 90), None), (5, dna(3, 90), None), (6, "A" * 500, "hot")]
    arrive(spark, source, first)
    assert ledger(run()) == expected(first, 1)
    files = lambda: sorted(os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "ledger" / "deltas") for f in fs if f.endswith(".parquet"))
    held = files()
    assert ledger(run()) == expected(first, 1) and files() == held  # nothing new: nothing written
    second = [(7, dna(4, 300), "a"), (8, dna(1, 300), "a"), (9, dna(5, 100), "new"), (10, dna(3, 90), None)]
    arrive(spark, source, second)
    with caplog.at_level(logging.INFO):
        assert ledger(run()) == expected(first + second, 1)
    assert "read 4 records" in caplog.text  # the new file's only
    assert set(held) < set(files())


def test_ledger_repeats_a_failed_batch(spark, tmp_path, monkeypatch):
    source, out = f"file://{tmp_path}/reads", f"file://{tmp_path}/ledger"
    rows = [(i, dna(i, 120), f"s{i % 3}") for i in range(6)]
    arrive(spark, source, rows)
    whole = kmer_ledger._overwrite

    def broken(df, path, name, *parts):
        if path.endswith("counts"):
            raise OSError("lost")
        return whole(df, path, name, *parts)

    monkeypatch.setattr(kmer_ledger, "_overwrite", broken)
    with pytest.raises(Exception, match="lost"):
        kmer_ledger.run(spark, source, out, k=K, threshold=0, mapped=False)
    monkeypatch.setattr(kmer_ledger, "_overwrite", whole)
    more = [(9, dna(9, 50), "s1")]
    arrive(spark, source, more)  # comes while the batch is open: it is in the next one
    assert ledger(kmer_ledger.run(spark, source, out, k=K, threshold=0, mapped=False)) == expected(rows + more, 0)
    with pytest.raises(Exception, match="belong together"):
        kmer_ledger.run(spark, source, out, checkpoint=f"file://{tmp_path}/other", k=K, threshold=0, mapped=False, files_per_batch=1)


def test_screen(spark, tmp_path):
    known = dna(11, 60)
    rows = [(1, dna(1, 400) + known + dna(2, 400), "a"), (2, known + "ACGTA", "a"), (3, None, "b"), (4, "ACG", None), (5, dna(3, 300), "b"), (5, dna(3, 300), "b"), (5, dna(4, 100), "b"), (None, dna(5, 80), "")]
    reads, index, out = (f"file://{tmp_path}/{n}" for n in ("reads", "index", "out"))
    arrive(spark, reads, rows)
    arrive(spark, index, [(1, known, "x"), (2, None, "x")])
    k = 11
    have = set(kmers(known, k))
    for _ in range(2):  # the second run replaces what the first has written
        got = contamination_screen.run(spark, reads, index, out, k=k, mapped=False, buckets=3, share=50).collect()
        sums = {}
        for i, text, source in rows:
            hits = [m in have for m in kmers(text or "", k)]
            bare = "".join(".x"[h] for h in hits).split("x")
            mine = sums.setdefault((i, source or None), [0, 0, 0, 0])
            mine[0] += len(hits)
            mine[1] += sum(hits)
            mine[2] += sum(bool(p) for p in bare)
            mine[3] += sum(len(p) + k - 1 for p in bare if p)
        want = {key: (n, f, 100 * f > 50 * n, *((0, 0) if 100 * f > 50 * n else (s, b))) for key, (n, f, s, b) in sums.items()}
        assert {(r["record"], r["dataset"] or None): (r["scanned"], r["filtered"], r["contaminated"], r["segments"], r["nucleotides"]) for r in got} == want
        assert [key for key, v in want.items() if v[2]] == [(2, "a")]
        parts = spark.read.parquet(f"{out}/segments").where("record = 1").orderBy("start").collect()
        assert [p["seq"] for p in parts] == [dna(1, 400) + known[: k - 1], known[-(k - 1) :] + dna(2, 400)]
        summary = spark.read.option("header", True).csv(f"{out}/summary").collect()
        assert sum(int(r["records"]) for r in summary) == len(want)


def test_command_lines(spark, tmp_path):
    """Config file and arguments; the command makes its own session, so it runs as a process of its own."""
    arrive(spark, f"file://{tmp_path}/reads", [(1, dna(1, 100), "a")])
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.ui.enabled=false --conf spark.checkpoint.dir=file://{tmp_path}/shared pyspark-shell"}
    config = tmp_path / "ledger.toml"
    config.write_text('k = 4\nthreshold = 0\nmapped = false\n')
    done = subprocess.run([sys.executable, "jobs/kmer_ledger.py", "--config", config, "--source", f"{tmp_path}/reads", "--out", f"{tmp_path}/out", "--k", str(K)], cwd=ROOT, env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr
    assert "read 1 records" in done.stderr
    assert ledger(spark.read.parquet(f"{tmp_path}/out/counts")) == expected([(1, dna(1, 100), "a")], 0)
    with pytest.raises(SystemExit):
        contamination_screen.main(["--config", f"{ROOT}/jobs/contamination_screen.toml"])


@pytest.mark.parametrize("k", [5, 40])
def test_ledger_packs_windows(spark, tmp_path, k):
    """Deltas of windows up to 31 bases are packed stretches: less than the windows' texts; longer ones are counts. Counts that an earlier version left in the deltas are added."""
    source, out = f"file://{tmp_path}/reads", f"file://{tmp_path}/ledger"
    rows = [(1, dna(1, 3000), "a"), (2, dna(1, 3000)[500:900].lower(), "a"), (3, "A" * 3000, None), (4, dna(2, 300), "b")]
    arrive(spark, source, rows)
    want = {}
    for _, text, name in rows:
        want.setdefault(name, Counter()).update(kmers(text.upper(), k))
    run = lambda: ledger(kmer_ledger.run(spark, source, out, k=k, threshold=1, buckets=4, mapped=False))
    assert run() == sorted(((s, m, n) for s, c in want.items() for m, n in c.items() if n > 1), key=repr)
    held = spark.read.parquet(f"{out}/deltas")
    assert (held.where("kmer IS NOT NULL").count() == 0) == (k == 5)
    if k == 5:  # as an earlier version wrote it: the bucket is the dataset's
        bucket = held.where("dataset = 'b'").first()["bucket"]
        old = spark.createDataFrame([("b", m, n, 0, bucket) for m, n in want["b"].items()], "dataset string, kmer string, count long, batch long, bucket int")
        old.write.mode("append").partitionBy("batch", "bucket").parquet(f"{out}/deltas")
        more = (5, dna(3, 50), "b")
        arrive(spark, source, [more])
        want["b"] = want["b"] + want["b"] + Counter(kmers(more[1], k))
        assert run() == sorted(((s, m, n) for s, c in want.items() for m, n in c.items() if n > 1), key=repr)

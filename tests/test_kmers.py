"""Golden vectors of counting, presence, subtraction, compaction and reforming."""

import itertools
import random

import pytest

from strandweave.functions import seq
from strandweave.operators import compact, count, reform, subtract
from strandweave.plans import catalog


def reads(spark, *texts, start=0):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts, start)], "record_idx long, seq string")


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def grouped(values):
    """(value, start, length) of each run of equal values."""
    at = 0
    for value, run in itertools.groupby(values):
        n = len(list(run))
        yield value, at, n
        at += n


def counts(spark, k, *texts, x=0):
    return {r["kmer"]: r["count"] for r in count.count_kmers(reads(spark, *texts), k, x).collect()}


@pytest.mark.parametrize(
    "k, texts, x, want",
    [
        (3, ["AAAA"], 0, {"AAA": 2}), (3, ["TTTT"], 0, {"AAA": 2}), (3, ["ACGT"], 0, {"ACG": 2}), (3, ["acgta"], 0, {"ACG": 2, "GTA": 1}), (3, ["TACGT"], 0, {"ACG": 2, "GTA": 1}),
        (3, ["ATATAT"], 0, {"ATA": 4}), (3, ["AGCT"], 0, {"AGC": 2}), (4, ["ACGTAC"], 0, {"ACGT": 1, "CGTA": 1, "GTAC": 1}), (3, ["ACGTACGT"], 1, {"ACG": 4, "GTA": 2}),
        (3, ["AAAA"], 1, {"AAA": 2}), (3, ["AAAA"], 2, {}), (3, ["AAANAAA"], 1, {"AAA": 2}), (3, ["", None, "AC"], 0, {}),
    ],
)
def test_counts(spark, k, texts, x, want):
    assert counts(spark, k, *texts, x=x) == want


def test_long_fragment_crosses_pieces(spark):
    r = random.Random(3)
    s = "".join(r.choices("ACGT", k=3 * seq.PIECE + 100))
    want = {}
    for i in range(len(s) - 30):
        w = s[i : i + 31]
        w = min(w, compact.rc(w))
        want[w] = want.get(w, 0) + 1
    assert counts(spark, 31, s) == want
    w = seq.windows(seq.fragments(reads(spark, s), 31, "record_idx"), 31, "record_idx", place=True)
    assert sorted(r["pos"] for r in w.collect()) == list(range(len(s) - 30))


def test_presence(spark):
    d = spark.createDataFrame([(0, "AAAACGACG"), (1, "AAAACGTTT"), (2, "GGGACGCCC")], "dataset_id long, seq string")
    assert {r["kmer"]: r["n_datasets"] for r in count.count_datasets(d, 3, 2).collect()}["ACG"] == 3
    assert "AAA" not in {r["kmer"] for r in count.count_datasets(d, 3, 2).collect()}
    assert count.count_datasets(d, 3, 300, n_datasets=3).collect() == []


@pytest.mark.parametrize("n, found", [(300, False), (301, True)])
def test_presence_above_many_datasets(spark, tmp_path, n, found):
    rows = [(i, "acgt" * 8, "en", f"s{i % n}", 32) for i in range(n + 5)] + [(n + 5, "acgt" * 8, "en", None, 32)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = [r["n_datasets"] for r in catalog.QUERIES["dataset_presence_threshold_too_high"](spark, str(tmp_path)).collect()]
    assert set(got) == ({n} if found else set())


@pytest.mark.parametrize("bad", [dict(k=0), dict(k=65), dict(k=3, m=4), dict(k=3, threshold=255), dict(k=3, partitions=0)])
def test_config(bad):
    with pytest.raises(ValueError):
        count.CounterConfig(**bad).check()
    with pytest.raises(ValueError):
        count.CounterConfig(33).check(datasets=True)


def test_superkmers_tile(spark):
    r = random.Random(1)
    df = reads(spark, *["".join(r.choices("ACGTN", [9, 9, 9, 9, 1], k=200)) for _ in range(5)])
    by = {}
    for x in count.superkmers(df, 9, 4).collect():
        by.setdefault((x["record_idx"], x["frag"]), []).append((x["start"], x["windows"]))
    frags = {(x["record_idx"], x["frag"]): len(x["seq"]) for x in seq.fragments(df, 9, "record_idx").collect()}
    assert set(by) == set(frags)
    for key, runs in by.items():
        end = 0
        for start, n in sorted(runs):
            assert start == end
            end += n
        assert end == frags[key] - 8


@pytest.mark.parametrize("piece", [4, 32, 4096])
def test_runs_across_pieces(spark, monkeypatch, piece):
    """Runs longer than a piece, ending at its edge, or of one window, are what a walk over the fragment finds."""
    monkeypatch.setattr(seq, "PIECE", piece)
    k, m, r = 7, 3, random.Random(piece)
    texts = ["A" * 90, "AC" * 40 + "N" + "G" * 13, "".join(r.choices("ACGTN", [9, 9, 9, 9, 1], k=300)), "ACGTACG", "TTTTTTTTGATTACA" * 6, "", "ACG"]
    texts += ["".join(r.choices("ACGT", k=k - 1 + piece * n)) for n in (1, 2) if piece < 100]
    known = {min(x, rc(x)) for t in texts[2:3] + texts[4:5] for x in (t[i : i + k] for i in range(0, len(t) - k + 1, 3)) if "N" not in x}
    runs, segs = set(), set()
    for rec, text in enumerate(texts):
        for frag, part in enumerate(x for x in text.split("N") if x):
            windows = [part[i : i + k] for i in range(len(part) - k + 1)]
            mins = [min(min(w[j : j + m], rc(w[j : j + m])) for j in range(k - m + 1)) for w in windows]
            for value, start, n in grouped(mins):
                runs.add((rec, frag, start, n, value))
            for hit, start, n in grouped([min(w, rc(w)) in known for w in windows]):
                if not hit:
                    segs.add((rec, frag, start, part[start : start + n + k - 1]))
    df = reads(spark, *texts)
    got = [tuple(x) for x in count.superkmers(df, k, m).collect()]
    assert len(got) == len(runs) and set(got) == runs
    index = spark.createDataFrame([(x,) for x in sorted(known)], "kmer string")
    got = [tuple(x) for x in subtract.segments(df, index, k).collect()]
    assert len(got) == len(segs) and set(got) == segs


def test_segments_of_a_chromosome(spark):
    """Time in proportion to the length: 5 million bases with a hit every 60, and a second run over no hit at all."""
    r = random.Random(1)
    text = "".join(r.choices("ACGT", k=5_000_000))
    index = spark.createDataFrame([(min(x, rc(x)),) for x in (text[i : i + 21] for i in range(0, len(text) - 21, 60))], "kmer string")
    df = reads(spark, text)
    got = subtract.segments(df, index, 21).agg({"seq": "count", "start": "max"}).first()
    assert got["count(seq)"] == (len(text) - 21 + 59) // 60
    assert [x["seq"] == text for x in subtract.segments(df, index.where("false"), 21).collect()] == [True]


def test_segments_of_equal_records(spark):
    """Rows without an id, and rows twice, have their segments each."""
    text = "ACGTTGCAAC" * 3 + "GGATC"
    df = spark.createDataFrame([(None, text), (4, text), (4, text)], "record_idx long, seq string")
    index = spark.createDataFrame([(min(text[30:35], rc(text[30:35])),)], "kmer string")
    got = sorted(((x["record_idx"] or 0, x["start"], x["seq"]) for x in subtract.segments(df, index, 5).collect()))
    assert got == [(i, 0, text[:34]) for i in (0, 4, 4)]


def test_subtract(spark):
    index = count.distinct_kmers(reads(spark, "AAACG"), 3)
    assert {r["kmer"] for r in subtract.subtract_distinct(reads(spark, "AAATG"), index, 3).collect()} == {"AAT", "ATG"}
    aaa = count.distinct_kmers(reads(spark, "AAA"), 3)
    assert [r["kmer"] for r in subtract.subtract_distinct(reads(spark, "CCC", "GGG", "CCC"), aaa, 3).collect()] == ["CCC"]
    assert tuple(subtract.stats(reads(spark, "AAATG"), index, 3).first()) == (3, 1, 2)
    segs = subtract.segments(reads(spark, "CCCAAAGGG"), aaa, 3)
    assert [r["seq"] for r in segs.orderBy("start").collect()] == ["CCCAA", "AAGGG"]
    assert subtract.nucleotides(segs).first()[0] == 10
    assert tuple(subtract.stats(reads(spark, "AAACG", "CCCG"), aaa.where("false"), 3).first()) == (5, 0, 5)
    assert tuple(subtract.stats(reads(spark, "AAAT", "CCCC"), aaa, 3).first()) == (4, 1, 3)
    assert subtract.check_k(31) == 19 and subtract.check_k(5) == 3
    with pytest.raises(ValueError):
        subtract.check_k(4)


@pytest.mark.parametrize("most", [None, 0])
@pytest.mark.parametrize("keys", [(), ("dataset_id",)])
def test_probed_stats(spark, monkeypatch, most, keys):
    """The counts of the plain join, whatever the filter lets pass; without reads and without an index, too."""
    r = random.Random(4)
    monkeypatch.setattr(subtract, "FILTER_BITS", 1)  # many absent windows pass
    rows = [(i, i % 3, "".join(r.choices("ACGTN", k=400))) for i in range(40)] + [(40, None, "A" * 300), (41, 1, None)]
    df = spark.createDataFrame(rows, "record_idx long, dataset_id long, seq string")
    index = count.distinct_kmers(df.where("record_idx % 2 = 0"), 9).limit(3000)
    index = spark.createDataFrame(index.collect(), "kmer string")
    for d, i in ((df, index), (df, index.where("false")), (df.where("false"), index)):
        got, want = subtract.probed_stats(d, i, 9, *keys, most=most), subtract.stats(d, i, 9, *keys)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("most", [None, 0])
@pytest.mark.parametrize("keys", [(), ("dataset_id",)])
def test_probed_absent(spark, monkeypatch, most, keys):
    """The occurrences of the plain join; surely absent ones aren't shuffled."""
    r = random.Random(5)
    monkeypatch.setattr(subtract, "FILTER_BITS", 1)
    rows = [(i, i % 3, "".join(r.choices("ACGTN", k=200))) for i in range(30)] + [(40, None, "A" * 300), (41, 1, None), (40, None, "A" * 300)]
    df = spark.createDataFrame(rows, "record_idx long, dataset_id long, seq string")
    index = spark.createDataFrame(count.distinct_kmers(df.where("record_idx % 2 = 0"), 9).limit(1500).collect(), "kmer string")
    for d, i in ((df, index), (df, index.where("false")), (df.where("false"), index)):
        got, want = subtract.probed_absent(d, i, 9, *keys, most=most), subtract.absent_windows(d, i, 9, *keys)
        assert got.columns == want.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_count_by_superkmers(spark):
    """What a plain count gives: long runs of one minimizer, both strands, gaps, hot minimizers and none; and a smaller shuffle's one exchange."""
    r = random.Random(6)
    texts = ["A" * 9000, "T" * 50 + "N" + "AC" * 300, "".join(r.choices("ACGT", k=9000)), "", "ACG", None]
    texts += [rc(texts[2][100:400]), texts[2][50:90].lower()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "record_idx long, seq string")
    for k, m, threshold in ((21, 11, 0), (31, 31, 1), (5, 3, 2), (40, 7, 0)):
        want = sorted(map(tuple, count.count_kmers(df, k, threshold).collect()))
        for share, sample in ((0.02, 1.0), (1.1, 1.0), (1 / 128, 0.05)):
            assert sorted(map(tuple, count.count_by_superkmers(df, k, m, threshold, share, sample).collect())) == want
    assert count.hot_minimizers(df, 21, 11, 0.2, 1.0) and not count.hot_minimizers(df, 21, 11, 1.1, 1.0)
    plan = count.count_by_superkmers(df, 21, 11, 0, 1.1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    strings = ["A", "ACGT" * 20, "T" * 31, "G" * 32, "C" * 62, texts[2][:5000]]
    both = spark.createDataFrame([(x,) for x in strings], "s string").select("s", seq.packed("s").alias("p")).select("s", "p", seq.unpacked("p").alias("back"))
    assert all(x["s"] == x["back"] and len(x["p"]) == 8 * -(-len(x["s"]) // 31) for x in both.collect())


def walked_unitigs(kmers):
    """The paths without a branch, by following them; a circle's as a frozenset of its k-mers, as it can be opened anywhere."""
    nodes = {x for m in kmers for x in (m, rc(m))}
    after = lambda x: [x[1:] + b for b in "ACGT" if x[1:] + b in nodes]

    def step(x):
        y = after(x)
        if len(y) != 1 or len(after(rc(y[0]))) != 1 or min(x, rc(x)) == min(y[0], rc(y[0])) or x == rc(x) or y[0] == rc(y[0]):
            return None
        return y[0]

    out, seen = set(), set()
    for x in sorted(nodes):
        if step(rc(x)) is None and x not in seen:
            path = [x]
            while (y := step(path[-1])) is not None:
                path.append(y)
            seen |= set(path) | {rc(y) for y in path}
            text = path[0] + "".join(y[-1] for y in path[1:])
            out.add(min(text, rc(text)))
    return out, {min(x, rc(x)) for x in nodes - seen}


def test_unitigs(spark):
    r, k = random.Random(5), 5
    genome = "".join(r.choices("ACGT", k=3000))
    circle = genome[:400] + genome[: 11 - 1]
    cases = [[genome[i : i + 11] for i in range(len(genome) - 10)], [circle[i : i + 11] for i in range(len(circle) - 10)], ["".join(r.choices("ACGT", k=k)) for _ in range(120)], ["".join(r.choices("ACGT", k=4)) for _ in range(60)], ["AAA", "ACA", "CAC"], ["ACGT"], []]
    for strings in cases:
        kmers = sorted({min(x, rc(x)) for x in strings})
        got = compact.unitigs(spark.createDataFrame([(x,) for x in kmers], "kmer string")).collect()
        paths, circular = walked_unitigs(kmers)
        size = len(kmers[0]) if kmers else 1
        split = [(x, {min(w, rc(w)) for w in (x["seq"][i : i + size] for i in range(len(x["seq"]) - size + 1))}) for x in got]
        assert {min(x["seq"], rc(x["seq"])) for x, own in split if not own & circular} == paths
        assert all(x["kmers"] == len(own) == len(x["seq"]) - size + 1 and x["seed"] in own for x, own in split)
        assert sorted(w for _, own in split for w in own) == kmers  # each k-mer once
        assert {w for _, own in split if own & circular for w in own} == circular


def test_giant_component(spark):
    """A component above the bound has no group: its unitigs are fewer than sequences by minimizer; others are walked as before."""
    r = random.Random(8)
    genome, small = "".join(r.choices("ACGT", k=20_000)), "".join(r.choices("ACGT", k=60))
    kmers = sorted({min(x, rc(x)) for t in (genome, small) for x in (t[i : i + 21] for i in range(len(t) - 20))})
    df = spark.createDataFrame([(x,) for x in kmers], "kmer string")
    got = compact.simplitigs(df, most=1000).collect()
    assert {min(x["seq"], rc(x["seq"])) for x in got} == {min(t, rc(t)) for t in (genome, small)}
    assert len(got) < compact.by_minimizer(df, 11).count()


def test_places(spark):
    from strandweave.operators.chains import places

    n = 5000
    order = random.Random(2).sample(range(n), n)
    links = [(b, a) for a, b in zip(order, order[1:])] + [(n + 1, n), (n + 11, n + 12), (n + 12, n + 13), (n + 13, n + 11), (n + 20, n + 20)]
    done, circles = places(spark.createDataFrame(links, "id long, before long"))
    want = {(b, order[0], i) for i, b in enumerate(order) if i} | {(n + 1, n, 1)}
    assert {tuple(x) for x in done.collect()} == want
    assert {tuple(x) for x in circles.collect()} == {(n + 11, n + 11), (n + 12, n + 11), (n + 13, n + 11), (n + 20, n + 20)}


def test_simplitigs(spark):
    kmers = spark.createDataFrame([("AAA",), ("AAC",), ("ACG",)], "kmer string")
    assert [tuple(r) for r in compact.numbered(compact.simplitigs(kmers), 7).select("idx", "seq", "kmers").collect()] == [(8, "AAACG", 3)]
    r = random.Random(5)
    found = count.distinct_kmers(reads(spark, *["".join(r.choices("ACGT", k=40)) for _ in range(20)]), 5)
    want = sorted(x["kmer"] for x in found.collect())
    for made in (compact.simplitigs(found), compact.by_minimizer(found, 3, 4)):
        assert sorted(x["kmer"] for x in compact.kmers_of(made, 5).collect()) == want
    whole = {a: b for a, b in compact.walk(want)}
    assert {x["seed"]: x["seq"] for x in compact.simplitigs(found).collect()} == whole


def reformed(spark, k, *records, **kw):
    df = spark.createDataFrame([(i, h, s) for i, (h, s) in enumerate(records)], "unitig_id long, header string, seq string")
    return [(r["header"], r["seq"]) for r in reform.reform(df, k, **kw).orderBy("rank").collect()]


def test_reform(spark):
    run = dict(abundance="runs")
    assert reformed(spark, 3, ("a km:f:3.0", "AAACG"), ("b km:f:4.0", "TTTCG"), **run) == [("A km:f:4:3:3:3", "CGAAAACG")]
    assert reformed(spark, 3, ("km:f:2.0", "AAAACG"), ("km:f:5.0", "CGTTT")) == [("A km:f:3", "AAAACGTTT")]
    assert reformed(spark, 3, ("km:f:2:1:3:2", "AAACG"), ("km:f:3:1:4:2", "CGTTT"), **run)[0][0] == "A km:f:2:1:3:3:4:2"
    assert reformed(spark, 3, ("km:f:1:1:2:2", "AAACG"), ("km:f:4:1:5:2", "TTTCG"), **run)[0][0] == "A km:f:5:2:4:1:1:1:2:2"
    assert reformed(spark, 3, ("km:f:1:1:2:1:3:1", "TTTTC"), **run) == [("A km:f:3:1:2:1:1:1", "GAAAA")]
    assert reformed(spark, 3, ("km:f:12.5", "AAAA")) == [("A km:f:13", "AAAA")]
    assert reformed(spark, 3, ("km:f:2.49:1:2.5:2", "AAAAA"), **run) == [("A km:f:2:1:3:2", "AAAAA")]
    parts = reformed(spark, 3, ("", "CCAA"), ("", "AAGG"), ("", "AATT"), mode="unitig", abundance=None)
    assert len(parts) == 3 and sum(len(s) for _, s in parts) == 12
    assert reformed(spark, 5, ("", "TTTTC"), ("", "CCCCG"), abundance=None, sort="sequence-prefix")[0][1] == "CCCCG"


@pytest.mark.parametrize("header, text, message", [("none", "AAAC", "missing"), ("km:f:1:1:2:1", "AAACG", "sum to 2"), ("km:f:NaN", "AAAC", "non-finite"), ("km:f:1", "AA", "shorter than k=3"), ("km:f:1", "AANC", "non-ACGT")])
def test_reform_errors(spark, header, text, message):
    with pytest.raises(Exception, match=message):
        reformed(spark, 3, (header, text))


def test_streaming_matches_batch(spark, tmp_path):
    from strandweave.streaming import presence

    df = spark.createDataFrame([("a", "one two"), ("b", "one two"), ("b", "three")], "dataset_id string, text string")
    df.write.parquet(str(tmp_path / "in"))
    got = presence.presence_of_arrivals(spark, str(tmp_path / "in"), df.schema, 3, 1, "dataset_id", "text")
    want = count.count_datasets(df.select("dataset_id", seq.text_to_dna("text").alias("seq")), 3, 1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_streaming_keeps_no_state(spark, tmp_path):
    """Pairs that come again in a later run count once, and no state store is made."""
    from strandweave.streaming import presence

    table, checkpoint, schema = str(tmp_path / "pairs"), str(tmp_path / "checkpoint"), "dataset_id string, seq string"
    rows = [("a", "AAAACGACG"), ("b", "AAAACGTTT"), (None, "AAAAA"), ("c", None), ("a", "CGTTT")]
    for row in rows:
        spark.createDataFrame([row], schema).write.mode("append").parquet(str(tmp_path / "in"))
        presence.update(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 3, table, checkpoint)
    want = count.count_datasets(spark.createDataFrame(rows, schema), 3, 0)
    assert sorted(map(tuple, presence.counts(spark, table).collect())) == sorted(map(tuple, want.collect())) != []
    assert not (tmp_path / "checkpoint" / "state").exists()


@pytest.mark.parametrize("k", [1, 2, 3, 21, 30, 31])
@pytest.mark.parametrize("sizes", [(1 << 15, 1 << 22), (7, 50)])
def test_packed_numbers(spark, monkeypatch, k, sizes):
    """Counts and presence by packed numbers are those of a walk over the texts: gaps, row edges, other letters, both cases, chunk edges and rows without bases."""
    from strandweave.functions import codes

    r = random.Random(k)
    base = "".join(r.choices("ACGT", k=200))
    texts = ["", None, base, rc(base[20:90]).lower(), "T" * 70, "é" + base[:60] + "é", base[:40] + "\n" + base[40:99], "N" * 5, "A" * (k - 1), base[5 : 5 + k]]
    names = ["x", "y", None, "z", "x", "y", "z", "x", None, "w"]
    counts_, sets = {}, {}
    for name, text in zip(names, texts):
        for run in "".join(c if c in "ACGT" else " " for c in (text or "").replace("é", " ").upper()).split():
            for i in range(len(run) - k + 1):
                w = min(run[i : i + k], rc(run[i : i + k]))
                counts_[w] = counts_.get(w, 0) + 1
                sets.setdefault(w, set()).add(name)
    table = spark.createDataFrame(list(zip(names, texts)), "dataset_id string, seq string").repartition(2)
    chunk, held = sizes
    got, pairs = {}, {}
    monkeypatch.setattr(codes, "CHUNK", chunk)
    monkeypatch.setattr(codes, "HELD", held)
    batch = table.toArrow().to_batches()
    import pyarrow as pa

    rows = pa.Table.from_batches(list(codes._dealt(iter([b.select(["seq"]) for b in batch]), k, None, False)))
    got = codes._summed(rows, 0, False, True, "sums").to_pylist()
    assert {x["kmer"]: x["n"] for x in got} == counts_ and len(got) == len(counts_)
    rows = pa.Table.from_batches(list(codes._dealt(iter(batch), k, None, True)))
    pairs = codes._summed(rows, 1, True, True, "sums").to_pylist()
    assert {x["kmer"]: x["n"] for x in pairs} == {w: n for w, x in sets.items() if (n := len(x - {None})) > 1}
    assert {r["kmer"]: r["count"] for r in count.count_kmers(table, k).collect()} == counts_


def test_no_row_for_each_window(spark):
    """Counts of minimizers and distinct absent k-mers are made without exploding windows."""
    df = spark.createDataFrame([(0, "a", "ACGTTGCAAGGCTTAACC")], "record_idx long, dataset_id string, seq string")
    index = spark.createDataFrame([("ACGTT",)], "kmer string")
    plans = [count.minimizer_counts(df, 7, 3), count.minimizer_presence(df, 7, 3), subtract.subtract_distinct(df, index, 5)]
    assert all("Generate" not in p._jdf.queryExecution().optimizedPlan().toString() for p in plans)


def test_superkmers_make_no_row_for_each_window(spark):
    """Counts by super-k-mers are one grouped exchange of packed stretches."""
    plan = count.count_by_superkmers(reads(spark, "ACGTTGCAAGGCTTAACC"), 7, 3, 0, 1.1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("k, m", [(1, 1), (5, 3), (21, 11), (31, 31)])
@pytest.mark.parametrize("sizes", [(64, 100, 4), (1 << 15, 1 << 22, 1 << 15)])
def test_packed_stretches(monkeypatch, k, m, sizes):
    """Stretches of each bucket hold what a walk over the texts finds, for each key: gaps, row edges, long runs, hot minimizers, buckets sent as numbers, and rare minimizers left out."""
    import numpy as np
    import pyarrow as pa

    from strandweave.functions import codes, stretches

    monkeypatch.setattr(codes, "CHUNK", sizes[0])
    monkeypatch.setattr(codes, "HELD", sizes[1])
    monkeypatch.setattr(stretches, "MANY", sizes[2])
    r = random.Random(k)
    base = "".join(r.choices("ACGT", k=700))
    texts = ["", None, base, rc(base[20:90]).lower(), "T" * 900, "é" + base[:60] + "N", base[:40] + "\n" + base[40:99], "A" * (k - 1), base[5 : 5 + k], "AC" * 300]
    names = ["x", "y", None, "z", "x", "y", "z", "x", None, "w"]
    want, keyed = {}, {}
    for name, text in zip(names, texts):
        for run in "".join(c if c in "ACGT" else " " for c in (text or "").upper()).split():
            for i in range(len(run) - k + 1):
                w = min(run[i : i + k], rc(run[i : i + k]))
                want[w] = want.get(w, 0) + 1
                keyed[name, w] = keyed.get((name, w), 0) + 1
    batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["key", "seq"])
    parts = [batch.slice(0, 3), batch.slice(3)]
    poly = codes.mixed(codes.canonical(np.zeros(m, np.uint8), m))
    for hot, whole in ((poly[:0], False), (poly, False), (poly, True)):
        rows = pa.Table.from_batches(list(stretches._packed(iter(p.select(["seq"]) for p in parts), k, m, hot, False, whole)))
        got = {}
        for bucket in set(rows.column("bucket").to_pylist()):
            numbers, n = stretches.counted(rows.filter(pa.compute.equal(rows.column("bucket"), bucket)), k, 1, m if whole else None)
            for kmer, x in zip(codes.letters_of(numbers).to_pylist(), n.tolist()):
                assert kmer not in got
                got[kmer] = x
        assert got == {w: n for w, n in want.items() if n > 1}
    rows = pa.Table.from_batches(list(stretches._packed(iter(parts), k, m, poly[:0], True)))
    got = {}
    for key, bucket in set(zip(rows.column("key").to_pylist(), rows.column("bucket").to_pylist())):
        mine = [a == key and b == bucket for a, b in zip(rows.column("key").to_pylist(), rows.column("bucket").to_pylist())]
        numbers, n = stretches.counted(rows.filter(pa.array(mine)), k)
        got |= {(key, w): x for w, x in zip(codes.letters_of(numbers).to_pylist(), n.tolist())}
    assert got == keyed


def test_prefilter_makes_no_row_for_each_window(spark):
    """Rare minimizers are left out where stretches meet; k above 31 and k = m give the plain counts as well."""
    r = random.Random(9)
    base = "".join(r.choices("ACGT", k=3000))
    df = reads(spark, base, rc(base[100:900]), base[300:1500].lower() + "N" + "A" * 2000, "", None, "AC" * 700)
    for k, m, threshold in ((21, 11, 2), (21, 11, 0), (7, 7, 1), (40, 11, 1)):
        want = sorted(map(tuple, count.count_kmers(df, k, threshold).collect()))
        assert sorted(map(tuple, count.prefiltered_counts(df, k, m, threshold).collect())) == want != []
    plan = count.prefiltered_counts(df, 21, 11, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_runs_without_shuffle(spark):
    """Runs are found in a record's row; equal ids don't mix, keys keep their type, and k above 31 gives what a walk gives."""
    text = "A" * 5000 + "N" + "ACGTTGCAAGGCTTAACCGG" * 3
    df = spark.createDataFrame([("x", text), ("x", text), (None, text[:30])], "name string, seq string")
    runs = count.superkmers(df, 7, 3, "name")
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and dict(runs.dtypes) == {"name": "string", "frag": "int", "start": "int", "windows": "bigint", "minimizer": "string"}
    rows = [tuple(x) for x in runs.collect()]
    assert rows.count(("x", 0, 0, 4994, "AAA")) == 2 and (None, 0, 0, 24, "AAA") in rows
    long = [tuple(x) for x in count.superkmers(df.limit(1), 40, 3, "name").collect()]
    assert sum(x[3] for x in long) == 5000 - 39 + 60 - 39


def test_scan_makes_no_row_for_each_window(spark):
    df = reads(spark, "ACGTTGCAANACGNTTGACCATG", "acgttgca", "", None, "NNN")
    for k, m in ((5, 3), (3, 3), (40, 5)):
        runs, frags = count.superkmers(df, k, m).collect(), seq.fragments(df, k, "record_idx").collect()
        want = (len(frags), sum(len(f["seq"]) for f in frags) or None, len(runs), sum(x["windows"] for x in runs) or None)
        assert tuple(count.scanned(df, k, m).first()) == want
    assert tuple(count.scanned(df.where("false"), 5, 3).first()) == (0, None, 0, None)
    assert "Generate" not in count.scanned(df, 5, 3)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("k", [1, 5, 21])
def test_sent_index_is_like_the_join(spark, monkeypatch, k):
    """Segments and sums of an index that is sent are those of the joined one: gaps, both cases, rows without bases, twice and without an id, no index."""
    from strandweave.functions import marks

    r = random.Random(k)
    base = "".join(r.choices("ACGTN", [9, 9, 9, 9, 1], k=6000))
    rows = [(1, "a", base), (2, "a", rc(base.replace("N", "G"))[:900].lower()), (3, None, ""), (4, "b", None), (None, None, "é" + base[50:400]), (6, "b", "A" * 300), (6, "b", "A" * 300), (7, "c", "ACNGT")]
    df = spark.createDataFrame(rows, "record_idx long, dataset_id string, seq string")
    known = {min(w, rc(w)) for w in (base[i : i + k] for i in range(0, 3000, 7)) if "N" not in w}
    index = spark.createDataFrame([(w,) for w in sorted(known)[: 1 if k == 1 else None]], "kmer string")
    for i in (index, index.where("false")):
        got = [subtract.segments(df, i, k), subtract.stats(df, i, k), subtract.stats(df, i, k, "dataset_id"), subtract.stats(df, i, k, "record_idx", "dataset_id"), subtract.stats(df.where("false"), i, k)]
        assert all("Generate" not in x._jdf.queryExecution().optimizedPlan().toString() for x in got)
        with monkeypatch.context() as joined:
            joined.setattr(marks, "SENT", -1)
            want = [subtract.segments(df, i, k), subtract.stats(df, i, k), subtract.stats(df, i, k, "dataset_id"), subtract.stats(df, i, k, "record_idx", "dataset_id"), subtract.stats(df.where("false"), i, k)]
        for x, y in zip(got, want):
            assert x.dtypes == y.dtypes and sorted(map(repr, x.collect())) == sorted(map(repr, y.collect()))


def test_probe_makes_no_row_for_each_window(spark):
    """Windows are looked up in the filter as numbers, whether the key is text, a number or none."""
    df = spark.createDataFrame([(0, "a", "ACGTTGCAAGGCTTAACC"), (1, None, "AAAAAAAAN"), (2, "a", None), (3, "b", "AC")], "record_idx long, dataset_id string, seq string")
    index = spark.createDataFrame([("AAAAA",), ("ACGTT",)], "kmer string")
    for keys in ((), ("dataset_id",), ("record_idx",)):
        got, want = subtract.probed_stats(df, index, 5, *keys), subtract.stats(df, index, 5, *keys)
        assert got.dtypes == want.dtypes and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()

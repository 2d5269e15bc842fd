"""Sources, sinks, names and the tools over files."""

import gzip
import lzma
import struct

import pytest
import zstandard

from strandweave.plans import tools
from strandweave.sources import fastx, sinks


def put(path, text):
    data = text.encode()
    kind = fastx.codec_of(str(path))
    path.write_bytes({"gzip": gzip.compress, "xz": lzma.compress, "zstd": zstandard.ZstdCompressor().compress}.get(kind, bytes)(data))
    return str(path)


@pytest.mark.parametrize("name", ["a.fa", "a.fa.gz", "a.fa.xz", "a.fa.zst"])
def test_fasta(spark, tmp_path, name):
    p = put(tmp_path / name, ">r1 km:f:2 x\nAAA\nCC\n\n>r2\nGG>T\n")
    assert [tuple(r) for r in fastx.read_fastx(spark, [p]).select("record_idx", "header", "seq").orderBy("record_idx").collect()] == [(0, "r1 km:f:2 x", "AAACC"), (1, "r2", "GG>T")]


def test_fastq(spark, tmp_path):
    p = put(tmp_path / "a.fastq", "@r1\nACGT\nAC\n+\n@@>>\n>@\n@r2\nTT\n+r2\nII\n")
    assert [r["seq"] for r in fastx.read_fastx(spark, [p]).orderBy("record_idx").collect()] == ["ACGTAC", "TT"]


def test_invalid(spark, tmp_path):
    bad, good = put(tmp_path / "bad.txt", "hello"), put(tmp_path / "good.fa", ">a\nAAA\n")
    assert fastx.read_fastx(spark, [bad, good], "skip").count() == 1
    with pytest.raises(Exception, match="Invalid record start"):
        fastx.read_fastx(spark, [bad]).count()


def test_fofn(tmp_path):
    (tmp_path / "list").write_text("# x\n\nb.fa\n/abs/c.fa\nb.fa\n")
    assert fastx.expand_fofns([str(tmp_path / "list")]) == [str(tmp_path / "b.fa"), "/abs/c.fa", str(tmp_path / "b.fa")]
    (tmp_path / "none").write_text("#\n")
    with pytest.raises(ValueError):
        fastx.expand_fofns([str(tmp_path / "none")])


@pytest.mark.parametrize("name, suffix, want", [("sample.fa.zst", "filtered", "sample.filtered.fa.zst"), ("sample.fastq.gz", ".clean", "sample.clean.fastq.gz"), ("sample.unitigs.fna.xz", "left", "sample.unitigs.left.fna.xz"), ("sample", "filtered", "sample.filtered")])
def test_names(name, suffix, want):
    assert sinks.suffixed(name, suffix) == want


def test_counter(spark, tmp_path):
    p = put(tmp_path / "a.fa", ">a\nAAACG\n")
    assert tools.counter(spark, [p], 3, str(tmp_path / "o.fa.gz"), threshold=0) == 1
    assert gzip.open(tmp_path / "o.fa.gz").read() == b">MC_simplitig_1 kmers=3\nAAACG\n"
    assert tools.counter(spark, [p], 3, str(tmp_path / "o.kff"), threshold=0, fmt="kff") == 3
    kff = (tmp_path / "o.kff").read_bytes()
    assert kff[:8] == b"KFF" + bytes([1, 0, 0x1B, 1, 1]) and kff[-3:] == b"KFF"
    size = struct.unpack(">I", kff[8:12])[0]
    assert b"k=3\n" in kff[12 : 12 + size] and kff[12 + size : 13 + size] == b"v"
    assert kff[-3 - 3 * 2 - 8 : -3] == struct.pack(">Q", 3) + bytes([0, 1, 1, 1, 6, 1])
    (tmp_path / "list").write_text("a.fa\na.fa\n")
    assert tools.counter(spark, [str(tmp_path / "list")], 3, str(tmp_path / "d.fa"), threshold=1, fofn=True) == 1


def test_subtractor_and_reformer(spark, tmp_path):
    index, query = put(tmp_path / "i.fa", ">i\nAAACG\n"), put(tmp_path / "q.fa", ">q\nAAATG\n")
    assert tools.subtractor(spark, index, [query], 3, str(tmp_path / "o.fa")) == 1
    assert (tmp_path / "o.fa").read_text() in (">MC_simplitig_1 kmers=2\nAATG\n", ">MC_simplitig_1 kmers=2\nCATT\n")
    units = put(tmp_path / "u.fa", ">a km:f:3.0\nAAACG\n>b km:f:4.0\nTTTCG\n")
    tools.reformer(spark, units, 3, str(tmp_path / "r.fa"), abundance="runs")
    assert (tmp_path / "r.fa").read_text() == ">A km:f:4:3:3:3\nCGAAAACG\n"


def test_pipeline(spark, tmp_path):
    index, query = put(tmp_path / "i.fa", ">i\nAAACG\n"), put(tmp_path / "q.fa", ">query\nAAATG\n")
    s = tools.pipeline(spark, [index], [query], 3, threshold=0, output=str(tmp_path / "o.fa"), mode="regular")[0]
    assert (s.scanned, s.filtered, s.not_filtered, s.nucleotides) == (3, 1, 2, 4)
    assert (tmp_path / "o.fa").read_text() == ">query\nAATG\n"
    s = tools.pipeline(spark, [index], [query], 3, threshold=0, mode="no-output")[0]
    assert s.lines()[0] == "STAT\tquery_kmers_scanned\t3" and s.nucleotides is None
    tools.pipeline(spark, [index], [query], 3, threshold=0, suffix="left", reform_output=True)
    assert (tmp_path / "q.left.fa").read_text().startswith(">A\n")
    with pytest.raises(ValueError):
        tools.pipeline(spark, [index], [query], 4)


def test_statistics(spark, tmp_path, capsys):
    index, query = put(tmp_path / "i.fa", ">i\nAAACG\n"), put(tmp_path / "q.fa.gz", ">query\nAAATGAAATG\n")
    bad = put(tmp_path / "bad.fa", "hello")
    one = tools.pipeline(spark, [index, bad], [query], 3, threshold=0, output=str(tmp_path / "o.fa"), mode="regular")[0]
    assert one.lines()[3] == "STAT\tquery_regular_output_nucleotides\t10"
    two = tools.pipeline(spark, [index], [query], 3, threshold=0, output=str(tmp_path / "s.fa"))[0]
    assert two.unique == 4 and two.lines()[3] == "STAT\tquery_unique_kmers_not_filtered_by_zi\t4" and tools.QueryStats(1234567).lines()[0].endswith("\t1,234,567")
    said = capsys.readouterr().err.splitlines()
    assert any(x.startswith("WARN\tskipped_invalid_fastx_input\tpath\t") and "bad.fa" in x for x in said)
    assert f"OUTPUT\t{query}\t{tmp_path / 'o.fa'}" in said and any(x.startswith("phase1 kmer count ") and x.endswith("MB RAM") for x in said)
    (tmp_path / "list").write_text("i.fa\n")
    assert tools.pipeline(spark, [str(tmp_path / "list")], [query], 3, threshold=1, mode="no-output", index_fofn=True)[0].filtered == 0
    assert "index_fofn_threshold_excludes_all_kmers" in capsys.readouterr().err
    with pytest.raises(ValueError, match="k must be in 1..32"):
        tools.pipeline(spark, [str(tmp_path / "list")], [query], 33, mode="no-output", index_fofn=True)
    with pytest.raises(ValueError, match="threshold"):
        tools.pipeline(spark, [index], [query], 3, threshold=255, mode="no-output")
    with pytest.raises(ValueError, match="m must be"):
        tools.counter(spark, [index], 3, str(tmp_path / "x.fa"), m=0)
    assert [tools.phase_name(x) for x in ("2_kmer_counting", "1a_other", "total", "odd_name")] == ["phase2 kmer count", "phase1a other", "total", "odd_name"]


def kff_counts(path, k, size):
    """Counts behind the packed k-mers of the file's section."""
    data, width = path.read_bytes(), -(-k // 4) + size
    body = data[:-3]
    for n in range(1, 100):
        at = len(body) - n * width - 9
        if body[at : at + 1] == b"r" and struct.unpack(">Q", body[at + 1 : at + 9])[0] == n:
            return [int.from_bytes(body[at + 9 + i * width + width - size : at + 9 + (i + 1) * width], "big") for i in range(n)]


def test_kff_sizes(spark, tmp_path):
    """Eight bytes above k = 32, four for datasets, as asked below."""
    seq = "ACGTTGCAAGGCTTAACCGGATCGATTTACGGCAT"
    p = put(tmp_path / "a.fa", f">a\n{seq}\n>b\n{seq}\n")
    tools.counter(spark, [p], 33, str(tmp_path / "o.kff"), threshold=0, fmt="kff")
    assert kff_counts(tmp_path / "o.kff", 33, 8) == [2, 2, 2]
    (tmp_path / "list").write_text("a.fa\na.fa\na.fa\n")
    tools.counter(spark, [str(tmp_path / "list")], 31, str(tmp_path / "d.kff"), threshold=2, fmt="kff", fofn=True)
    assert kff_counts(tmp_path / "d.kff", 31, 4) == [3] * 5
    rows = spark.createDataFrame([("AAC", 7), ("AAA", 300)], "kmer string, count long")
    assert sinks.write_kff(rows, str(tmp_path / "l.kff"), 3, data_size=8, ordered=True) == 2 and kff_counts(tmp_path / "l.kff", 3, 8) == [300, 7]


def test_kmer_outputs(spark, tmp_path):
    p = put(tmp_path / "a.fa", ">a\nAAACGAAA\n")
    assert tools.counter(spark, [p], 3, str(tmp_path / "c.fa"), threshold=1, fmt="counts") == 1
    assert (tmp_path / "c.fa").read_text() == ">MC_kmer_1 count=2\nAAA\n"
    index = put(tmp_path / "i.fa", ">i\nACG\n")
    assert tools.subtractor(spark, index, [p], 3, str(tmp_path / "d.fa"), kmers="distinct") == 4
    assert tools.subtractor(spark, index, [p], 3, str(tmp_path / "e.fa"), kmers="all") == 5
    assert tools.counter(spark, [p], 3, str(tmp_path / "m.fa"), threshold=0, compaction="minimizer") >= 1


@pytest.mark.parametrize("name", ["o.fa", "o.fa.gz", "o.fa.xz", "o.fa.zst"])
def test_writers(spark, tmp_path, name):
    sinks.write_records([("a", "ACGT" * 30)], str(tmp_path / name), zstd_workers=2)
    back = fastx.read_fastx(spark, [str(tmp_path / name)]).first()
    assert (back["header"], back["seq"]) == ("a", "ACGT" * 30)
    sinks.copy(str(tmp_path / "o.fa") if name == "o.fa" else put(tmp_path / "in.fa", ">x\nAC\n"), str(tmp_path / ("copy-" + name)))
    assert fastx.read_fastx(spark, [str(tmp_path / ("copy-" + name))]).count() == 1


def test_output_errors(tmp_path):
    a, b = str(tmp_path / "x" / "q.fa"), str(tmp_path / "y" / "q.fa")
    assert sinks.plan_outputs([a], str(tmp_path / "out")) == [str(tmp_path / "out" / "q.filtered.fa")]
    with pytest.raises(ValueError, match="one output"):
        sinks.plan_outputs([a, b], str(tmp_path / "out"))
    (tmp_path / "file").write_text("")
    with pytest.raises(ValueError, match="no directory"):
        sinks.plan_outputs([a], str(tmp_path / "file"))
    with pytest.raises(ValueError, match="is an input"):
        sinks.plan_outputs([a, str(tmp_path / "x" / "q.filtered.fa")], None)
    assert [sinks.zstd_workers(*x) for x in ((3, 8), (0, 8), (0, 40), (0, 1), (0, None))] == [3, 8, 16, 0, 0]


def test_large_file_streams(spark, tmp_path):
    """Records of one file come in several batches; its content is no column."""
    p = put(tmp_path / "big.fa.gz", "".join(f">r{i}\n{'ACGT' * 50_000}\n" for i in range(60)))
    reads = fastx.read_fastx(spark, [p])
    assert "content" not in reads._jdf.queryExecution().executedPlan().toString()
    assert reads.where("length(seq) = 200000").count() == 60


def test_minimizer_orders(spark):
    from strandweave.functions import seq

    frags = spark.createDataFrame([(0, "ACGTTGCAAGGCTTAACC")], "frag int, seq string")
    best = {"lexicographic": lambda x: x, "anti-lexicographic": lambda x: (-ord(x[0]), x)}
    for order, key in best.items():
        for r in seq.minimizer_windows(frags, 7, 3, order=order).collect():
            mers = [min(m, m.translate(str.maketrans("ACGT", "TGCA"))[::-1]) for m in (r["kmer"][i : i + 3] for i in range(5))]
            assert r["minimizer"] == min(mers, key=key)
    hashed = {(r["kmer"], r["minimizer"]) for r in seq.minimizer_windows(frags, 7, 3, order="hash").collect()}
    assert len({k for k, _ in hashed}) == len(hashed)
    with pytest.raises(ValueError):
        seq.minimizer_windows(frags, 7, 3, order="other")


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert tools.parser().parse_args(["count", "-i", "a", "-k", "3"]).threshold == 1


def test_invalid_files_of_other_stores(spark, tmp_path, monkeypatch):
    """Where no stream can be opened, files come whole through Spark; those that are no sequences are told there, too."""
    (tmp_path / "good.fa").write_text(">a\nACGT\n")
    (tmp_path / "bad.fa").write_text("no sequences\n")
    paths = [str(tmp_path / n) for n in ("good.fa", "bad.fa")]
    want = [p for p in fastx.invalid(spark, paths)]
    monkeypatch.setattr(fastx, "streams", lambda paths: False)
    assert fastx.invalid(spark, paths) == want and want[0].endswith("bad.fa")
    assert [r["seq"] for r in fastx.read_fastx(spark, paths, "skip").collect()] == ["ACGT"]


@pytest.mark.parametrize("ext", ["fa", "fa.gz"])
def test_parts_are_the_file(spark, tmp_path, ext, request):
    """Parts in name order are what the single file holds, for each kind of FASTA output."""
    import random

    few = "spark.sql.adaptive.coalescePartitions.enabled"
    request.addfinalizer(lambda: spark.conf.unset(few))
    spark.conf.set(few, "false")
    r = random.Random(3)
    rows = [("".join(r.choices("ACGT", k=r.choice([7, 80, 81, 160, 500]))), i) for i in range(300)]
    df = spark.createDataFrame(rows, "seq string, i long").repartition(5)
    kinds = {
        "simplitigs": lambda p, **kw: sinks.write_simplitigs(df.selectExpr("seq AS seed", "seq"), p, 7, start=4, **kw),
        "counts": lambda p, **kw: sinks.write_counts(df.selectExpr("seq AS kmer", "i AS count"), p, **kw),
        "kmers": lambda p, **kw: sinks.write_kmers(df.selectExpr("seq AS kmer"), p, **kw),
        "segments": lambda p, **kw: sinks.write_segments(df.selectExpr("'x.fa' AS path", "i div 10 AS record_idx", "i % 10 AS frag", "0 AS start", "concat('r ', i) AS header", "seq"), p, **kw),
        "reformed": lambda p, **kw: sinks.write_reformed(df.selectExpr("i + 1 AS rank", "'A km:f:3' AS header", "seq"), p, **kw),
        "none": lambda p, **kw: sinks.write_kmers(df.where("false").selectExpr("seq AS kmer"), p, **kw),
    }
    plain = (lambda b: b"".join(gzip.decompress(x) for x in b)) if ext.endswith("gz") else b"".join
    for name, write in kinds.items():
        one, many = tmp_path / f"{name}.{ext}", tmp_path / f"{name}-parts.{ext}"
        assert write(str(one)) == write(str(many), parts=True)
        parts = sorted(many.glob("part-*"))
        assert plain([x.read_bytes() for x in parts]) == plain([one.read_bytes()])
        assert name == "none" or len(parts) > 1
    with pytest.raises(ValueError):
        kinds["kmers"](str(tmp_path / "x.fa.xz"), parts=True)

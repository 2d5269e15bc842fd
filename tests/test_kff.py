"""KFF as a data source: bytes as those of the single file, round trips, ranges, and what is refused."""

import random
import struct

import pytest

from strandweave.plans import tools
from strandweave.sources import kff, sinks

SCHEMA = "kmer string, count long"


def table(spark, k, n, top=250, seed=1):
    r = random.Random(seed)
    rows = {"".join(r.choices("ACGT", k=k)): r.randint(0, top) for _ in range(n)}
    return spark.createDataFrame(sorted(rows.items()), SCHEMA).repartition(3)


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("k, size", [(3, 8), (21, None), (31, 4), (32, 1), (33, None), (70, 8)])
def test_bytes_are_the_single_file(spark, tmp_path, k, size):
    df = table(spark, k, 200).coalesce(1)
    one, many = tmp_path / "o.kff", tmp_path / "parts"
    assert sinks.write_kff(df, str(one), k, 2, 3, size) == df.count()
    assert kff.write(df.repartition(1), str(many), k, 2, 3, size) == df.count()
    assert [p.read_bytes() for p in many.glob("*.kff")] == [one.read_bytes()]
    assert same(kff.read(spark, str(one)), kff.read(spark, str(many)))


@pytest.mark.parametrize("section", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("split", [1, 50, 1 << 20])
def test_ranges_and_sections(spark, tmp_path, section, split):
    """Each record is read once, wherever the ranges' edges are."""
    df = table(spark, 9, 60 if split == 1 else 300, 1 << 40).coalesce(1)
    n = kff.write(df, str(tmp_path / "t"), 9, data_size=8, section=section)
    source = kff.KffReader({"path": str(tmp_path / "t"), "split": split})
    got = [tuple(r.values()) for part in source.partitions() for b in source.read(part) for r in b.to_pylist()]
    assert n == len(got) and sorted(got) == sorted(map(tuple, df.collect()))
    assert got == sorted(got)  # parts in order of their names are in order


def test_append_overwrite_and_leftovers(spark, tmp_path):
    a, b = table(spark, 5, 40, seed=1), table(spark, 5, 40, seed=2)
    path = tmp_path / "t"
    kff.write(a, str(path), 5, data_size=8)
    kff.write(b, str(path), 5, data_size=8)
    assert same(kff.read(spark, str(path)), a.union(b))
    kff.write(b, str(path), 5, data_size=8, mode="overwrite")
    assert same(kff.read(spark, str(path)), b)
    bad = b.union(spark.createDataFrame([("AAAAN", 1)], SCHEMA))
    with pytest.raises(Exception, match="A, C, G and T"):
        kff.write(bad, str(path), 5, data_size=8)
    assert same(kff.read(spark, str(path)), b) and not list(path.glob("_made-*"))


@pytest.mark.parametrize("row, size, message", [(("AAA", 256), 1, "fit 1 bytes"), (("AAA", -1), 8, "fit 8 bytes"), (("AA", 1), 8, "3 bases"), (("AAAA", 1), 8, "3 bases"), ((None, 1), 8, "null"), (("AAA", None), 8, "null"), (("aaa", 1), 8, "A, C, G")])
def test_refused_rows(spark, tmp_path, row, size, message):
    with pytest.raises(Exception, match=message):
        kff.write(spark.createDataFrame([row], SCHEMA), str(tmp_path / "t"), 3, data_size=size)


def test_empty_table_and_extra_columns(spark, tmp_path):
    df = table(spark, 4, 20)
    assert kff.write(df.where("false"), str(tmp_path / "none"), 4) == 0
    assert kff.read(spark, str(tmp_path / "none")).count() == 0
    assert kff.write(df.selectExpr("1 AS path", "count", "2 AS section", "kmer"), str(tmp_path / "t"), 4, data_size=2) == df.count()
    assert same(kff.read(spark, str(tmp_path / "t")), df)


def test_files_of_other_writers(spark, tmp_path):
    """Another code of the bases, values that change between sections, no data; what is not read is told."""
    values = lambda **v: b"v" + struct.pack(">Q", len(v)) + b"".join(n.encode() + b"\0" + struct.pack(">Q", x) for n, x in v.items())
    start = b"KFF" + bytes([1, 0, 0b00011110, 1, 1]) + struct.pack(">I", 2) + b"hi"  # A 0, C 1, G 3, T 2
    body = values(k=4, max=1, data_size=0) + b"r" + struct.pack(">Q", 1) + bytes([0b00011110]) + values(k=2, max=1, data_size=2) + b"r" + struct.pack(">Q", 1) + bytes([0b1011, 1, 2])
    path = tmp_path / "a.kff"
    path.write_bytes(start + body + b"KFF")
    assert sorted(map(tuple, kff.read(spark, str(path)).collect())) == [("ACGT", 0), ("TG", 258)]
    for bad, message in ((start + body, "ends within"), (b"KFX" + start[3:] + body + b"KFF", "not a KFF"), (start + values(k=4, max=3, data_size=0) + b"r", "not read"), (start + b"i", "not read"), (start + body[:-1], "ends within"), (start + body + b"KXX", "no end mark")):
        path.write_bytes(bad)
        with pytest.raises(Exception, match=message):
            kff.read(spark, str(path)).collect()
    with pytest.raises(Exception, match="no KFF file"):
        kff.read(spark, str(tmp_path / "missing")).collect()


def test_counter_writes_parts(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a\nACGTTGCAAGGCTTAACC\n>b\nACGTTGCAAGGCTTAACC\n")
    for fofn in (False, True):
        (tmp_path / "list").write_text("a.fa\na.fa\na.fa\n")
        inputs = [str(tmp_path / ("list" if fofn else "a.fa"))]
        one, many = str(tmp_path / f"{fofn}.kff"), str(tmp_path / f"{fofn}-parts")
        n = tools.counter(spark, inputs, 7, one, threshold=1, fmt="kff", fofn=fofn)
        assert n > 0 and tools.counter(spark, inputs, 7, many, threshold=1, fmt="kff", fofn=fofn, parts=True) == n
        assert same(kff.read(spark, one), kff.read(spark, many))

"""Ranges of a sequence file, read by many tasks, give what one task gives, wherever the file is split."""

import random

import pytest

from strandweave.sources import fastx


def fasta(r, n, newline="\n"):
    out = []
    for i in range(n):
        s = "".join(r.choices("ACGTN", k=r.choice([0, 1, 5, 40, 300])))
        out.append(f">rec{i} x>y @z{newline}" + "".join(s[j : j + 60] + newline for j in range(0, len(s), 60)))
    return "".join(out)


def fastq(r, n):
    """Qualities may begin like a header or like the line before them."""
    out = []
    for i in range(n):
        s = "".join(r.choices("ACGTN", k=r.choice([1, 2, 30, 100])))
        q = r.choice("@+>I") + "".join(r.choices("@+I>5", k=len(s) - 1))
        out.append(f"@read{i} @x\n{s}\n+{r.choice(['', 'again'])}\n{q}\n")
    return "".join(out)


def folded(r, n):
    """FASTQ whose sequences and qualities take several lines; some of the qualities look like records of four lines."""
    trap = "@AA\nACGT\n+\nIIII\nII\n"
    return "".join(f"@read{i}\nACGTACGT\nACGTAC\n+\n{r.choice([trap, 'I' * 14 + chr(10)])}" for i in range(n))


def wanted(path):
    return [(i, h, s) for i, (h, s) in enumerate(fastx.parse(fastx.lines_of(str(path), None)))]


def got(spark, path, split):
    return [tuple(x)[1:] for x in fastx.read_fastx(spark, [str(path)], split=split).orderBy("record_idx").collect()]


@pytest.mark.parametrize("name, make", [("a.fa", fasta), ("crlf.fa", lambda r, n: fasta(r, n, "\r\n")), ("a.fq", fastq), ("blank.fq", lambda r, n: "\n\n" + fastq(r, n) + "\n\n")])
def test_ranges_at_every_byte(tmp_path, name, make):
    """The ranges of every split point tile the file's records, and agree at their edge."""
    path = tmp_path / name
    path.write_bytes(make(random.Random(name), 12).encode())
    size, whole = path.stat().st_size, len(wanted(path))
    for at in range(4, size):
        _, n, after, odd = fastx.scanned(str(path), 0, at)
        found, m, end, odd_too = fastx.scanned(str(path), at, size)
        assert not odd and not odd_too and n + m == whole
        assert after == (size if found is None else found)


@pytest.mark.parametrize("name, make", [("a.fa", fasta), ("crlf.fa", lambda r, n: fasta(r, n, "\r\n")), ("mac.fa", lambda r, n: fasta(r, n, "\r")), ("a.fq", fastq), ("folded.fq", folded)])
@pytest.mark.parametrize("split", [97, 1000])
def test_read_in_ranges(spark, tmp_path, name, make, split):
    path = tmp_path / name
    path.write_bytes(make(random.Random(name), 60).encode())
    assert got(spark, path, split) == wanted(path)


def test_spans(spark, tmp_path):
    """A file that can't be split safely is one span; so are small and compressed ones. One long line takes no task a range for itself."""
    r = random.Random(2)
    (tmp_path / "a.fq").write_text(fastq(r, 60))
    (tmp_path / "folded.fq").write_text(folded(r, 60))
    (tmp_path / "small.fa").write_text(">a\nACGT\n")
    (tmp_path / "line.fa").write_text(">a\n" + "ACGT" * 1000 + "\n>b\nAC\n")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    rows = fastx.spans(files, 500).collect()
    n = lambda name: [(x["end"] is None, x["first"]) for x in sorted(rows, key=lambda x: x["start"]) if x["path"].endswith("/" + name)]
    assert n("small.fa") == n("folded.fq") == [(True, 0)]
    assert n("line.fa") == [(False, 0), (False, 1)]
    assert len(n("a.fq")) > 5 and not any(whole for whole, _ in n("a.fq"))


def test_not_sequences(spark, tmp_path):
    (tmp_path / "x.txt").write_text("no sequence\n" * 100)
    assert fastx.read_fastx(spark, [str(tmp_path / "x.txt")], "skip", split=50).collect() == []
    with pytest.raises(Exception, match="Invalid record start"):
        fastx.read_fastx(spark, [str(tmp_path / "x.txt")], split=50).collect()

"""DNA as columns: strand, canonical k-mers, windows, minimizers, sort keys.

K-mers are strings: A < C < G < T is both their order as text and as 2-bit numbers, so ``least`` is the canonical choice
for any k. Windows are cut from binary pieces, where a slice costs its own length only, and a piece's reverse
complement is made once, not once per window. Every array that a lambda indexes is the output of a generator,
so no plan rule can move its making into the lambda.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 4096


def of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Text to DNA for tables without sequences: letter number i of either case is 'ACGT'[i mod 4], a space is A, the rest are gaps.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ "
BASES = "".join("ACGT"[i % 4] for i in range(26)) * 2 + "A"


def text_to_dna(c: str | Column) -> Column:
    return F.translate(of(c), LETTERS, BASES)


def reverse_complement(c: str | Column) -> Column:
    return F.reverse(F.translate(of(c), "ACGT", "TGCA"))


def canonical(c: str | Column) -> Column:
    return F.least(of(c), reverse_complement(c))


def encode(c: str | Column) -> Column:
    """2-bit number, first base highest, as decimal text (k up to 32)."""
    return F.conv(F.translate(F.upper(of(c)), "ACGT", "0123"), 4, 10)


def decode(number: str | Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(of(number), 10, 4), k, "0"), "0123", "ACGT")


def ac_count(c: str | Column) -> Column:
    return (F.length(of(c)) - F.length(F.translate(of(c), "AC", ""))).cast("long")


def ac_density(c: str | Column) -> Column:
    """A and C bases in a million, rounded down."""
    return F.floor(ac_count(c) * 1_000_000 / F.length(of(c))).cast("long")


def prefix_key(c: str | Column, n: int = 32) -> Column:
    return F.rpad(F.substring(of(c), 1, n), n, "A")


def suffix_key(c: str | Column, n: int = 32) -> Column:
    return F.rpad(F.right(of(c), F.lit(n)), n, "A")


def prefix_suffix_key(c: str | Column) -> Column:
    """The first 16 bases and the first 16 of the last 32."""
    return F.concat(F.substring(prefix_key(c), 1, 16), F.substring(suffix_key(c), 1, 16))


def fragments(reads: DataFrame, k: int, *keys: str, seq: str = "seq") -> DataFrame:
    """keys, frag (number of the run of bases in its record), seq: runs of ACGT of at least k bases."""
    runs = F.regexp_extract_all(F.translate(F.coalesce(F.col(seq), F.lit("")), "acgt", "ACGT"), F.lit("([ACGT]+)"), F.lit(1))
    return reads.select(*keys, F.posexplode(runs).alias("frag", "seq")).where(F.length("seq") >= k)


def pieces(frags: DataFrame, k: int, *keys: str, both: bool = False) -> DataFrame:
    """A row for each PIECE windows of a fragment: start, f (bases) and, with ``both``, r (reverse complement) as binary.

    A long fragment is cut by one regular expression into PIECE bases each, and a piece takes the k-1 next ones from its neighbour; cutting
    each piece from the whole fragment would read the fragment once for each of them."""
    chunks = F.when(F.length("seq") < PIECE + k, F.array("seq")).otherwise(F.regexp_extract_all("seq", F.lit(f"[ACGT]{{1,{PIECE}}}"), F.lit(0)))

    def piece(i: Column) -> Column:
        after = F.concat(*[F.coalesce(F.get("c", i + n), F.lit("")) for n in range(1, 2 + (k - 2) // PIECE)])
        part = F.concat(F.get("c", i), F.substring(after, 1, k - 1))
        return F.struct((i * PIECE).alias("start"), part.cast("binary").alias("f"), *([reverse_complement(part).cast("binary").alias("r")] if both else []))

    cut = frags.select(*keys, F.explode(F.array(chunks)).alias("c"))
    return cut.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 1), piece)).alias("p")).select(*keys, "p.*").where(F.octet_length("f") >= k)


def _slices(k: int) -> Column:
    """Canonical k-mers of a piece's windows, in order."""
    n = F.octet_length("f")
    window = lambda i: F.least(F.substring(F.col("f"), i, F.lit(k)), F.substring(F.col("r"), n - k + 2 - i, F.lit(k)))
    return F.transform(F.sequence(F.lit(1), n - k + 1), window)


def windows(frags: DataFrame, k: int, *keys: str, place: bool = False) -> DataFrame:
    """keys, kmer (canonical) and with ``place`` pos, the window's start, of every window; the sequence itself is not carried along."""
    p = pieces(frags, k, *keys, both=True)
    if not place:
        return p.select(*keys, F.explode(_slices(k)).alias("kmer")).withColumn("kmer", F.col("kmer").cast("string"))
    p = p.select(*keys, "start", F.posexplode(_slices(k)).alias("i", "kmer"))
    return p.select(*keys, (F.col("start") + F.col("i")).alias("pos"), F.col("kmer").cast("string").alias("kmer"))


#: Orders of m-mers, of which a window's minimizer is the smallest: by letters, by a hash, or by letters with the first base reversed.
ORDERS = {
    "lexicographic": lambda x: x.cast("string"),
    "hash": lambda x: F.struct(F.xxhash64(x).alias("o"), x.cast("string").alias("m")),
    "code": lambda x: F.xxhash64(x),  # the hash alone, where a minimizer needn't be named
    "anti-lexicographic": lambda x: F.struct((-F.ascii(x.cast("string"))).alias("o"), x.cast("string").alias("m")),
}


def _minima(frags: DataFrame, k: int, m: int, keys: tuple[str, ...], order: str) -> tuple[DataFrame, Column]:
    """Pieces (keys, start, f, r) with mins, for each window its smallest canonical m-mer as that order compares them; and how an element of mins names it.

    Minima of 2, 4, 8 ... neighbours are made from those of half as many, so a window costs the logarithm of its m-mers; each round's array is
    a generator's output, or it would be made again for every use."""
    if order not in ORDERS:
        raise ValueError(f"order must be one of {sorted(ORDERS)}")
    mers = _slices(m) if order == "lexicographic" else F.transform(_slices(m), ORDERS[order])
    kept = [*keys, "start", "f", "r"]
    p = pieces(frags, k, *keys, both=True).select(*kept, F.explode(F.array(mers)).alias("ms"))
    size, width = 1, k - m + 1
    while size < width:
        step = min(size, width - size)
        # what stands past the end is null, which the smaller one of two is not
        lower = F.zip_with("ms", F.slice("ms", F.lit(step + 1), F.size("ms")), lambda x, y: F.least(x, y))
        p, size = p.select(*kept, F.explode(F.array(lower)).alias("ms")), size + step
    name = {"lexicographic": lambda x: x.cast("string"), "code": lambda x: x}.get(order, lambda x: x["m"])
    return p.select(*kept, F.slice("ms", F.lit(1), F.octet_length("f") - k + 1).alias("mins")), name


def minimizer_windows(frags: DataFrame, k: int, m: int, *keys: str, order: str = "lexicographic") -> DataFrame:
    """keys, pos, kmer, minimizer (the smallest canonical m-mer of the window in that order)."""
    p, name = _minima(frags, k, m, keys, order)
    both = F.zip_with(_slices(k), "mins", lambda x, y: F.struct(x.cast("string").alias("kmer"), name(y).alias("minimizer")))
    return p.select(*keys, "start", F.posexplode(both).alias("i", "w")).select(*keys, (F.col("start") + F.col("i")).alias("pos"), "w.kmer", "w.minimizer")


def minimizer_pieces(frags: DataFrame, k: int, m: int, *keys: str, order: str = "lexicographic", bases: bool = False) -> DataFrame:
    """keys, start, mins: for each piece the minimizers of its windows, in their order; with ``bases`` f, its bases, as well."""
    p, name = _minima(frags, k, m, keys, order)
    return p.select(*keys, "start", *(["f"] if bases else []), F.explode(F.array(F.transform("mins", name))).alias("mins"))


#: Bases of one packed number.
PACK = 31


def packed(s: str | Column) -> Column:
    """Bases as binary, 8 bytes for each ``PACK``: a 1 and then the bases' digits in base 4."""
    digits = F.translate(of(s), "ACGT", "0123")
    part = lambda i: F.lpad(F.conv(F.concat(F.lit("1"), F.substring(digits, i * PACK + 1, F.lit(PACK))), 4, 16), 16, "0")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(of(s)) - 1) / PACK).cast("int")), part), ""))


def unpacked(b: str | Column) -> Column:
    part = lambda i: F.substring(F.conv(F.hex(F.substring(of(b), i * 8 + 1, F.lit(8))), 16, 4), 2, PACK)
    return F.translate(F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.octet_length(of(b)) - 1) / 8).cast("int")), part), ""), "0123", "ACGT")

"""Quality rules with host-level verdicts, from DataFrame functions only.

Every document is measured (words, symbols, repeated lines, repeated 5-word windows) inside its row. Rule
failures are summed by host; each host's failure rate is shrunk towards all hosts by a beta prior fitted to
the hosts' rates by moments, and the host's verdict is joined back: a document is dropped if it fails the
base rules, or if its host's shrunk rate is above ``host_rate``.

Only the measures (no text) are written and aggregated; partial sums make a hot host one row per task.

Defined cases: null text has no words (and fails the base rules); null host is a host; equal rows count each;
empty tables give no rows; other columns are ignored; a text is measured whole in its row: arrays of its words, of a hash and a
place for each, and of the words of those windows that repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, same

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def windows(words: str) -> Column:
    """The 5 words from each place on where 5 are left, as structs a..e."""
    n = F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(words, k + 1, n).alias(c) for k, c in enumerate("abcde")])


def twice(pairs: Column) -> Column:
    """Places, ascending, of the pairs (w, i), sorted, whose w is that of a neighbour."""
    blank = F.array(F.struct(F.lit(None).alias("w"), F.lit(-1).alias("i")))
    before = F.concat(blank, F.slice(pairs, F.lit(1), F.size(pairs) - 1))
    after = F.concat(F.slice(pairs, F.lit(2), F.size(pairs) - 1), blank)
    equal = lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False))
    marked = F.zip_with(F.zip_with(pairs, before, lambda a, b: F.struct(a["i"].alias("i"), a["w"].alias("w"), equal(a, b).alias("m"))), after, lambda a, b: F.struct(a["i"].alias("i"), (a["m"] | equal(a, b)).alias("m")))
    return F.sort_array(F.transform(F.filter(marked, lambda x: x["m"]), lambda x: x["i"]))


def union(places: Column) -> Column:
    """Words in the union of [place, place + 5)."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("end"))
    return F.aggregate(places, start, lambda s, i: F.struct((s["sum"] + F.least(F.lit(WINDOW), i + WINDOW - s["end"])).alias("sum"), (i + WINDOW).alias("end")), lambda s: s["sum"])


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Arrays are made in layers of projections, so that none is evaluated for each element of another. Windows of word hashes
    tell places whose window may repeat (equal windows have equal hashes); only the windows there are made of words and sorted."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda x: x != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select("doc_id", F.col(host).alias("host"), words.alias("words"), lines.alias("lines"), F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"))
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
    }
    out = out.select("doc_id", "host", "n_symbols", "words", F.transform("words", lambda x: F.xxhash64(x)).alias("hashes"), *[c.cast("long").alias(k) for k, c in counts.items()])
    names = ["doc_id", "host", "n_symbols", *counts]
    out = out.select(*names, "words", F.transform(windows("hashes"), lambda x: F.xxhash64(x)).alias("hashes"))
    distinct = F.size(F.array_distinct("hashes")) == F.size("hashes")
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("w"), i.alias("i"))))
    out = out.select(*names, "words", F.when(~distinct, placed).alias("placed"))
    out = out.select(*names, "words", twice(F.col("placed")).alias("places"))
    window = lambda i: F.struct(F.array_join(F.slice("words", i + 1, WINDOW), " ").alias("w"), i.alias("i"))
    out = out.select(*names, F.sort_array(F.transform("places", window)).alias("wins"))
    out = out.select(*names, twice(F.col("wins")).alias("places"))
    return out.select(*names, F.coalesce(union(F.col("places")), F.lit(0)).cast("long").alias("n_repeat_words"))


#: Rules of the method: name, SQL for a failure. The first two are the base rules.
RULES = {
    "few_words": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
}


def host_verdicts(measured: DataFrame, host_rate: float = 0.5) -> DataFrame:
    """host, docs, failures, rate (shrunk), bad. The prior's mean is the mean rate of all hosts, its strength from
    the variance of hosts' rates beyond what their numbers of documents explain."""
    hosts = measured.groupBy("host").agg(F.count("*").alias("docs"), F.sum(F.col("failed").cast("long")).alias("failures"))
    raw = F.col("failures") / F.col("docs")
    prior = hosts.agg(F.avg(raw).alias("mean"), F.coalesce(F.var_pop(raw), F.lit(0.0)).alias("var"), F.avg(1 / F.col("docs")).alias("per_doc"))
    noise = F.col("mean") * (1 - F.col("mean")) * F.col("per_doc")
    between = F.greatest(F.col("var") - noise, F.lit(1e-6))
    strength = F.greatest(F.lit(1.0), F.least(F.lit(1e4), F.col("mean") * (1 - F.col("mean")) / between - 1))
    prior = prior.select((F.col("mean") * strength).alias("a"), ((1 - F.col("mean")) * strength).alias("b"))
    rate = (F.col("failures") + F.col("a")) / (F.col("docs") + F.col("a") + F.col("b"))
    # one row on the prior's side: a scalar, not a product of tables
    return hosts.join(F.broadcast(prior)).select("host", "docs", "failures", rate.alias("rate"), (rate > host_rate).alias("bad"))


def judge(docs: DataFrame, host: str = "source", host_rate: float = 0.5) -> DataFrame:
    """Per document: the measures, base_failed, failed (any rule), host_rate (shrunk), kept."""
    m = measure(docs, host)
    base = F.expr(RULES["few_words"]) | F.expr(RULES["repeats"])
    failed = base
    for rule in list(RULES.values())[2:]:
        failed = failed | F.expr(rule)
    m = cut(m.select("*", base.alias("base_failed"), failed.alias("failed")), "quality")
    verdicts = host_verdicts(m, host_rate).select(F.col("host").alias("v_host"), F.col("rate").alias("host_rate"), "bad")
    return m.join(verdicts, same(F.col("host"), F.col("v_host"))).drop("v_host").withColumn("kept", ~F.col("base_failed") & ~F.col("bad"))

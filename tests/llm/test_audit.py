"""Quality classifier and source divergence audit: held-out accuracy, brute force, and odd tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandweave.llm import classifier, divergence

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["l_id", "f", "n", "p", "q", "term", "base", "block", "quality", "value", "held_out", "docs"]


def odd_docs(spark):
    long = " ".join(random.Random(4).choice(["alpha", "Beta,", "gamma!", "öl"]) for _ in range(90_000))
    rows = [(1, "", "en", "s", 0), (2, None, None, None, None), (3, long, "en", "t", 1), (3, long, "en", "t", 1), (4, "#$% 123\n\n", "en", "u", 1), (None, "no id", "", "", 1), (5, "éß " * 5, "en", "s", 2), (6, "Ends", "xx", "only", 0)]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASH]), rows


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r["doc_id"]: r for r in classifier.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    known = [(r["quality"], got[r["doc_id"]]) for r in labels.collect()]
    for q in (0, 1):
        right = [r["predicted"] == q for y, r in known if y == q and r["held_out"]]
        assert len(right) > 5 and np.mean(right) >= 0.97
    # labels of held-out rows are not learned from, and neither lang nor source is looked at
    other = classifier.classify(docs.selectExpr("doc_id", "text"), labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality"))
    assert {r["doc_id"]: r["score"] for r in other.collect()} == {i: r["score"] for i, r in got.items()}


def test_quality_moments(spark):
    """The sums of the plan give the model of the rows."""
    d = "/root/testdata/sf0.001"
    stats = classifier.statistics(spark.read.parquet(f"{d}/documents.parquet"))
    labels = spark.read.parquet(f"{d}/labels.parquet")
    model = classifier.fit(stats, labels)
    quality = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    x = {r["doc_id"]: np.array(r["f"]) / classifier.UNIT for r in stats.collect()}
    for q in (0, 1):
        rows = np.array([x[i] for i, y in quality.items() if y == q])
        assert np.allclose(model.means[q], rows.mean(axis=0))
    many = np.random.default_rng(1).normal(size=(4000, 3)) * [1, 5, 0.2] + [1, 2, 3]
    far = many + [0, 0, 2]
    m = classifier.discriminant([4000, 4000], [many.sum(0), far.sum(0)], [many.T @ many, far.T @ far])
    assert (m.score(many) < 0.5).mean() > 0.999 and (m.score(far) > 0.5).mean() > 0.999
    assert np.allclose(np.cov(m.inverse[0] @ many.T), np.eye(3), atol=0.1)


def test_quality_odd(spark):
    docs, rows = odd_docs(spark)
    labels = lambda *r: spark.createDataFrame(list(r), "doc_id long, quality int, toxic int")
    for known in ([], [(1, 1, 0)], [(1, 1, 0), (2, 0, 0), (3, 1, 0), (3, 0, 1), (4, None, 0), (None, 0, 0), (4, 7, 0)]):
        got = classifier.classify(docs, labels(*known).selectExpr("*", "'y' AS text")).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
        assert all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1 and len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    assert {r["score"] for r in classifier.classify(docs, labels()).collect()} == {0.5}
    assert classifier.classify(docs.limit(0), labels((1, 1, 0))).count() == 0


def brute(rows, min_docs, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    held, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        words = term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        held[lang].update(set(words))
        count[lang, source].update(words)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= min_docs]

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(count[lang, s]) for s in sources}, shares(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("light,side,terms", [(8, 64, 256), (2, 3, 4), (0, 2, 5), (99, 4, 3)])
def test_divergence(spark, monkeypatch, light, side, terms):
    r = random.Random(7)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] + ["öl", "ÉT", "Zug"]
    rows = []
    for i in range(260):
        home = r.randrange(11)
        words = [vocabulary[min(int(r.expovariate(0.08)) + home % 4, 62)] for _ in range(r.randrange(12))]
        rows.append((i, "-".join(words), r.choice(["en", "en", "de", None]), r.choice([f"s{home}", f"S{home}é", None]) if home else "hot", 0))
    rows += [(900, "", "en", "bare", 0), (901, None, "xx", "p", 0), (902, "lonely", "xx", "q", 0)]
    monkeypatch.setattr(divergence, "SIDE", side)
    monkeypatch.setattr(divergence, "TERMS", terms)
    got = divergence.divergence(spark.createDataFrame(rows, DOCS), 4, light, 5).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 4, 5)


def test_divergence_odd(spark):
    docs, rows = odd_docs(spark)
    for least in (1, 30):
        assert sorted(tuple(r) for r in divergence.divergence(docs, least).collect()) == brute(rows, least, 50)
    assert divergence.divergence(docs.limit(0)).count() == 0

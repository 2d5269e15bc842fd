"""Links of the reformer against a plain pass over all keys, decided by rounds and by one task."""

import random

import pytest

from strandweave.operators import reform

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(COMPLEMENT)


def one_pass(units, k, mode):
    """Links of units {id: seq}: keys, ends and starts in ascending order; a link's other end must be in another path."""
    ends, starts = {}, {}
    for u, s in units.items():
        for rev, t in ((False, s), (True, rc(s))):
            starts.setdefault(t[: k - 1], []).append((u, rev))
            ends.setdefault(t[1 - k :], []).append((u, rev))
    after, before, strand, links = {}, {}, {}, set()

    def head(u):
        while u in before:
            u = before[u]
        return u

    def fits(e, s):
        return e[0] not in after and s[0] not in before and strand.get(e[0], e[1]) == e[1] and strand.get(s[0], s[1]) == s[1] and head(e[0]) != head(s[0])

    for key in sorted(set(ends) & set(starts)):
        es, ss = sorted(ends[key]), sorted(starts[key])
        for e in es:
            fit = [s for s in ss if fits(e, s)]
            if mode == "simplitig" or len(es) == len(ss) == 1:
                fit = fit[:1]
            if len(fit) == 1 and (mode == "simplitig" or len(es) == len(ss) == 1 or sum(fits(x, fit[0]) for x in es) == 1):
                s = fit[0]
                after[e[0]], before[s[0]], strand[e[0]], strand[s[0]] = s[0], e[0], e[1], s[1]
                links.add((*e, *s))
    return links


def table(spark, units):
    return spark.createDataFrame(list(units.items()), "unitig_id long, seq string")


@pytest.mark.parametrize("mode", reform.MODES)
@pytest.mark.parametrize("local, k, letters, n", [(0, 3, "ACGT", 12), (60, 4, "ACGT", 100), (20, 3, "AT", 12), (reform.LOCAL_ENDS, 3, "ACGT", 60), (reform.LOCAL_ENDS, 2, "ACGT", 30)])
def test_links(spark, monkeypatch, mode, local, k, letters, n):
    monkeypatch.setattr(reform, "LOCAL_ENDS", local)
    r = random.Random(f"{k} {letters} {n}")
    units = {i * 7 % 1009: "".join(r.choices(letters, k=r.randint(k, k + 5))) for i in range(n)}
    got = [tuple(x) for x in reform.links(table(spark, units), k, mode).collect()]
    assert len(set(got)) == len(got)
    assert set(got) == one_pass(units, k, mode)


def test_paths_follow_links(spark, monkeypatch):
    """Places in paths are those of a walk along the links; single records are paths of their own."""
    monkeypatch.setattr(reform, "LOCAL_ENDS", 100)
    r = random.Random(5)
    units = {i: "".join(r.choices("ACGT", k=r.randint(5, 9))) for i in range(200)} | {1000: "AAAAACCCCC"}
    links = one_pass(units, 4, "simplitig")
    after, strand = {a: b for a, _, b, _ in links}, {a: x for a, x, _, _ in links} | {b: y for _, _, b, y in links}
    want = set()
    for u in set(units) - set(after.values()):
        at, place = u, 0
        while at is not None:
            want.add((u, place, at, strand.get(at, False)))
            at, place = after.get(at), place + 1
    got = [tuple(x) for x in reform.paths(table(spark, units), 4).collect()]
    assert sorted(got) == sorted(want)


def test_a_long_chain(spark, monkeypatch):
    """Records of one genome in random order, on random strands: rounds give what the pass gives, and no record is lost."""
    monkeypatch.setattr(reform, "LOCAL_ENDS", 200)
    r = random.Random(1)
    k, step, n = 25, 10, 1000
    genome = "".join(r.choices("ACGT", k=step * n + k))
    cuts = [genome[i * step : i * step + step + k - 1] for i in range(n)]
    units = {i: s if r.random() < 0.5 else rc(s) for i, s in zip(r.sample(range(10 * n), n), cuts)}
    links = one_pass(units, k, "simplitig")
    rows = reform.render(reform.validate(table(spark, units).selectExpr("unitig_id", "'' as header", "seq"), k, False), reform.paths(table(spark, units), k), k).collect()
    assert len(rows) == n - len(links) and sum(x["unitigs"] for x in rows) == n
    assert all(x["seq"] in genome or rc(x["seq"]) in genome for x in rows)


def test_a_hot_key(spark):
    """Thousands of records that share their first and last bases: the work over a key is not quadratic."""
    units = {i: "AACC" + format(i, "016b").translate(str.maketrans("01", "GT")) + "AACC" for i in range(6000)}
    assert set(map(tuple, reform.links(table(spark, units), 5).collect())) == one_pass_hot(units)


def one_pass_hot(units):
    """Of records with one start and one end key, all on the forward strand first: each end takes the smallest free start elsewhere."""
    links, order = set(), sorted(units)
    for a, b in zip(order, order[1:]):
        links.add((a, False, b, False))
    return links


def test_nothing(spark):
    assert reform.paths(spark.createDataFrame([], "unitig_id long, seq string"), 3).collect() == []
    assert [tuple(x) for x in reform.paths(table(spark, {4: "AAAC"}), 3).collect()] == [(4, 0, 4, False)]

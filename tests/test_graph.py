"""Components against a union-find, by one task's contraction and by the rounds that larger forests take."""

import random

import pytest

from strandweave.operators import graph


@pytest.mark.parametrize("most, kind", [(graph.LOCAL_EDGES, "long"), (graph.LOCAL_EDGES, "string"), (8, "long")])
def test_components(spark, monkeypatch, most, kind):
    monkeypatch.setattr(graph, "LOCAL_EDGES", most)
    r = random.Random(most)
    edges = [(i, i + 1) for i in range(40)] + [(50, x) for x in range(51, 90)] + [(r.randint(100, 220), r.randint(100, 220)) for _ in range(70)] + [(300, 300)]
    if kind == "string":
        edges = [(f"k{a}", f"k{b}") for a, b in edges]
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((root(a), root(b)))
            top[q] = p
    got = graph.components(spark.createDataFrame(edges, f"a {kind}, b {kind}").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in list(top))


def test_no_edges(spark):
    assert graph.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []
    assert graph.components(spark.createDataFrame([], "a string, b string")).collect() == []

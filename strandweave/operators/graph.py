"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..shipping import ship

#: Edges that one task holds at once when it contracts its partition; a forest of no more than these is finished by one task.
LOCAL_EDGES = 1 << 20


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    top = np.arange(len(nodes))
    while len(u):
        u, v = top[u], top[v]
        open_ = u != v
        u, v = u[open_], v[open_]
        np.minimum.at(top, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := top[top], top):
            top = up
    return nodes, nodes[top]


def contracted(most: int, roots: bool):
    """Edges of a partition as stars of their local components, ``most`` edges at a time. roots: each centre, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        kinds = None

        def stars() -> tuple[np.ndarray, np.ndarray]:
            node, low = smallest(*(np.concatenate(c) for c in zip(*held)))
            return (node, low) if roots else (node[node != low], low[node != low])

        for batch in batches:
            kinds = batch.schema.types
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns[:2]))
            if sum(len(a) for a, _ in held) > most:
                held = [stars()]
                if len(held[0][0]) > most // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(held.pop(), kinds)], ["u", "v"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(stars(), kinds)], ["u", "v"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every end of the edges (a, b: of one orderable type), written to the shared folder.

    Each partition first contracts its own edges to stars, without a shuffle. If what is left is at most ``LOCAL_EDGES``, one
    task finishes it; else large-star / small-star rounds do: logarithmic in practice, each is two aggregations and two joins
    with a node's smallest neighbour (neighbours are never gathered), and is written. The smallest neighbours are written
    too: a join with an aggregate made in the same plan would keep the aggregate's dealing by node, in which a hub's edges
    are one task that AQE can't split."""
    ship(edges.sparkSession)
    kind = edges.select("a").dtypes[0][1]
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    edges = cut(pairs.mapInArrow(contracted(LOCAL_EDGES, False), f"u {kind}, v {kind}"), "forest")
    if edges.count() <= LOCAL_EDGES:
        whole = edges.coalesce(1).mapInArrow(contracted(2 * LOCAL_EDGES, True), f"u {kind}, v {kind}")
        return cut(whole.select(F.col("u").alias("id"), F.col("v").alias("component")), "components")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = cut(large, "large")
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return cut(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots), "components")

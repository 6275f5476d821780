"""Connected components of a graph given as edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import durable

#: Up to so many edges (16 bytes each) are joined in one task; beyond, stars are contracted in rounds.
ONE_TASK_EDGES = 1_000_000


class UnionFind:
    """Sets with their smallest member as root."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (p := parent.setdefault(root, root)) != root:
            root = p
        while x != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of the partition's edges with its root: a star for each component of the partition."""
    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.union(a, b)
    nodes = list(sets.parent)
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        yield pa.record_batch([pa.array(part, pa.int64()), pa.array([sets.find(x) for x in part], pa.int64())], ["node", "label"])


def connected_components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, label): label is the smallest node reachable over ``edges`` (u, v: long). Nodes without edges don't appear.

    Each partition first reduces its edges to stars. If few edges are left, one task joins them; else
    rounds of large-star and small-star contraction follow until nothing changes; what a node
    keeps is its smallest neighbour, found by a partial aggregate, so a hub is no hot key.
    """
    left = durable(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null").mapInArrow(_forest, "node long, label long"))
    if left.count() <= one_task_edges:
        return left.repartition(1).mapInArrow(_forest, "node long, label long")
    return _stars(left)


def _stars(left: DataFrame) -> DataFrame:
    nodes = left.select("node").union(left.select(F.col("label").alias("node"))).distinct()
    graph = left.where("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v"))

    def neighbours(g: DataFrame) -> DataFrame:
        return g.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    before = None
    while True:
        both = graph.union(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(neighbours(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        least = neighbours(down)
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        graph = durable(small)
        now = tuple(graph.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return nodes.join(graph.groupBy("u").agg(F.min("v").alias("label")), nodes.node == F.col("u"), "left").select("node", F.coalesce("label", "node").alias("label"))

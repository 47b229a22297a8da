"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For the vertices 0..n-1 and the edges (a[i], b[i]): the smallest vertex of each vertex's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


#: Edges that a task contracts at once.
CHUNK = 2_000_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a task, by chunks, as stars of the same components: each vertex with the smallest one."""
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
        held.clear()
        vertices, number = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = local_roots(len(vertices), number[: len(a)], number[len(a) :])
        inner = np.flatnonzero(root != np.arange(len(vertices)))
        return pa.record_batch([pa.array(vertices[inner]), pa.array(vertices[root[inner]])], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= CHUNK:
            yield stars()
    if held:
        yield stars()


def _settled(pairs: DataFrame) -> bool:
    """Whether the edges (a, b) are stars: no vertex has two edges up or edges up and down."""
    ends = pairs.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(pairs.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every vertex of edges (a, b): the smallest id that it reaches.

    Each task first contracts its own edges. Then large-star and small-star steps alternate, whose rounds grow with the
    logarithm of the largest component, until all edges are stars. Each step aggregates the smallest neighbour of a
    vertex before the shuffle and cuts it, so that the join back reads two plain exchanges and Spark can split the rows
    of a vertex with very many edges. Null ends and loops are dropped; ids that stand in no edge do not appear. An empty
    edge list gives an empty result.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    pairs = cut(pairs.mapInArrow(_contract, "a long, b long").distinct())
    for _ in range(most_rounds):
        if _settled(pairs):
            break
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = cut(large.where("a <> b").distinct())
        low = cut(large.groupBy("a").agg(F.min("b").alias("low")))
        joined = large.join(low, "a")
        small = joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        pairs = cut(small.mapInArrow(_contract, "a long, b long").distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("b").alias("id"), F.col("b").alias("component"))
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots).groupBy("id").agg(F.min("component").alias("component"))

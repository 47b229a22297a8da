"""Embedding near-duplicates: spherical k-means cells and blocked cosine products within them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_sample
from .components import connected_components, local_roots
from .vectors import by_length

#: Vectors a cell on average and cells at most; vectors that the centroids are fitted on: LEAST_SAMPLE, or SEEN for each cell.
PER_CELL, MOST_CELLS, LEAST_SAMPLE, SEEN, SAMPLE_BYTES = 256, 16_384, 20_000, 10, 128 << 20
#: Cells that a vector stands in at most, itself the nearest (None: all that could hold a neighbour), and inner nodes of
#: the centroids' tree that are opened for it.
VISITS, BEAM = 3, 4
#: Bytes of the vectors of a block, and rows that are multiplied at once.
BLOCK_BYTES, TILE = 16 << 20, 1024


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by the largest component first, so that no square over- or underflows."""
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), np.finfo(float).tiny)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.finfo(float).tiny)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit centroids by spherical k-means; a cell that runs empty gets the vector that its own serves worst."""
    x = unit(x)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        sims = x @ c.T
        near = sims.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        empty = np.flatnonzero(np.bincount(near, minlength=len(c)) == 0)
        if len(empty):
            sums[empty] = x[np.argsort(sims.max(1), kind="stable")[: len(empty)]]
        new = unit(sums)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


class Cells:
    """Unit centroids as the leaves of a tree of two levels: the inner nodes cluster a sample, the leaves each node's part."""

    def __init__(self, x: np.ndarray, k: int) -> None:
        x = unit(x)
        self.inner = kmeans(x, max(1, round(k**0.5)))
        near = (x @ self.inner.T).argmax(1)
        leaves = [kmeans(x[near == n], max(1, round(k * (near == n).mean()))) if (near == n).any() else self.inner[n : n + 1] for n in range(len(self.inner))]
        self.leaves, self.start = np.concatenate(leaves), np.cumsum([0, *map(len, leaves)])

    def of(self, x: np.ndarray, least: float, visits: int | None = VISITS) -> list[list[int]]:
        """The cells of unit rows, the nearest first. A vector within the least cosine can have another cell as its
        nearest only if the bisecting plane of both centroids is no farther than two such vectors are apart. With visits,
        that many of these cells at most, looked for in the BEAM nearest nodes; without, all of them, which loses no
        pair."""
        reach = np.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
        out: list[list[int]] = []
        if visits is None:
            for row in x:
                sims = self.leaves @ row
                top = int(sims.argmax())
                gap = np.linalg.norm(self.leaves - self.leaves[top], axis=1)
                out.append([top, *(c for c in np.flatnonzero(sims[top] - sims <= reach * gap).tolist() if c != top)])
            return out
        nodes = np.argsort(-(x @ self.inner.T), axis=1, kind="stable")[:, :BEAM]
        best, cell = np.full((len(x), visits), -np.inf), np.full((len(x), visits), -1)
        for n in np.unique(nodes).tolist():
            own = np.flatnonzero((nodes == n).any(1))
            for at in range(0, len(own), 4096):
                rows = own[at : at + 4096]
                sims = x[rows] @ self.leaves[self.start[n] : self.start[n + 1]].T
                both = np.concatenate((best[rows], sims), 1)
                names = np.concatenate((cell[rows], np.broadcast_to(np.arange(self.start[n], self.start[n + 1]), sims.shape)), 1)
                top = np.argsort(-both, axis=1, kind="stable")[:, :visits]
                best[rows], cell[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
        gap = np.linalg.norm(self.leaves[cell] - self.leaves[cell[:, :1]], axis=2)
        fits = (cell >= 0) & (best[:, :1] - best <= reach * gap)
        return [row[ok].tolist() for row, ok in zip(cell, fits, strict=True)]


def _assign(cells: Cells | None, least: float, visits: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in by_length(batch.column(2)):
                if cells is None or x.shape[1] != cells.leaves.shape[1]:
                    own = [[0]] * len(rows)  # other lengths are compared among themselves
                else:
                    own = cells.of(unit(x), least, visits)
                yield pa.record_batch([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(own, pa.list_(pa.int32())), batch.column(2).take(pa.array(rows))], names=["uid", "size", "cells", "vec"])

    return run


def _block_links(least: float):
    def links(own: np.ndarray, weight: np.ndarray, block: np.ndarray, cells: np.ndarray, cell: int, x: np.ndarray):
        """One cell and pair of blocks: (uid, weight of the others linked here, smallest uid reached here)."""
        x = unit(x)
        low, count, root = block.min(), np.zeros(len(own)), np.arange(len(own))
        left = np.flatnonzero(block == low)
        right = np.flatnonzero(block != low)
        same = not len(right)
        right = left if same else right
        for at in range(0, len(left), TILE):
            a = left[at : at + TILE]
            for to in range(at if same else 0, len(right), TILE):
                b = right[to : to + TILE]
                i, j = np.nonzero(x[a] @ x[b].T >= least)
                i, j = a[i], b[j]
                keep = i < j if same else np.ones(len(i), bool)
                i, j = i[keep], j[keep]
                # a pair that meets in several cells counts in the first one
                if cells.shape[1] > 1:
                    first = np.full(len(i), np.iinfo(np.int32).max)
                    for k in range(cells.shape[1]):
                        mine = cells[i, k]
                        first = np.where((mine >= 0) & (cells[j] == mine[:, None]).any(1), np.minimum(first, mine), first)
                    i, j = i[first == cell], j[first == cell]
                # counted and contracted at once, so that a cell of near vectors holds no list of its pairs
                count += np.bincount(i, weight[j], len(own)) + np.bincount(j, weight[i], len(own))
                r, c = np.unique(np.sort(root[np.stack((i, j))], axis=0), axis=1) if len(i) else (i, j)
                if len(r):
                    root = local_roots(len(own), r, c)[root]
        hit = np.flatnonzero(count)
        return own[hit], count[hit].astype(np.int64), own[root[hit]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (g, cell, block, uid, size, cells, vec) come sorted by g."""
        held: list[pa.RecordBatch] = []
        last = None

        def close():
            t = pa.Table.from_batches(held).combine_chunks()
            column = t.column("vec").chunk(0)
            parts = []
            lists = t.column("cells").to_pylist()
            wide = np.full((len(t), max(map(len, lists))), -1)
            for k, c in enumerate(lists):
                wide[k, : len(c)] = c
            for rows, x in by_length(column):
                pick = lambda name, rows=rows: t.column(name).to_numpy()[rows]
                order = np.argsort(pick("uid"), kind="stable")
                parts.append(links(pick("uid")[order], pick("size")[order], pick("block")[order], wide[rows][order], int(t.column("cell")[0].as_py()), x[order]))
            a = [np.concatenate(p) for p in zip(*parts, strict=True)]
            return pa.record_batch([pa.array(v) for v in a], names=["uid", "links", "root"])

        for batch in batches:
            g = batch.column(0).to_numpy()
            if not len(g):
                continue
            cuts = np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]))
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if last is not None and g[s] != last:
                    yield close()
                    held = []
                last = g[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield close()

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95, visits: int | None = VISITS) -> DataFrame:
    """Per row (id_col, n_links, component_id, kept): the others at a cosine of `least` or more.

    Centroids, one for PER_CELL vectors up to MOST_CELLS, are fitted on a bounded sample; all vectors are put into
    cells, each into its nearest and up to `visits` - 1 more that a neighbour could have as its nearest, and compared
    exactly, in double precision, with all of a cell. With visits=None a vector stands in every cell that could hold a
    neighbour, and no pair is lost. Equal vectors are one class before any comparison. A cell of more than a block is
    dealt out as pairs of blocks; a block holds BLOCK_BYTES of vectors.

    component_id is the smallest id reachable, kept whether that is the row's own. Vectors that are null, empty, zero
    or hold null or non-finite components link with nothing and stay alone; vectors of other lengths than the sample's
    only link among themselves; rows with a null id link with nothing and have a null component. Repeated rows count as
    other vectors. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    sound = F.coalesce(F.size("vec") > 0, F.lit(False)) & F.col("id").isNotNull() & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "id", "vec", F.coalesce(sound, F.lit(False)).alias("sound")))
    good = rows.where("sound").withColumn("h", F.xxhash64("vec"))
    classes = cut(good.groupBy("h", "vec").agg(F.min("row").alias("uid"), F.count("*").alias("size"), F.min("id").alias("low")))
    # the most frequent length is the one that gets cells
    length = classes.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    n = length["count"] if length else 0
    d = length["d"] if length else 1
    k = int(np.clip(n // PER_CELL, 1, MOST_CELLS))
    most = int(min(max(LEAST_SAMPLE, SEEN * k), max(k, SAMPLE_BYTES // (8 * d))))
    some = hash_sample(classes.where(F.size("vec") == d), most, "uid").select("vec").toArrow().column("vec").combine_chunks()
    some = some.chunk(0) if isinstance(some, pa.ChunkedArray) and some.num_chunks else some
    parts = by_length(some) if n else []
    cells = Cells(parts[0][1], k) if parts else None
    vec = classes.schema["vec"].dataType.simpleString()
    assigned = classes.select("uid", "size", "vec").mapInArrow(_assign(cells, least, visits), f"uid long, size long, cells array<int>, vec {vec}")
    placed = cut(assigned.withColumn("d", F.size("vec")).select("*", F.explode("cells").alias("cell")))
    # how many blocks a cell has: at most MOST_CELLS rows for each vector length
    room = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("d"))))
    sizes = cut(placed.groupBy("d", "cell").agg(F.count("*").alias("n")).select("d", "cell", F.ceil(F.col("n") / room).cast("int").alias("blocks")))
    dealt = placed.join(sizes, ["d", "cell"]).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("d", "cell", F.least("block", "other"), F.greatest("block", "other")).alias("g"), "cell", "block", "uid", "size", "cells", "vec")
    found = cut(dealt.repartition("g").sortWithinPartitions("g").mapInArrow(_block_links(least), "uid long, links long, root long"))
    linked = connected_components(found.select(F.col("uid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "uid")
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    named = classes.select("uid", "size", "low", "h", "vec").join(linked, "uid", "left").join(links, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    # cut, so that the join reads two plain exchanges and a hot component's rows can be split
    lows = cut(named.groupBy("component").agg(F.min("low").alias("component_id")))
    of = named.join(lows, "component").select("h", "vec", "component_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    done = good.join(of, ["h", "vec"]).select("id", "n_links", "component_id")
    done = done.unionByName(rows.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return done.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))

"""Embedding-space metrics: neighbours, support, retrieval, geometry and diversity.

Exact neighbour scans meet blocks of queries with parts of the gallery in tasks: the queries of a task are held, the gallery
goes by in batches, products are one matrix multiplication each, and a task gives one result a query. Neither side comes
to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that a task holds, and gallery rows that it goes through, about; gallery rows of one product: 256 x 8192 scores
#: are 16 MB, however many rows a batch has.
QUERY_BLOCK, GALLERY_PART, STEP = 8192, 1 << 18, 256
#: The last bits of a product vary with its shape. Scores this near to a limit are computed anew, PAIRS at a time, by a sum
#: that is the same for (a, b) and (b, a) in every task.
NEAR, PAIRS = 1e-9, 1 << 16


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _matrix(values) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in values]) if len(values) else np.zeros((0, 1))


def _meet(queries: DataFrame, gallery: DataFrame, start: Callable, schema: str) -> DataFrame:
    """Every query (id, vec, x) with every gallery row (id, vec, x), in blocks: start(ids, unit vectors, x) gives an object
    whose take(ids, unit vectors, x) sees the gallery in batches and whose result() gives a frame of the schema. A query's
    results of several tasks are for the caller to put together."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    parallel = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-gallery.count() // GALLERY_PART), -(-parallel // blocks))

    def sent(df: DataFrame, kind: int, own: int, others: int) -> DataFrame:
        place = F.pmod(F.xxhash64("id"), F.lit(own))
        other = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        rows = df.select("id", F.col("vec").cast("array<double>").alias("vec"), F.col("x").cast("double").alias("x"), place.alias("own"), other.alias("other"))
        block, part = ("own", "other") if kind == 0 else ("other", "own")
        return rows.select((F.col(block) * parts + F.col(part)).alias("g"), F.lit(kind).alias("kind"), "id", "vec", "x")

    work = sent(queries, 0, blocks, parts).unionByName(sent(gallery, 1, parts, blocks))
    work = work.repartition(max(parallel, blocks * parts), "g").sortWithinPartitions("g", "kind", "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, asked, state = None, [], None
        for frame in frames:
            for (g, kind), f in frame.groupby(["g", "kind"], sort=True):
                if g != last:
                    if state is not None:
                        yield state.result()
                    last, asked, state = g, [], None
                if kind == 0:
                    asked.append(f)
                elif asked:
                    if state is None:
                        q = pd.concat(asked)
                        state = start(q["id"].to_numpy(), unit_rows(_matrix(q["vec"].tolist())), q["x"].to_numpy())
                    for at in range(0, len(f), STEP):
                        some = f.iloc[at : at + STEP]
                        state.take(some["id"].to_numpy(), unit_rows(_matrix(some["vec"].tolist())), some["x"].to_numpy())
        if state is not None:
            yield state.result()

    return work.mapInPandas(run, schema)


def _scores(ids: np.ndarray, x: np.ndarray, g: np.ndarray, y: np.ndarray, skip: bool) -> np.ndarray:
    s = x @ y.T
    if skip:
        s[ids[:, None] == g[None]] = -np.inf
    return s


def _exact(x: np.ndarray, y: np.ndarray, q: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The cosines of the pairs of unit rows (q, g)."""
    out = np.empty(len(q))
    for at in range(0, len(q), PAIRS):
        out[at : at + PAIRS] = (x[q[at : at + PAIRS]] * y[g[at : at + PAIRS]]).sum(1)
    return out


def _reached(s: np.ndarray, limit: np.ndarray, x: np.ndarray, y: np.ndarray, over: bool) -> np.ndarray:
    """How many scores of each query are at or over a limit, or only over it; limit is a row or a column."""
    sure = s > limit + NEAR
    q, g = np.nonzero(sure ^ (s >= limit - NEAR))
    exact, own = _exact(x, y, q, g), np.broadcast_to(limit, s.shape)[q, g]
    return np.count_nonzero(sure, axis=1) + np.bincount(q[exact > own if over else exact >= own], minlength=len(s))


class _Nearest:
    """The k nearest rows of each query, ties to the smaller id."""

    def __init__(self, k: int, skip_self: bool) -> None:
        self.k, self.skip = k, skip_self

    def __call__(self, ids: np.ndarray, x: np.ndarray, _: np.ndarray) -> _Nearest:
        new = _Nearest(self.k, self.skip)
        new.ids, new.x = ids, x
        new.sims, new.found = np.full((len(ids), self.k), -np.inf), np.zeros((len(ids), self.k), np.int64)
        return new

    def take(self, g: np.ndarray, y: np.ndarray, _: np.ndarray) -> None:
        s = _scores(self.ids, self.x, g, y, self.skip)
        s[:, ~np.isfinite(y).all(1)] = -np.inf
        least, over = self.sims[:, -1], len(g) - self.k
        if over > 0 and not np.isfinite(least).all():
            least = np.maximum(least, np.partition(s, over, axis=1)[:, over])
        q, j = np.nonzero((s >= (least - NEAR)[:, None]) & (s > -np.inf))
        if not len(q):
            return
        rows, of = np.unique(q, return_inverse=True)
        owner = np.concatenate((np.repeat(np.arange(len(rows)), self.k), of))
        sims, found = np.concatenate((self.sims[rows].ravel(), _exact(self.x, y, q, j))), np.concatenate((self.found[rows].ravel(), g[j]))
        order = np.lexsort((found, -sims, owner))
        top = order[np.searchsorted(owner[order], np.arange(len(rows)))[:, None] + np.arange(self.k)]
        self.sims[rows], self.found[rows] = sims[top], found[top]

    def result(self) -> pd.DataFrame:
        keep = np.isfinite(self.sims).ravel()
        return pd.DataFrame({"q_id": np.repeat(self.ids, self.k)[keep], "g_id": self.found.ravel()[keep], "sim": self.sims.ravel()[keep]})


class _Support:
    """How many rows have the query within their own radius, and the nearest cosine."""

    def __init__(self, skip_self: bool) -> None:
        self.skip = skip_self

    def __call__(self, ids: np.ndarray, x: np.ndarray, _: np.ndarray) -> _Support:
        new = _Support(self.skip)
        new.ids, new.x, new.hits, new.nn = ids, x, np.zeros(len(ids), np.int64), np.full(len(ids), -np.inf)
        return new

    def take(self, g: np.ndarray, y: np.ndarray, radius: np.ndarray) -> None:
        s = _scores(self.ids, self.x, g, y, self.skip)
        self.hits += _reached(s, radius[None], self.x, y, over=False)
        self.nn = np.maximum(self.nn, s.max(1))

    def result(self) -> pd.DataFrame:
        return pd.DataFrame({"q_id": self.ids, "hits": self.hits, "nn": self.nn})


class _Rank:
    """How many other rows score higher than the query's positive, and the best of them."""

    def __call__(self, ids: np.ndarray, x: np.ndarray, positive: np.ndarray) -> _Rank:
        new = _Rank()
        new.ids, new.x, new.positive, new.higher, new.best = ids, x, positive, np.zeros(len(ids), np.int64), np.full(len(ids), -np.inf)
        return new

    def take(self, g: np.ndarray, y: np.ndarray, _: np.ndarray) -> None:
        s = _scores(self.ids, self.x, g, y, True)
        self.higher += _reached(s, self.positive[:, None], self.x, y, over=True)
        self.best = np.maximum(self.best, s.max(1))

    def result(self) -> pd.DataFrame:
        return pd.DataFrame({"id": self.ids, "higher": self.higher, "best": self.best, "positive": self.positive})


def _plain(df: DataFrame) -> DataFrame:
    return df.select("id", "vec", F.lit(0.0).alias("x"))


def neighbours(queries: DataFrame, gallery: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """(q_id, g_id, sim, rank): the k nearest gallery rows (id, vec) of each query by cosine, ties to the smaller id.
    skip_self leaves out the gallery row of the query's own id."""
    out = _meet(_plain(queries), _plain(gallery), _Nearest(k, skip_self), "q_id long, g_id long, sim double")
    w = Window.partitionBy("q_id").orderBy(F.desc("sim"), "g_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_cosine(queries: DataFrame, gallery: DataFrame, skip_self: bool = False) -> DataFrame:
    """(q_id, sim): the highest cosine of each query over the gallery."""
    return neighbours(queries, gallery, 1, skip_self).select("q_id", "sim")


def kth_self_cosine(gallery: DataFrame, k: int) -> DataFrame:
    """(id, radius): the cosine of each row's k-th neighbour, itself left out."""
    return neighbours(gallery, gallery, k, skip_self=True).where(F.col("rank") == k).select(F.col("q_id").alias("id"), F.col("sim").alias("radius"))


def support(queries: DataFrame, gallery: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """(q_id, covered, density, nn): whether a gallery row has the query within its own k-th neighbour's radius, the number of
    such rows over k, and the nearest cosine. skip_self leaves out the gallery row of the query's own id."""
    from ..sources.scratch import held

    ready = gallery.join(held(kth_self_cosine(gallery, k)), "id").select("id", "vec", F.col("radius").alias("x"))
    out = _meet(_plain(queries), ready, _Support(skip_self), "q_id long, hits long, nn double")
    g = out.groupBy("q_id").agg(F.sum("hits").alias("hits"), F.max("nn").alias("nn"))
    return g.select("q_id", (F.col("hits") > 0).alias("covered"), (F.col("hits") / k).alias("density"), "nn")


def retrieval(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, direction, positive, margin, rank): of frames (id, vec) with the same ids: the diagonal score, its lead over the
    best other, and the rank 1 + number of strictly higher scores, both ways."""

    @F.pandas_udf("double")
    def cosine(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series((unit_rows(_matrix(p.tolist())) * unit_rows(_matrix(q.tolist()))).sum(1) if len(p) else [], dtype="float64")

    out = None
    for name, q, g in (("a2b", a, b), ("b2a", b, a)):
        vec = lambda c: F.col(c).cast("array<double>")
        asked = q.alias("q").join(g.alias("g"), "id").select("id", F.col("q.vec").alias("vec"), cosine(vec("q.vec"), vec("g.vec")).alias("x"))
        found = _meet(asked, _plain(g), _Rank(), "id long, higher long, best double, positive double")
        found = found.groupBy("id").agg(F.sum("higher").alias("higher"), F.max("best").alias("best"), F.max("positive").alias("positive"))
        found = found.select("id", F.lit(name).alias("direction"), "positive", (F.col("positive") - F.col("best")).alias("margin"), (F.col("higher") + 1).alias("rank"))
        out = found if out is None else out.unionByName(found)
    return out


def retrieval_summary(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("direction").agg(F.count("*").alias("n"), F.avg("positive").alias("positive"), F.avg("margin").alias("margin"), F.avg((F.col("rank") <= 1).cast("double")).alias("r_at_1"), F.avg((F.col("rank") <= 5).cast("double")).alias("r_at_5"), F.avg("rank").alias("mean_rank"))


def scatter(rows: DataFrame, by: str, unit: bool) -> DataFrame:
    """(by, n, d, sums, gram): sums and Gram matrix of (vec) by group, added up in each task before they meet."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}
        for f in frames:
            for key, own in f.groupby(by, dropna=False):
                x = _matrix(own["vec"].tolist())
                x = unit_rows(x) if unit else x
                old = acc.get(key)
                new = (len(x), x.sum(0), x.T @ x)
                acc[key] = new if old is None else tuple(a + b for a, b in zip(old, new, strict=True))
        for key, (n, s, g) in acc.items():
            yield pd.DataFrame({"key": [str(key)], "n": [n], "s": [s.tolist()], "g": [g.ravel().tolist()]})

    parts = rows.select(F.col(by).cast("string").alias(by), "vec").mapInPandas(partial, "key string, n long, s array<double>, g array<double>")
    cells = parts.select("key", "n", F.explode(F.flatten(F.array(F.transform("s", lambda v, i: F.struct(F.lit(0).alias("kind"), i.alias("i"), v.alias("v"))), F.transform("g", lambda v, i: F.struct(F.lit(1).alias("kind"), i.alias("i"), v.alias("v")))))).alias("c"))
    total = parts.groupBy("key").agg(F.sum("n").alias("n"))
    sums = cells.groupBy("key", "c.kind", "c.i").agg(F.sum("c.v").alias("v"))
    arrays = sums.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == 0, F.struct("i", "v")))), lambda x: x["v"]).alias("sums"), F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == 1, F.struct("i", "v")))), lambda x: x["v"]).alias("gram"))
    return total.join(arrays, "key").withColumnRenamed("key", by)


def _spectrum(g: list, n: int) -> np.ndarray:
    d = int(len(g) ** 0.5)
    return np.maximum(np.linalg.eigvalsh(np.asarray(g).reshape(d, d) / max(1, n)), 0)


def vendi(rows: DataFrame, by: str) -> DataFrame:
    """By group: exp of the entropy of the eigenvalues of the cosine kernel, and the largest eigenvalue's share. The d x d
    matrix has the same non-zero spectrum as the n x n kernel."""

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for g, n in zip(f["gram"], f["n"], strict=True):
                p = _spectrum(g, n)
                p = p[p > 0] / p.sum()
                out.append((float(np.exp(-(p * np.log(p)).sum())), float(p.max())))
            yield pd.DataFrame({by: f[by], "n": f["n"], "vendi": [o[0] for o in out], "top_share": [o[1] for o in out]})

    return scatter(rows, by, True).select(by, "n", "gram").mapInPandas(finish, f"{by} string, n long, vendi double, top_share double")


def geometry(rows: DataFrame, by: str) -> DataFrame:
    """By group of unit rows: mean pairwise cosine, effective rank and participation ratio of the covariance, the mass of its
    largest one and ten eigenvalues, and its trace."""

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for s, g, n in zip(f["sums"], f["gram"], f["n"], strict=True):
                m = np.asarray(s) / n
                cov = np.asarray(g).reshape(len(m), len(m)) / n - np.outer(m, m)
                v = np.sort(np.maximum(np.linalg.eigvalsh(cov), 0))[::-1]
                t = v.sum()
                p = v[v > 0] / t if t > 0 else np.ones(1)
                pair = ((m @ m) * n - 1) / (n - 1) if n > 1 else 0.0
                out.append((pair, float(np.exp(-(p * np.log(p)).sum())), float(t * t / (v * v).sum()) if t > 0 else 0.0, float(v[0] / t) if t > 0 else 0.0, float(v[:10].sum() / t) if t > 0 else 0.0, float(t)))
            names = ["pairwise_cosine", "effective_rank", "participation", "top1", "top10", "trace"]
            yield pd.DataFrame({by: f[by], "n": f["n"], **{k: [o[i] for o in out] for i, k in enumerate(names)}})

    return scatter(rows, by, True).mapInPandas(finish, f"{by} string, n long, pairwise_cosine double, effective_rank double, participation double, top1 double, top10 double, trace double")


def score_summary(scores: DataFrame, value: str = "sim", thresholds: tuple[float, ...] = (0.5, 0.7, 0.9)) -> DataFrame:
    return scores.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), *[F.percentile(value, q).alias(f"p{int(q * 100)}") for q in (0.05, 0.5, 0.95)], *[F.avg((F.col(value) >= t).cast("double")).alias(f"ge_{int(t * 100)}") for t in thresholds])


def block_numbers(rows: DataFrame, size: int, seed: object = 0) -> DataFrame:
    """rows (id, ...) with a column block: rows in hash order cut into blocks of `size`, where a last block of less than half
    that size joins the one before. The order is sorted over all tasks; the counts of these give the places."""
    from ..sources.scratch import held

    h = F.sha2(F.concat_ws("\x00", F.lit(str(seed)), F.col("id").cast("string")), 256)
    part = held(rows.withColumn("_h", h).orderBy("_h", "id")).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    counts = {r["_p"]: r["count"] for r in part.groupBy("_p").count().collect()}
    n, starts = 0, {}
    for p in sorted(counts):
        starts[p] = n
        n += counts[p]
    full, tail = divmod(n, size)
    last = max(0, full - (2 * tail < size)) if full else 0
    start = F.create_map(*[F.lit(v) for kv in (starts or {0: 0}).items() for v in kv])[F.col("_p")]
    place = (start + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")
    return part.withColumn("block", F.least(F.floor(place / size), F.lit(last)).cast("long")).drop("_h", "_p", "_i")

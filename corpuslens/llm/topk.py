"""Exact top-k by inner product: candidates by descending length, pruned by rotated partial sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hash_sample, table
from .vectors import by_length

SCALE = 1024
#: Rows that the rotation is fitted on, longest rows that give the first bounds, and bytes of each at most.
SAMPLE, SEEDS, MODEL_BYTES = 5000, 4096, 16 << 20
#: Queries and bytes of their vectors that a task holds, and candidates that it goes through, about.
QUERIES, QUERY_BYTES, CANDIDATES = 65_536, 64 << 20, 1 << 20
#: Ranges of reach that queries are put into, rotated axes of the partial sums, candidates compared at once.
BANDS, HEAD, BLOCK = 16, 16, 2048
LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1
LIMIT = np.finfo(float).max


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as doubles, which hold these integers exactly; beyond the largest double, that one."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * x), -LIMIT, LIMIT)


def lengths(y: np.ndarray) -> np.ndarray:
    """Euclidean lengths that neither over- nor underflow: at most the largest double."""
    top = np.abs(y).max(1, initial=0.0)
    unit = np.where(top > 0, top, 1.0)
    with np.errstate(over="ignore"):
        return np.minimum(top * np.linalg.norm(y / unit[:, None], axis=1), LIMIT)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a with those of b, each kept within the long range.

    By doubles where all partial sums are exact in them, else by 64-bit integers where these cannot overflow, else by
    unbounded integers; rows of very different size are done apart.
    """
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    top_a, top_b = np.abs(a).max(1, initial=0.0), np.abs(b).max(1, initial=0.0)
    d = max(1, a.shape[1])
    with np.errstate(over="ignore"):
        if d * top_a.max() * top_b.max() < 2**53:
            return (a @ b.T).astype(np.int64)
        for top, flip in ((top_a, False), (top_b, True)):
            small = top < 2.0**20
            if small.any() and not small.all():
                out = np.empty((len(a), len(b)), np.int64)
                for own in (small, ~small):
                    if flip:
                        out[:, own] = products(a, b[own])
                    else:
                        out[own] = products(a[own], b)
                return out
        if max(top_a.max(), top_b.max()) < 2.0**62 and d * top_a.max() * top_b.max() < 2.0**62:
            return a.astype(np.int64) @ b.astype(np.int64).T
    whole_b = [[int(v) for v in y] for y in b.tolist()]
    rows = [[min(MOST_LONG, max(LEAST_LONG, sum(v * w for v, w in zip(x, y, strict=True)))) for y in whole_b] for x in ([int(v) for v in x] for x in a.tolist())]
    return np.array(rows, np.int64)


class Queries:
    """Query vectors of one length with lower bounds of their k-th scores.

    numbers: the row of each query, which is not its own candidate. Without a rotation there are no partial sums.
    """

    def __init__(self, numbers: np.ndarray, ids: pa.Array, y: np.ndarray, bound: np.ndarray, rotation: np.ndarray | None, k: int) -> None:
        self.numbers, self.ids, self.y, self.bound, self.rotation, self.k = numbers, ids, y, bound.copy(), rotation, k
        self.norm, self.huge = lengths(y), np.abs(y).max(1, initial=0.0) >= 2.0**40
        if rotation is not None:
            r = np.where(self.huge[:, None], 0.0, y) @ rotation
            self.head, self.rest = r[:, :HEAD], np.linalg.norm(r[:, HEAD:], axis=1)
        # (whether the id is null, id, score) of the best k so far
        self.kept = [(np.empty(0, bool), np.empty(0, np.int64), np.empty(0, np.int64))] * len(y)

    def live(self, longest: float) -> np.ndarray:
        """The queries that a candidate of this length could still serve: length times length reaches the bound."""
        with np.errstate(over="ignore"):
            return np.flatnonzero(self.norm * longest * (1 + 1e-9) + 1 >= self.bound)

    def offer(self, numbers: np.ndarray, null: np.ndarray, ids: np.ndarray, y: np.ndarray) -> bool:
        """Compare with candidates in descending length; whether any query was still open.

        The others take the partial sum over the first rotated axes plus the product of the residual lengths, which by
        Cauchy-Schwarz no score exceeds; only pairs that reach the bound get their full integer product. Bounds rise on
        the way. Slack covers rounding; equal scores are never pruned.
        """
        norm = lengths(y)
        live = self.live(norm.max())
        if not len(live):
            return False
        huge = np.abs(y).max(1, initial=0.0) >= 2.0**40
        if self.rotation is not None:
            r = np.where(huge[:, None], 0.0, y) @ self.rotation
            head, rest = r[:, :HEAD], np.linalg.norm(r[:, HEAD:], axis=1)
        for at in range(0, len(live), 512):
            own = live[at : at + 512]
            may = self.numbers[own][:, None] != numbers[None]
            if self.rotation is not None:
                upper = self.head[own] @ head.T + self.rest[own][:, None] * rest[None]
                with np.errstate(over="ignore"):
                    reach = upper + 1e-9 * self.norm[own][:, None] * norm[None] + 1 >= self.bound[own][:, None]
                may &= reach | huge[None] | self.huge[own][:, None]
            rows = np.flatnonzero(may.any(1))
            if not len(rows):
                continue
            cols = np.flatnonzero(may[rows].any(0))
            full = products(self.y[own[rows]], y[cols])
            hits = may[np.ix_(rows, cols)] & (full >= self.bound[own[rows]][:, None])
            for i in np.flatnonzero(hits.any(1)):
                n, hit = own[rows[i]], hits[i]
                new = (null[cols[hit]], ids[cols[hit]], full[i, hit])
                u, t, v = (np.concatenate(x) for x in zip(self.kept[n], new, strict=True))
                best = np.lexsort((t, u, ~v))[: self.k]  # ~v falls as v rises, the least long included
                self.kept[n] = (u[best], t[best], v[best])
                if len(best) == self.k:
                    kth = float(v[best[-1]])
                    self.bound[n] = max(self.bound[n], kth - abs(kth) * 2.0**-50)
        return True


def _sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (number, id, vec) with all components finite, and their lengths and sizes."""
    for batch in batches:
        for rows, x in by_length(batch.column(2)):
            at = pa.array(rows)
            yield pa.record_batch([*(batch.column(k).take(at) for k in range(3)), pa.array(lengths(scaled(x))), pa.array(np.full(len(rows), x.shape[1], np.int32))], names=["number", "id", "vec", "norm", "d"])


class Model:
    """What steers the pruning of the most frequent vector size d: a rotation and the longest candidates."""

    def __init__(self, d: int, sample: np.ndarray, seed_numbers: np.ndarray, seeds: np.ndarray) -> None:
        self.d, self.seed_numbers, self.seeds = d, seed_numbers, seeds
        y = scaled(sample) if len(sample) else np.zeros((1, d))
        y = y[np.abs(y).max(1, initial=0.0) < 2.0**40]
        self.rotation = np.linalg.svd(y.T @ y)[0] if d and len(y) else np.eye(d)

    def bounds(self, numbers: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        """A lower bound of each query's k-th score: its k-th among the seeds."""
        bound = np.full(len(y), -np.inf)
        if len(self.seeds) <= k:
            return bound
        for at in range(0, len(y), 256):
            s = products(y[at : at + 256], self.seeds).astype(float)
            s[numbers[at : at + 256][:, None] == self.seed_numbers[None]] = -np.inf
            kth = np.partition(s, -k, axis=1)[:, -k]
            bound[at : at + 256] = kth - np.abs(kth) * 2.0**-50  # a float of a long may lie above it by rounding
        return bound


def _bounded(model: Model, k: int):
    """The queries with their bounds and reach: the length from which on a candidate may count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d = batch.column(0).to_numpy(), batch.column(4).to_numpy()
            bound, norm = np.full(len(n), -np.inf), batch.column(3).to_numpy()
            for rows, x in by_length(batch.column(2)):
                if x.shape[1] == model.d:
                    bound[rows] = model.bounds(n[rows], scaled(x), k)
            with np.errstate(divide="ignore", invalid="ignore"):
                reach = np.where((bound > 0) & (d == model.d), (bound - 1) / norm / (1 + 1e-9) * (1 - 1e-9), -np.inf)
            yield pa.record_batch([*batch.columns, pa.array(bound), pa.array(np.maximum(np.nan_to_num(reach, nan=-np.inf, neginf=-1.0), -1.0))], names=["number", "id", "vec", "norm", "d", "bound", "reach"])

    return run


def _sent(groups: list[tuple[int, bool, float]], main: int, splits: int):
    """Candidates to the groups of queries that they may serve: (group number, of the main size, least reach)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm, own = batch.column(3).to_numpy(), batch.column(4).to_numpy() == main
            split = (batch.column(0).to_numpy() * 0x9E3779B1 >> 12) % splits
            for g, of_main, reach in groups:
                pick = np.flatnonzero((own == of_main) & (norm >= reach))
                if len(pick):
                    at = pa.array(pick)
                    cols = [batch.column(k).take(at) for k in (0, 1, 2, 3)]
                    yield pa.record_batch([pa.array(g * splits + split[pick]), *cols, pa.nulls(len(pick), pa.float64())], names=["g", "number", "id", "vec", "norm", "bound"])

    return run


def _search(rotation: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (g, number, id, vec, norm, bound) come sorted by g, queries first, then candidates by falling length."""
        last, held, queries, done = None, [], None, set()

        def opened() -> dict[int, Queries]:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            number, bound = t.column("number").to_numpy(), t.column("bound").to_numpy()
            return {x.shape[1]: Queries(number[r], t.column("id").chunk(0).take(pa.array(r)), scaled(x), bound[r], rotation if x.shape[1] == len(rotation) else None, k) for r, x in by_length(t.column("vec").chunk(0))}

        def closed() -> Iterator[pa.RecordBatch]:
            for q in (queries or {}).values():
                size = [len(x[0]) for x in q.kept]
                if sum(size):
                    of = pa.array(np.repeat(np.arange(len(size)), size))
                    u, t, v = (np.concatenate(x) for x in zip(*q.kept, strict=True))
                    yield pa.record_batch([pa.array(q.numbers).take(of), q.ids.take(of), pa.array(t, mask=u), pa.array(v)], names=["q", "query_id", "vec_id", "score"])

        for batch in batches:
            g, asks = batch.column(0).to_numpy(), batch.column(5).is_valid().to_numpy(zero_copy_only=False)
            if not len(g):
                continue
            kind = 2 * g + ~asks
            cuts = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(g)]))
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if g[s] != last:
                    yield from closed()
                    last, queries, done = g[s], None, set()
                    held.clear()
                if asks[s]:
                    held.append(batch.slice(s, e - s))
                    continue
                if queries is None:
                    queries = opened() if held else {}
                for at in range(s, e, BLOCK):
                    part = batch.slice(at, min(BLOCK, e - at))
                    number, ids = part.column(1).to_numpy(), part.column(2)
                    null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                    for r, x in by_length(part.column(3)):
                        d = x.shape[1]
                        if d in queries and d not in done and not queries[d].offer(number[r], null[r], ids[r], scaled(x)):
                            done.add(d)  # all that follows is shorter
        if queries is not None:
            yield from closed()

    return run


def top_products(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k highest integer inner products, exact, ties to the smaller id.

    Queries are the rows of `queries`, which are no candidates then, or the rows whose id is divisible by `every`;
    candidates are all rows but the query's own. A repeated row is a query and a candidate as often as it stands there.
    The longest candidates give each query a first bound, and so the length below which no candidate can serve it.
    Queries of like reach go to tasks in groups of at most about QUERIES; a candidate goes to the groups that it can
    reach, dealt out by splits of about CANDIDATES rows, and is met there in order of falling length. Neither queries
    nor candidates come to the driver, but for SAMPLE rows that the rotation is fitted on and SEEDS longest ones.

    Vectors that are null, empty or hold null or non-finite components take no part. Vectors are compared with those of
    their own size only; the most frequent size is pruned by seeds and rotation, others by length only. A row with a
    null id is a candidate, after all others in ties, and no query of its own. A score beyond the long range counts as
    the end of that range. A query without candidates has no rows; an empty table gives none; other columns are ignored.
    """
    spark = vectors.sparkSession
    number = F.monotonically_increasing_id().alias("number")

    def sound(df: DataFrame, sign: int) -> DataFrame:
        rows = df.select((sign * (number + 1)).alias("number"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
        kind = rows.schema["vec"].dataType.simpleString()
        return rows.mapInArrow(_sound, f"number long, id long, vec {kind}, norm double, d int")

    rows = table(sound(vectors, 1), "candidates")
    asked = table(sound(queries, -1), "queries") if queries is not None else rows.where(F.col("id") % every == 0)
    main = rows.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if main is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    d, n = main["d"], main["n"]
    own = rows.where(F.col("d") == d)
    most = max(k + 1, MODEL_BYTES // (8 * d))

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        t = t.combine_chunks()
        return t.column("number").to_numpy(), by_length(t.column("vec").chunk(0))[0][1] if len(t) else np.zeros((0, d))

    sample = matrix(hash_sample(own, min(SAMPLE, most), "number").select("number", "vec").toArrow())[1]
    # candidates for the seeds: those over a length that about twice as many rows reach
    seeds = min(SEEDS, most)
    least = own.agg(F.percentile_approx("norm", max(0.0, 1 - 2 * seeds / n), 10_000)).first()[0]
    seed_numbers, seed_rows = matrix(own.where(F.col("norm") >= least).orderBy(F.desc("norm"), "number").limit(seeds).select("number", "vec").toArrow())
    model = Model(d, sample, seed_numbers, scaled(seed_rows))

    kind = rows.schema["vec"].dataType.simpleString()
    asked = table(asked.mapInArrow(_bounded(model, k), f"number long, id long, vec {kind}, norm double, d int, bound double, reach double"), "bounded")
    of_main = F.col("d") == d
    room = max(1, min(QUERIES, QUERY_BYTES // (8 * d)))
    bands = min(BANDS, max(1, -(-asked.count() // room)))
    cuts = asked.where(of_main).agg(F.percentile_approx("reach", [(b + 1) / bands for b in range(bands - 1)], 1000)).first()[0] if bands > 1 else []
    band = F.lit(0)
    for c in cuts or []:
        band = band + (F.col("reach") > c).cast("int")
    asked = asked.withColumn("band", F.when(of_main, band).otherwise(F.lit(BANDS)))  # the last has the vectors of other sizes
    groups, first, base = [], [], 0
    for r in asked.groupBy("band").agg(F.count("*").alias("n"), F.min("reach").alias("reach"), F.max("d").alias("d")).orderBy("band").collect():  # at most BANDS + 1 rows
        some = -(-r["n"] // max(1, min(QUERIES, QUERY_BYTES // (8 * r["d"]))))
        first.append((r["band"], base, some))
        groups += [(base + j, r["band"] != BANDS, float(r["reach"]) if r["band"] != BANDS else -1.0) for j in range(some)]
        base += some
    if not groups:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits = max(1, -(-rows.count() // CANDIDATES), -(-parallel // len(groups)))
    base_of, some_of = (F.element_at(F.create_map(*[F.lit(v) for b, *x in first for v in (b, x[j])]), F.col("band")) for j in (0, 1))
    group = base_of + F.pmod(F.xxhash64("number"), some_of)
    tasks = asked.select("number", "id", "vec", "norm", "bound", group.alias("group"), F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"))
    tasks = tasks.select((F.col("group") * splits + F.col("split")).cast("long").alias("g"), "number", "id", "vec", "norm", "bound")
    sent = rows.mapInArrow(_sent(groups, d, splits), f"g long, number long, id long, vec {kind}, norm double, bound double")
    work = tasks.unionByName(sent).repartition(max(parallel, len(groups) * splits), "g")
    work = work.sortWithinPartitions("g", F.col("bound").isNull(), F.desc("norm"), "number")
    pairs = work.mapInArrow(_search(model.rotation, k), "q long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

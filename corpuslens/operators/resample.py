"""Bootstrap intervals and deterministic samples.

A draw never copies rows: replicates resample weights, and a replicate's statistic is a function of weighted sums.
"""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seed_of(*parts: object) -> int:
    """A seed that depends on the labels only, alike in every process."""
    return crc32("\x00".join(map(str, parts)).encode())


def bootstrap(df: DataFrame, by: str, values: list[str], statistic: Callable[[np.ndarray, np.ndarray], float], reps: int = 2000, seed: int = 0) -> DataFrame:
    """(by, n, estimate, mean, sd, low, high) of statistic(weighted sums of values, sum of weights) over rows resampled with
    replacement within each group; linear 2.5 and 97.5 percentiles, replicates without a value dropped. Groups are bounded
    samples (blocks, captions of a cell), one task each."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        key, x = f[by].iloc[0], f[values].to_numpy(np.float64)
        n = len(x)
        rng = np.random.default_rng(seed_of(seed, key))
        found = []
        for at in range(0, reps, 256):
            w = rng.multinomial(n, np.full(n, 1 / n), size=min(256, reps - at))
            found += [statistic(s, n) for s in w @ x]
        v = np.array([s for s in found if s is not None and np.isfinite(s)])
        est = statistic(x.sum(0), n)
        low, high = np.percentile(v, [2.5, 97.5]) if len(v) else (np.nan, np.nan)
        return pd.DataFrame({by: [str(key)], "n": [n], "estimate": [est], "mean": [v.mean() if len(v) else np.nan], "sd": [v.std(ddof=1) if len(v) > 1 else 0.0], "low": [low], "high": [high]})

    return df.select(F.col(by).cast("string").alias(by), *values).groupBy(by).applyInPandas(one, f"{by} string, n long, estimate double, mean double, sd double, low double, high double")


def mean_statistic(sums: np.ndarray, n: int) -> float:
    return sums[0] / n


def ratio_statistic(sums: np.ndarray, n: int) -> float | None:
    """100 sum(first) / sum(second)."""
    return 100 * sums[0] / sums[1] if sums[1] else None


def cluster_bootstrap(rows: DataFrame, cluster: str, sums: list[str], statistic: Callable[[np.ndarray], float | None], stratum: str | None = None, reps: int = 2000, seed: int = 0) -> pd.DataFrame:
    """Interval of statistic(sums) when whole clusters are drawn, within strata if given; a cluster in two strata is an error.

    Clusters are summed in Spark; only their sums, one row a cluster of a study of bounded size, meet on the driver.
    """
    s = F.col(stratum) if stratum else F.lit("all")
    g = rows.groupBy(cluster).agg(F.min(s).alias("stratum"), F.max(s).alias("high"), *[F.sum(c).alias(c) for c in sums]).orderBy(cluster).toPandas()
    if (g["stratum"] != g["high"]).any():
        raise ValueError("a cluster stands in two strata")
    x = g[sums].to_numpy(np.float64)
    rng = np.random.default_rng(seed)
    w = np.zeros((reps, len(x)))
    for _, own in g.groupby("stratum", sort=True):
        at = own.index.to_numpy()
        w[:, at] = rng.multinomial(len(at), np.full(len(at), 1 / len(at)), size=reps)
    v = np.array([r for r in (statistic(t) for t in w @ x) if r is not None and np.isfinite(r)])
    low, high = np.percentile(v, [2.5, 97.5]) if len(v) else (np.nan, np.nan)
    return pd.DataFrame({"clusters": [len(x)], "estimate": [statistic(x.sum(0))], "replicates": [len(v)], "mean": [v.mean() if len(v) else np.nan], "sd": [v.std(ddof=1) if len(v) > 1 else 0.0], "low": [low], "high": [high]})


def order_key(seed: object, *cols: Column) -> Column:
    """A hash that orders rows at random but alike everywhere."""
    return F.sha2(F.concat_ws("\x00", F.lit(str(seed)), *[c.cast("string") for c in cols]), 256)


def hash_sample(df: DataFrame, n: int, seed: object, key: str, restore: str | None = None) -> DataFrame:
    """The n rows with the smallest hashes, in the source order of `restore` if given."""
    out = df.orderBy(order_key(seed, F.col(key)), key).limit(n)
    return out.orderBy(restore) if restore else out


def modulo_split(df: DataFrame, count: int, index: int, row_index: str) -> DataFrame:
    return df.where(F.pmod(F.col(row_index), F.lit(count)) == index)


def stratified(df: DataFrame, strata: list[str], n: int, seed: object, key: str, declared: DataFrame | None = None) -> DataFrame:
    """n rows of each stratum by hash, with weight N / n of what was drawn. A stratum with fewer keeps all at weight one;
    with the strata that are declared, one that has fewer than n rows is an error that names it."""
    if declared is not None and (short := shortfalls(df, declared, strata, n).orderBy(*strata).limit(20).collect()):
        raise ValueError(f"strata with fewer than {n} rows: {[tuple(r) for r in short]}")
    w = Window.partitionBy(*strata).orderBy(order_key(seed, F.col(key)), key)
    ranked = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    sizes = df.groupBy(*strata).agg(F.count("*").alias("population"))
    return ranked.join(sizes, strata).withColumn("weight", F.col("population") / F.least("population", F.lit(n))).drop("rank")


def with_repeats(sample: DataFrame, share: float, seed: object, key: str, by: list[str]) -> DataFrame:
    """The sample and, for rater consistency, a second row of the ceil(share n) rows of each group `by` with the smallest
    hashes: repeat_of names the original, the key has :repeat behind it, and the weight is zero, so that no estimate counts
    a row twice."""
    w = Window.partitionBy(*by)
    ranked = sample.withColumn("_r", F.row_number().over(w.orderBy(order_key(f"{seed}:repeat", F.col(key)), key))).withColumn("_n", F.count("*").over(w))
    again = ranked.where(F.col("_r") <= F.ceil(F.col("_n") * share)).drop("_r", "_n")
    again = again.withColumn("repeat_of", F.col(key).cast("string")).withColumn(key, F.concat(F.col(key).cast("string"), F.lit(":repeat"))).withColumn("weight", F.lit(0.0))
    return sample.withColumn("repeat_of", F.lit(None).cast("string")).withColumn(key, F.col(key).cast("string")).unionByName(again)


def shortfalls(df: DataFrame, declared: DataFrame, strata: list[str], n: int) -> DataFrame:
    """Declared strata with fewer than n rows."""
    return declared.join(df.groupBy(*strata).agg(F.count("*").alias("have")), strata, "left").select(*strata, F.coalesce("have", F.lit(0)).alias("have")).where(F.col("have") < n)


def assign(items: DataFrame, participants: DataFrame, labels: int, seed: object) -> DataFrame:
    """Rendezvous hashing: for each item the `labels` participants with the smallest digests. Participants are few by design
    and form one array, so that items are never joined with them row by row."""
    crew = participants.select(F.sort_array(F.collect_set("participant")).alias("crew"))
    key = lambda p: F.sha2(F.concat_ws("\x00", F.lit(str(seed)), F.col("item").cast("string"), p.cast("string")), 256)
    j = items.select("item").distinct().join(F.broadcast(crew))
    ranked = F.slice(F.array_sort(F.transform("crew", lambda p: F.struct(key(p).alias("h"), p.alias("participant")))), 1, labels)
    return j.select("item", F.explode(ranked).alias("x")).select("item", "x.participant")


def spaced_order(tasks: DataFrame, by: list[str], seed: object) -> DataFrame:
    """From (by..., item, repeat_of): positions in which originals are ordered by hash and a repeat follows its original by at
    least max(10, ceil(n / 10)) places where the queue is long enough, else comes last."""
    schema = ", ".join([*(f"{b} string" for b in by), "item string, repeat_of string, position int"])

    def one(f: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        keys = [str(f[b].iloc[0]) for b in by]
        digest = lambda item: hashlib.sha256("\x00".join([str(seed), *keys, str(item)]).encode()).hexdigest()
        first = sorted(f.loc[f["repeat_of"].isna(), "item"], key=digest)
        queue: list[tuple[str, str | None]] = [(i, None) for i in first]
        gap = max(10, -(-len(first) // 10))
        for item, of in sorted(f.loc[f["repeat_of"].notna(), ["item", "repeat_of"]].itertuples(index=False), key=lambda r: digest(r[0])):
            at = next((k for k, (i, _) in enumerate(queue) if i == of), len(queue))
            queue.insert(min(len(queue), at + gap + 1), (item, of))
        return pd.DataFrame({**{b: [k] * len(queue) for b, k in zip(by, keys, strict=True)}, "item": [q[0] for q in queue], "repeat_of": [q[1] for q in queue], "position": range(len(queue))})

    return tasks.select(*[F.col(b).cast("string").alias(b) for b in by], F.col("item").cast("string").alias("item"), F.col("repeat_of").cast("string").alias("repeat_of")).groupBy(*by).applyInPandas(one, schema)



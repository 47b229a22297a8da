"""Support of captions and prompts on each other's n-grams: histograms, divergences, blocks and disjoint pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions import text as X

ALPHA, BUCKETS = 1e-12, 1 << 18


def histogram(frame: DataFrame, n: int, budget: int | None = None, by: tuple[str, ...] = ("surface",), buckets: int | None = None) -> DataFrame:
    """(by..., key, cnt): n-gram counts, of whole texts or of the first `budget` tokens; with buckets the key is the CRC-32
    bucket of the n-gram, else the n-gram. Absent keys are absent rows."""
    toks = F.slice("toks", 1, budget) if budget else F.col("toks")
    grams = frame.select(*by, F.explode(X.ngrams(toks, n)).alias("gram"))
    return grams.groupBy(*by, (X.bucket(F.col("gram"), buckets) if buckets else F.col("gram")).alias("key")).agg(F.count("*").alias("cnt"))


def compare(captions: DataFrame, prompts: DataFrame, by: tuple[str, ...] = ("surface",), alpha: float = ALPHA, buckets: int | None = None) -> DataFrame:
    """By group of captions against the one prompt histogram (key, cnt): masses on the other's support, KL both ways and
    JSD in nats, smoothed by alpha over all buckets. Without buckets the support is the union of keys.

    Only present keys are rows; the buckets that neither side has add a closed form. Every group meets the whole prompt
    histogram, so prompts are matched by key and what no caption of a group has is taken from the prompt's sums.
    """
    groups = captions.groupBy(*by).agg(F.sum("cnt").alias("a_total"), F.count("*").alias("a_keys"))
    prompt = prompts.groupBy("key").agg(F.sum("cnt").alias("p"))
    sums = prompt.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("p_total"), F.count("*").alias("p_keys"))
    joined = captions.groupBy(*by, "key").agg(F.sum("cnt").alias("a")).join(prompt, "key", "left").withColumn("p", F.coalesce("p", F.lit(0)))
    # prompt keys without captions in a group: their counts are all prompt counts less those matched
    counts = prompt.groupBy("p").agg(F.count("*").alias("all_keys"))
    matched = joined.where("p > 0").groupBy(*by, "p").agg(F.count("*").alias("hit_keys"))
    everything = groups.join(F.broadcast(sums))
    union = F.col("a_keys") + F.col("p_keys") - F.col("both")
    overlap = joined.groupBy(*by).agg(F.sum((F.col("p") > 0).cast("long")).alias("both"), F.sum(F.when(F.col("p") > 0, F.col("a")).otherwise(0)).alias("a_on_p"), F.sum("p").alias("p_on_a"))
    base = everything.join(overlap, list(by))
    base = base.withColumn("size", F.lit(float(buckets)) if buckets else union.cast("double"))
    a0 = F.col("a_total") + F.col("size") * alpha
    p0 = F.col("p_total") + F.col("size") * alpha
    base = base.withColumn("az", a0).withColumn("pz", p0)

    def terms(a: Column, p: Column) -> list[Column]:
        q, r = (a + alpha) / F.col("az"), (p + alpha) / F.col("pz")
        m = (q + r) / 2
        return [q * F.ln(q / r), r * F.ln(r / q), 0.5 * q * F.ln(q / m) + 0.5 * r * F.ln(r / m)]

    names = ["kl_ap", "kl_pa", "js"]
    scale = base.select(*by, "az", "pz")
    here = joined.join(scale, list(by)).groupBy(*by).agg(*[F.sum(t).alias(n) for t, n in zip(terms(F.col("a"), F.col("p")), names, strict=True)])
    lone = scale.join(F.broadcast(counts)).join(matched, [*by, "p"], "left").withColumn("k", F.col("all_keys") - F.coalesce("hit_keys", F.lit(0)))
    there = lone.groupBy(*by).agg(*[F.sum(F.col("k") * t).alias(f"{n}_lone") for t, n in zip(terms(F.lit(0), F.col("p")), names, strict=True)])
    out = base.join(here, list(by)).join(there, list(by), "left")
    rest = F.col("size") - union
    empty = terms(F.lit(0), F.lit(0))
    for t, n in zip(empty, names, strict=True):
        out = out.withColumn(n, F.col(n) + F.coalesce(f"{n}_lone", F.lit(0.0)) + rest * t)
    return out.select(
        *by, F.col("a_total").alias("caption_total"), F.col("p_total").alias("prompt_total"), F.col("a_keys").alias("caption_unique"), F.col("p_keys").alias("prompt_unique"), F.col("both").alias("overlap"),
        ((F.col("a_on_p") + alpha * F.col("p_keys")) / F.col("az")).alias("caption_mass_on_prompt"), ((F.col("p_on_a") + alpha * F.col("a_keys")) / F.col("pz")).alias("prompt_mass_on_caption"),
        F.col("kl_ap").alias("kl_caption_to_prompt"), F.col("kl_pa").alias("kl_prompt_to_caption"), F.col("js").alias("jsd"),
    )


def blocks(frame: DataFrame, size: int, row_index: str = "id") -> DataFrame:
    """Contiguous blocks of `size` rows by an index from 0; the last may be short."""
    return frame.withColumn("block", F.floor(F.col(row_index) / size))


def pools(frame: DataFrame, comparison: str, seed: int, count: int, fraction: float, key: str = "id") -> DataFrame:
    """Rows that fall into one of `count` disjoint pools of `fraction` each, by a hash of seed, comparison and key; the
    rest is dropped, as are null keys."""
    unit = hashing.unit_hash(F.concat(F.lit(f"{seed}:{comparison}:"), F.col(key).cast("string")))
    placed = frame.where(F.col(key).isNotNull()).withColumn("pool", F.floor(unit / fraction).cast("int"))
    return placed.where((F.col("pool") >= 0) & (F.col("pool") < count))


def stable_direction(low: Column, high: Column, below: str, above: str) -> Column:
    """A name for an interval that lies on one side of zero, else inconclusive."""
    return F.when(high < 0, below).when(low > 0, above).otherwise("inconclusive")

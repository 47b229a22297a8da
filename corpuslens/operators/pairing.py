"""Keyed pairing of caption sets, deduplication and latest-wins, with full accounting of rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row of each key, the first in the given order.

    An aggregate of the smallest (order, row) is combined before the shuffle, so that a frequent key is no group in one
    task; that is what a window over the key would be.
    """
    rest = [c for c in df.columns if c not in keys]
    ordered = [F.expr(o) if isinstance(o, str) else o for o in order]
    packed = df.select(*keys, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(ordered)]).alias("o"), F.struct(*[F.col(c) for c in rest]).alias("r"))
    return packed.groupBy(*keys).agg(F.min_by("r", "o").alias("r")).select(*keys, "r.*")


def last_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The last row of each key in the given order."""
    rest = [c for c in df.columns if c not in keys]
    ordered = [F.expr(o) if isinstance(o, str) else o for o in order]
    packed = df.select(*keys, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(ordered)]).alias("o"), F.struct(*[F.col(c) for c in rest]).alias("r"))
    return packed.groupBy(*keys).agg(F.max_by("r", "o").alias("r")).select(*keys, "r.*")


def latest_answered(df: DataFrame, key: str, pos: str, answered: Column) -> DataFrame:
    """The last row of each key, but never one without an answer if another has one. Null keys are dropped."""
    return last_by(df.where(F.col(key).isNotNull()), [key], answered.cast("int"), F.col(pos))


def keyed(df: DataFrame, key: Column, caption: Column, pos: str, mode: str = "str", **carry: Column) -> tuple[DataFrame, DataFrame]:
    """(first captioned row of each normalised key, counters): rows without key or caption and repeated keys are counted."""
    rows = df.select(X.normalize_key(key, mode).alias("key"), X.first_filled(caption).alias("caption"), F.col(pos).alias("pos"), *[c.alias(n) for n, c in carry.items()])
    good = rows.where("key is not null and caption is not null")
    kept = first_by(good, ["key"], "pos")
    keys = good.groupBy("key").agg(F.count("*").alias("n"))
    counts = rows.agg(F.count("*").alias("scanned"), F.sum(F.col("key").isNull().cast("long")).alias("missing_key"), F.sum((F.col("key").isNotNull() & F.col("caption").isNull()).cast("long")).alias("missing_caption"))
    dups = keys.agg(F.count("*").alias("accepted"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_key"))
    return kept, counts.join(F.broadcast(dups))


def attach_manifest(local: DataFrame, manifest: DataFrame, least_edge: int) -> tuple[DataFrame, DataFrame]:
    """local (key, ...) with the first manifest row (key, pos, width, height, ...) of its key, if its short edge is long
    enough; a failing first row rejects the key, later rows are not tried. Also (matched, missing, rejected)."""
    first = first_by(manifest, ["key"], "pos")
    joined = local.join(first.drop("pos").withColumn("found", F.lit(True)), "key", "left").withColumn("ok", X.short_edge_ok(F.col("width"), F.col("height"), least_edge))
    counts = joined.agg(F.count_if(F.expr("found and ok")).alias("matched"), F.count_if(F.expr("found is null")).alias("missing"), F.count_if(F.expr("found and not ok")).alias("rejected"))
    return joined.where("found and ok").drop("found", "ok"), counts


def attach_public(local: DataFrame, public: DataFrame) -> DataFrame:
    """local (key, lookup, pos, ...) with the first public (lookup, caption, pos) of its lookup key as public_caption; where
    several locals share a lookup key, the last of them holds it."""
    holder = last_by(local.where("lookup is not null"), ["lookup"], "pos")
    first = first_by(public.where("lookup is not null and trim(coalesce(caption, '')) <> ''").select("lookup", "caption", "pos"), ["lookup"], "pos")
    return holder.join(first.select("lookup", F.col("caption").alias("public_caption")), "lookup")


def common_keys(*frames: DataFrame) -> DataFrame:
    """Keys that stand in all frames, once each."""
    out = frames[0].select("key").distinct()
    for f in frames[1:]:
        out = out.join(f.select("key"), "key", "left_semi")
    return out


def four_way(a: DataFrame, b: DataFrame, c: DataFrame, by_url: DataFrame, manifest: DataFrame, most: int, seed: int) -> DataFrame:
    """Keys of a, b and c whose url (of c) stands in by_url (url); of these `most` in hash order; of those the ones whose url
    the manifest (url, stable_id) knows, where repeated urls must agree on the id. So the result may be smaller."""
    keys = common_keys(a, b).join(c.select("key", "url"), "key").join(by_url.select("url").distinct(), "url", "left_semi")
    taken = keys.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)).limit(most)
    ids = manifest.groupBy("url").agg(F.min("stable_id").alias("stable_id"), F.max("stable_id").alias("high")).where("stable_id = high").drop("high")
    return taken.join(ids, "url")


#: What agreement on each identity field is worth.
MATCH_POINTS = {"sha256": 16, "stable_id": 8, "sample_id": 4, "url": 2, "size": 1}


def scored_match(wanted: DataFrame, candidates: DataFrame, points: dict[str, int] | None = None) -> DataFrame:
    """wanted (key, fields) with the one candidate (key, cand, fields) that agrees best; none where the best score is zero or
    shared. A lone candidate is checked too."""
    points = points or MATCH_POINTS
    c = candidates.select("key", "cand", *[F.col(f).alias(f"c_{f}") for f in points])
    score = sum((F.when(F.col(f) == F.col(f"c_{f}"), F.lit(v)).otherwise(0) for f, v in points.items()), F.lit(0))
    scored = wanted.join(c, "key").select("key", "cand", score.alias("score")).groupBy("key", "score").agg(F.count("*").alias("n"), F.min("cand").alias("cand"))
    return last_by(scored, ["key"], "score").where("score > 0 and n = 1").select("key", "cand", "score")


def pending(items: DataFrame, done: DataFrame, key: str = "image_id") -> DataFrame:
    """Items whose key is not done."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def exactly_one(items: DataFrame, manifest: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, reason): why an item fails against the manifest: missing, repeated, url or suffix; null where it passes."""
    m = manifest.groupBy(key).agg(F.count("*").alias("n"), F.min("url").alias("m_url"), F.min("suffix").alias("m_suffix"))
    reason = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(~F.col("url").eqNullSafe(F.col("m_url")), "url").when(~F.col("suffix").eqNullSafe(F.col("m_suffix")), "suffix")
    return items.join(m, key, "left").select(key, reason.alias("reason"))


def prompt_pool(prompts: DataFrame, least: int, most: int, per_source: int | None = None) -> DataFrame:
    """(source, prompt, prompt_hash, tokens_lexical, raw_index): prompts normalised, the first of those equal without case,
    then safe ones with a token count in the range; at most per_source of each source by raw_index."""
    rows = prompts.select("source", X.normalize_prompt(F.col("prompt")).alias("prompt"), "raw_index").where("prompt <> ''")
    first = first_by(rows.withColumn("lower", F.lower("prompt")), ["source", "lower"], "raw_index")
    n = X.token_count(F.col("prompt"))
    kept = first.where(X.is_safe_prompt(F.col("prompt")) & n.between(least, most)).select("source", "prompt", F.sha2("lower", 256).alias("prompt_hash"), n.alias("tokens_lexical"), "raw_index")
    if per_source is None:
        return kept
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("raw_index"))).where(F.col("rank") <= per_source).drop("rank")


def set_difference(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Rows that only one side has, with side expected or observed."""
    return expected.subtract(observed).withColumn("side", F.lit("expected")).unionByName(observed.subtract(expected).withColumn("side", F.lit("observed")))


def overlaps(df: DataFrame, member: str, group: str) -> DataFrame:
    """Members that stand in more than one group; empty where the groups are disjoint."""
    return df.groupBy(member).agg(F.count_distinct(group).alias("groups")).where("groups > 1")


def build_pairs(local: DataFrame, manifest: DataFrame, public: DataFrame, least_edge: int, most: int | None = None, seed: int = 0, name: str = "pairs") -> tuple[DataFrame, DataFrame]:
    """The whole pairing: local (key, lookup, caption, pos) through the manifest's size gate, then to its public caption, at most
    `most` in hash order. Returns (pair_id, key, lookup, caption, public_caption, width, height) and the counts of all stages."""
    gated, counts = attach_manifest(local, manifest, least_edge)
    paired = attach_public(gated, public)
    out = paired.select(X.pair_id(F.lit(name), F.col("key").cast("string"), F.col("lookup").cast("string")).alias("pair_id"), "key", "lookup", "caption", "public_caption", "width", "height")
    counts = counts.join(F.broadcast(out.agg(F.count("*").alias("paired"))))
    if most is not None:
        out = out.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "pair_id"), 256), "pair_id").limit(most)
    return out, counts

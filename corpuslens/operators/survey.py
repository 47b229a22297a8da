"""Corpus survey: coverage, diversity, concentration, repetition and register by surface and token budget.

Operators take a caption frame (surface, id, text, toks) and aggregate in Catalyst; partial aggregation happens before
every shuffle, and n-grams are the only thing that is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

BUDGETS = (16, 32, 64, 128, 248, 256, 320)
TOP_KS = (10, 100, 1000)


def captions(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", surface: Column | None = None, lower: bool = True) -> DataFrame:
    """(surface, id, text, toks) of all rows; a null text has no tokens. The tokens come out of a generator of one row, which
    filters and projections above it are not merged into: each text is tokenised once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select((surface if surface is not None else F.lit("all")).alias("surface"), F.col(id_col).alias("id"), text.alias("text"), once(X.tokens(F.col(text_col), lower)).alias("toks"))


def once(value: Column) -> Column:
    """The value, computed once however often the columns above use it; one such column a select."""
    return F.explode(F.array(value))


def share(part: Column, whole: Column) -> Column:
    """A ratio that is 0 where nothing can be divided by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def lengths(frame: DataFrame) -> DataFrame:
    """By surface: captions, tokens, average, median, 95th percentile (linear), maximum and shares over fixed lengths."""
    n = F.size("toks")
    long_ones = [F.sum((n > b).cast("long")).alias(f"gt{b}") for b in (64, 128, 248, 320)]
    g = frame.groupBy("surface").agg(F.count("*").alias("captions"), F.sum(n).alias("tokens"), F.sum(F.length("text")).alias("chars"), F.percentile(n, 0.5).alias("p50"), F.percentile(n, 0.95).alias("p95"), F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"), *long_ones)
    return g.withColumn("avg_tokens", share(F.col("tokens"), F.col("captions"))).withColumn("avg_chars", share(F.col("chars"), F.col("captions")))


def budget_survey(frame: DataFrame, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """By surface and budget: coverage, truncation, retained share and gain per token over the budget before. The
    denominators are all captions. Budgets are an array that is exploded after the texts have become lengths."""
    rows = frame.select("surface", F.size("toks").alias("n"), F.explode(F.array(*[F.lit(b) for b in budgets])).alias("budget"))
    kept = F.least("n", "budget")
    g = rows.groupBy("surface", "budget").agg(
        F.count("*").alias("captions"), F.sum(kept).alias("budget_tokens"), F.sum((F.col("n") >= F.col("budget")).cast("long")).alias("meeting"),
        F.sum((F.col("n") > F.col("budget")).cast("long")).alias("truncated"), F.avg(kept / F.greatest("n", F.lit(1))).alias("retained"),
    )
    g = g.withColumn("avg_tokens", F.col("budget_tokens") / F.col("captions")).withColumn("coverage_rate", F.col("meeting") / F.col("captions")).withColumn("truncation_rate", F.col("truncated") / F.col("captions"))
    before = Window.partitionBy("surface").orderBy("budget")
    two = F.round("avg_tokens", 2)
    gain = (two - F.lag(two).over(before)) / F.greatest(F.col("budget") - F.lag("budget").over(before), F.lit(1))
    return g.withColumn("marginal_gain", gain)


def at_budget(frame: DataFrame, budget: int) -> DataFrame:
    return frame.withColumn("toks", F.slice("toks", 1, budget))


def gram_counts(frame: DataFrame, n: int) -> DataFrame:
    """(surface, item, cnt, first): n-gram counts with the first occurrence as (id, position), for ties."""
    grams = frame.select("surface", "id", F.posexplode(X.ngrams(F.col("toks"), n)).alias("pos", "item"))
    return grams.groupBy("surface", "item").agg(F.count("*").alias("cnt"), F.min(F.struct("id", "pos")).alias("first"))


def item_counts(frame: DataFrame, item: Column) -> DataFrame:
    """The same for one item a caption; captions without tokens are left out."""
    rows = frame.where(F.size("toks") > 0).select("surface", "id", item.alias("item"))
    return rows.groupBy("surface", "item").agg(F.count("*").alias("cnt"), F.min(F.struct(F.col("id"), F.lit(0).alias("pos"))).alias("first"))


def raw_prefix_counts(frame: DataFrame, n: int = 5) -> DataFrame:
    return item_counts(frame, X.prefix(F.col("toks"), n))


def content_prefix_counts(frame: DataFrame, n: int = 5, more: bool = False) -> DataFrame:
    """Captions that only hold leading words have no content prefix."""
    rest = frame.where(F.size("toks") > 0).select("surface", "id", once(X.content(F.col("toks"), more)).alias("toks"))
    return item_counts(rest, X.prefix(F.col("toks"), n))


def opening_counts(frame: DataFrame, n: int = 3) -> DataFrame:
    return item_counts(frame, X.opening(F.col("toks"), n))


def top_items(counts: DataFrame, k: int) -> DataFrame:
    """The k largest counts of each surface with their rank, ties by first occurrence."""
    w = Window.partitionBy("surface").orderBy(F.desc("cnt"), "first")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def concentration(counts: DataFrame, top_ks: tuple[int, ...] = TOP_KS) -> DataFrame:
    """By surface: total, distinct, distinct share, entropies, HHI and the masses of the top k counts.

    The top-k sums only need the number of items of each count, so that a histogram of counts, far smaller than the
    items, is what a window sorts.
    """
    hist = counts.groupBy("surface", "cnt").agg(F.count("*").alias("items"))
    w = Window.partitionBy("surface").orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("above", F.coalesce(F.sum("items").over(w), F.lit(0)))
    taken = [F.sum(F.col("cnt") * F.greatest(F.lit(0), F.least(F.col("items"), F.lit(k) - F.col("above")))).alias(f"top{k}") for k in top_ks]
    c = F.col("cnt").cast("double")
    g = hist.groupBy("surface").agg(F.sum(F.col("cnt") * F.col("items")).alias("total"), F.sum("items").alias("distinct_items"), F.sum(F.col("items") * c * F.ln(c)).alias("clnc"), F.sum(F.col("items") * F.col("cnt") * F.col("cnt")).alias("squares"), *taken)
    n = F.col("total").cast("double")
    g = g.withColumn("distinct_share", F.col("distinct_items") / F.greatest("total", F.lit(1))).withColumn("entropy", F.ln(n) - F.col("clnc") / n)
    g = g.withColumn("entropy_mm", F.col("entropy") + (F.col("distinct_items") - 1) / (2 * n)).withColumn("effective_vocab", F.exp("entropy")).withColumn("hhi", F.col("squares") / (n * n)).withColumn("effective_simpson", n * n / F.col("squares"))
    for k in top_ks:
        g = g.withColumn(f"top{k}_mass", F.col(f"top{k}") / n)
    return g.drop("clnc")


def repetition(frame: DataFrame, n: int) -> DataFrame:
    """By surface: within-caption n-gram statistics with both denominators: all captions with tokens and eligible ones."""
    rows = frame.where(F.size("toks") > 0).select("surface", "id", F.size("toks").alias("size"), X.ngrams(F.col("toks"), n).alias("grams"), F.xxhash64("id", "text").alias("row"))
    rows = rows.select("surface", (F.col("size") >= n).alias("eligible"), F.size("grams").alias("total"), F.size(F.array_distinct("grams")).alias("distinct_grams"), X.most_repeated(F.col("grams"), 1).alias("top"))
    g = rows.groupBy("surface").agg(
        F.count("*").alias("captions"), F.sum(F.col("eligible").cast("long")).alias("eligible"), F.sum((F.col("top") >= 2).cast("long")).alias("repeated"),
        F.avg(F.when(F.col("eligible"), F.col("distinct_grams") / F.col("total"))).alias("mean_distinct"), F.avg(F.when(F.col("eligible"), F.col("top"))).alias("mean_max_repeat"),
    )
    return g.withColumn("rate_all", share(F.col("repeated"), F.col("captions"))).withColumn("rate_eligible", share(F.col("repeated"), F.col("eligible")))


def balanced_top_mass(frame: DataFrame, n: int, k: int) -> DataFrame:
    """By surface: the mean over captions of the share of their n-grams in the surface's top k, ties by first occurrence.
    The top set has at most k rows a surface and joins by key."""
    grams = frame.select("surface", "id", F.explode(X.ngrams(F.col("toks"), n)).alias("item"))
    top = top_items(gram_counts(frame, n), k).select("surface", "item", F.lit(1).alias("hit"))
    per = grams.join(top, ["surface", "item"], "left").groupBy("surface", "id").agg(F.count("*").alias("total"), F.count("hit").alias("hits"))
    return per.groupBy("surface").agg(F.count("*").alias("captions"), F.avg(F.col("hits") / F.col("total")).alias("balanced_mass"))


def duplicates(frame: DataFrame) -> DataFrame:
    """By surface: unique rate, duplicate rate and mass, and the largest group of equal normalised captions."""
    c = frame.where(F.size("toks") > 0).groupBy("surface", F.sha2(F.array_join("toks", " "), 256).alias("key")).agg(F.count("*").alias("n"))
    g = c.groupBy("surface").agg(F.sum("n").alias("captions"), F.count("*").alias("unique_captions"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicated"), F.max("n").alias("max_count"))
    return g.withColumn("unique_rate", F.col("unique_captions") / F.col("captions")).withColumn("duplicate_rate", 1 - F.col("unique_captions") / F.col("captions")).withColumn("duplicate_mass", F.col("duplicated") / F.col("captions"))


def flag_rates(frame: DataFrame, flags: Column, names: list[str]) -> DataFrame:
    """(surface, name, hits, captions, rate) of an array column of names; captions are those with tokens. Names that never
    occur are kept at zero."""
    rows = frame.where(F.size("toks") > 0).select("surface", flags.alias("flags"))
    wide = rows.groupBy("surface").agg(F.count("*").alias("captions"), *[F.sum(F.array_contains("flags", n).cast("long")).alias(n) for n in names])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("hits")) for n in names])).alias("p")
    return wide.select("surface", "captions", pairs).select("surface", "p.name", "p.hits", "captions", share(F.col("p.hits"), F.col("captions")).alias("rate"))


def formatting(frame: DataFrame) -> DataFrame:
    return flag_rates(frame, X.formatting_hits(F.col("text")), list(X.FORMATTING))


def scripts(frame: DataFrame) -> DataFrame:
    return flag_rates(frame, X.script_hits(F.col("text")), list(X.SCRIPTS))


def violations(frame: DataFrame) -> DataFrame:
    return flag_rates(frame, X.violations(F.col("text")), list(X.VIOLATIONS)).withColumn("severity", X.severity(F.col("name")))


def violation_summary(frame: DataFrame) -> DataFrame:
    """By surface: captions with any code, and codes per 64 tokens averaged over captions."""
    rows = frame.where(F.size("toks") > 0).select("surface", F.size("toks").alias("n"), F.size(X.violations(F.col("text"))).alias("codes"))
    return rows.groupBy("surface").agg(F.count("*").alias("captions"), F.sum((F.col("codes") > 0).cast("long")).alias("violated"), F.avg((F.col("codes") > 0).cast("int") * 64 / F.col("n")).alias("indicator_per_64"), F.avg(F.col("codes") * 64 / F.col("n")).alias("codes_per_64"))


def violation_examples(frame: DataFrame, most: int = 20) -> DataFrame:
    """Up to `most` examples a code, those with the smallest ids."""
    rows = frame.where(F.size("toks") > 0).select("surface", "id", F.explode(X.violations(F.col("text"))).alias("code"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy("id", "surface"))).where(F.col("rank") <= most)


def lexicons(frame: DataFrame) -> DataFrame:
    """(surface, category, token_hits, caption_hits, captions, per_64)."""
    hits = X.lexicon_hits(F.col("toks"))
    rows = frame.where(F.size("toks") > 0).select("surface", F.size("toks").alias("n"), *[c.alias(k) for k, c in hits.items()])
    sums = [F.sum(k).alias(f"t_{k}") for k in hits] + [F.sum((F.col(k) > 0).cast("long")).alias(f"c_{k}") for k in hits]
    wide = rows.groupBy("surface").agg(F.count("*").alias("captions"), F.sum("n").alias("tokens"), *sums)
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.col(f"t_{k}").alias("token_hits"), F.col(f"c_{k}").alias("caption_hits")) for k in hits])).alias("p")
    return wide.select("surface", "captions", "tokens", pairs).select("surface", "p.*", "captions", (F.col("p.token_hits") / F.greatest("tokens", F.lit(1)) * 64).alias("per_64"))


def phrase_rates(frame: DataFrame, phrases: tuple[str, ...] = X.PHRASES) -> DataFrame:
    """(surface, name, hits, captions, rate) of phrases in the lower-cased text; all captions count."""
    low = F.lower("text")
    flags = F.filter(F.array(*[F.when(low.contains(p), F.lit(p.replace(" ", "_"))) for p in phrases]), lambda x: x.isNotNull())
    rows = frame.select("surface", F.array(F.lit("x")).alias("toks"), flags.alias("flags"))
    return flag_rates(rows, F.col("flags"), [p.replace(" ", "_") for p in phrases])


def curve_features(points: DataFrame, up: bool = True) -> DataFrame:
    """From (surface, budget, value): the share of the way from the worst to the best value at each budget, its trapezoid
    area over the range, and the budget at which 50, 75 and 90 per cent are first reached, linearly between budgets."""
    whole, order = Window.partitionBy("surface"), Window.partitionBy("surface").orderBy("budget")
    low, high = F.min("value").over(whole), F.max("value").over(whole)
    worst, best = (low, high) if up else (high, low)
    p = points.withColumn("worst", worst).withColumn("best", best)
    p = p.withColumn("progress", F.when(F.col("best") == F.col("worst"), 0.0).otherwise((F.col("value") - F.col("worst")) / (F.col("best") - F.col("worst"))))
    p = p.withColumn("b0", F.lag("budget").over(order)).withColumn("p0", F.lag("progress").over(order))

    def reached(t: float) -> Column:
        slope = (t - F.col("p0")) / (F.col("progress") - F.col("p0"))
        at = F.when(F.col("b0").isNull() | (F.col("progress") == F.col("p0")), F.col("budget").cast("double")).otherwise(F.round(F.col("b0") + slope * (F.col("budget") - F.col("b0")), 2))
        return F.min_by(F.when(F.col("progress") >= t, at), F.when(F.col("progress") >= t, F.col("budget"))).alias(f"budget_at_{int(t * 100)}")

    area = F.sum((F.col("budget") - F.col("b0")) * (F.col("progress") + F.col("p0")) / 2)
    span = F.greatest(F.max("budget") - F.min("budget"), F.lit(1))
    auc = F.when(F.count("*") >= 2, area / span).otherwise(F.max("progress"))
    return p.groupBy("surface").agg(auc.alias("auc"), reached(0.5), reached(0.75), reached(0.9), F.max("best").alias("best"), F.max("worst").alias("worst"))


def mean_ci(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and its normal 95 % interval; one value gives a point, none gives zero."""
    g = df.groupBy(*by).agg(F.count(value).alias("n"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    half = F.when(F.col("n") > 1, 1.96 * F.col("sd") / F.sqrt("n")).otherwise(F.lit(0.0))
    return g.select(*by, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def paired_deltas(pairs: DataFrame, budget: int = 64, k: int = 100) -> DataFrame:
    """From (pair, local, reference): mean and interval of the differences local - reference of eight metrics.

    The side's own top-k content prefixes and trigrams at the budget come from grouped counts and join back by key.
    """
    pairs = pairs.select("pair", "local", "reference")
    sides = pairs.select("pair", F.explode(F.array(*[F.struct(F.lit(s).alias("surface"), F.coalesce(F.col(s), F.lit("")).alias("text")) for s in ("local", "reference")])).alias("s")).select("pair", "s.*")
    frame = sides.select("surface", F.col("pair").alias("id"), "text", X.tokens(F.col("text")).alias("full")).withColumn("toks", F.slice("full", 1, budget))
    prefix = X.prefix(X.content(F.col("toks")), 5)
    rows = frame.select("surface", "id", "toks", "text", prefix.alias("item"), F.size("full").alias("n"))
    prefixes = rows.groupBy("surface", "item").agg(F.count("*").alias("cnt"), F.min(F.struct(F.col("id"), F.lit(0).alias("pos"))).alias("first"))
    top_prefix = top_items(prefixes, k).select("surface", "item", F.lit(1.0).alias("hit"))
    grams = rows.select("surface", "id", F.explode(X.ngrams(F.col("toks"), 3)).alias("gram"))
    top_gram = top_items(gram_counts(rows, 3), k).select("surface", F.col("item").alias("gram"), F.lit(1).alias("in_top"))
    fractions = grams.join(top_gram, ["surface", "gram"], "left").groupBy("surface", "id").agg((F.count("in_top") / F.count("*")).alias("fraction"))
    codes = X.residue_codes(F.col("text"))
    metrics = {
        "avg_lexical_tokens": F.col("n").cast("double"), "elig64": (F.col("n") >= 64).cast("double"), "elig128": (F.col("n") >= 128).cast("double"), "rep4_at64": (X.most_repeated(F.col("toks"), 4) >= 2).cast("double"),
        "fast_full_j_meta_statement": F.array_contains(codes, "J_meta_statement").cast("double"), "fast_full_i_overlay_meta_leak": F.array_contains(codes, "I_overlay_meta_leak").cast("double"),
        "content_prefix_top100_hit": F.coalesce("hit", F.lit(0.0)), "m3_top100_fraction_at64": F.coalesce("fraction", F.lit(0.0)),
    }
    wide = rows.join(top_prefix, ["surface", "item"], "left").join(fractions, ["surface", "id"], "left")
    long_rows = wide.select("surface", "id", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in metrics.items()])).alias("m")).select("surface", "id", "m.*")
    sign = F.when(F.col("surface") == "local", F.col("value")).otherwise(-F.col("value"))
    return mean_ci(long_rows.groupBy("metric", "id").agg(F.sum(sign).alias("delta")), ["metric"], "delta")


def truncation(sizes: DataFrame, limits: tuple[int, ...]) -> DataFrame:
    """From (surface, n), token counts of any tokenizer: the share over each limit, and the 50th, 90th, 95th and 99th nearest-rank
    quantiles at (n - 1) q, rounded half to even."""
    # a window over a histogram of the sizes, not over the captions
    w = Window.partitionBy("surface")
    r = sizes.groupBy("surface", "n").agg(F.count("*").alias("c"))
    r = r.withColumn("upto", F.sum("c").over(w.orderBy("n"))).withColumn("rows", F.sum("c").over(w))
    quantiles = [F.min(F.when(F.col("upto") > F.rint((F.col("rows") - 1) * q), F.col("n"))).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.95, 0.99)]
    return r.groupBy("surface").agg(F.sum("c").alias("captions"), F.max("n").alias("max_n"), *quantiles, *[(F.sum(F.when(F.col("n") > b, F.col("c")).otherwise(0)) / F.sum("c")).alias(f"over_{b}") for b in limits])


def word_lengths(frame: DataFrame) -> DataFrame:
    """By surface: mean, median, least and most white-space words of captions with any."""
    n = frame.select("surface", F.size(X.words(F.col("text"))).alias("n")).where("n > 0")
    return n.groupBy("surface").agg(F.count("*").alias("captions"), F.avg("n").alias("mean_words"), F.percentile("n", 0.5).alias("median_words"), F.min("n").alias("min_words"), F.max("n").alias("max_words"))


def accept_by_hash(key: Column) -> Column:
    """A down-sampling rule whose threshold lets practically every hash pass; kept as what it does."""
    return key.isNotNull()

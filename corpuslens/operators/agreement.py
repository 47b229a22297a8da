"""Agreement of raters and judges. A ratio without a denominator is null here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-12


def confusion(pairs: DataFrame, by: list[str] | None = None, a: str = "a", b: str = "b", weight: str | None = None) -> DataFrame:
    """(by..., a, b, w): the weight of each pair of labels; pairs with a null label are left out."""
    w = F.sum(weight) if weight else F.count("*").cast("double")
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*(by or []), F.col(a).alias("a"), F.col(b).alias("b")).agg(w.cast("double").alias("w"))


def symmetrized(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The confusion of unordered pairs: half a pair in each direction."""
    by = by or []
    rows = pairs.where("a is not null and b is not null").select(*by, F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    return rows.groupBy(*by, "p.a", "p.b").agg((F.count("*") / 2).alias("w"))


def nominal(matrix: DataFrame, by: list[str] | None = None, categories: int | None = None) -> DataFrame:
    """By group of a confusion matrix: total, exact agreement, Cohen's kappa and Gwet's AC1; null where undefined.

    categories is the number of declared categories; without it those that occur count. AC1 needs two.
    """
    by = by or []
    one = matrix if by else matrix.withColumn("_all", F.lit(1))
    keys = by or ["_all"]
    sides = one.select(*keys, F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("w").alias("r"), F.lit(0.0).alias("s")), F.struct(F.col("b").alias("c"), F.lit(0.0).alias("r"), F.col("w").alias("s")))).alias("m"), "w").select(*keys, "m.*")
    margins = sides.groupBy(*keys, "c").agg(F.sum("r").alias("r"), F.sum("s").alias("s"))
    total = one.groupBy(*keys).agg(F.sum("w").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("same"))
    chance = margins.join(total, keys).where("total > 0").groupBy(*keys).agg(
        F.sum(F.col("r") / F.col("total") * F.col("s") / F.col("total")).alias("pe"),
        F.sum((F.col("r") + F.col("s")) / (2 * F.col("total")) * (1 - (F.col("r") + F.col("s")) / (2 * F.col("total")))).alias("spread"), F.count("*").alias("k"),
    )
    j = total.join(chance, keys, "left")
    k = F.lit(categories) if categories else F.col("k")
    po = F.when(F.col("total") > 0, F.col("same") / F.col("total"))
    ac = F.when(k > 1, F.col("spread") / (k - 1))
    chance_kappa = F.when(F.abs(1 - F.col("pe")) > TINY, (po - F.col("pe")) / (1 - F.col("pe")))
    out = j.select(*keys, "total", po.alias("exact"), chance_kappa.alias("kappa"), F.when(F.abs(1 - ac) > TINY, (po - ac) / (1 - ac)).alias("ac1"))
    return out if by else out.drop("_all")


def binary(pairs: DataFrame, by: list[str] | None = None, positive: str = "yes", negative: str = "no", abstentions: tuple[str, ...] = ("uncertain",), weight: str | None = None) -> DataFrame:
    """Agreement on yes/no pairs with abstentions counted apart, and the specific agreements. An unknown label is an error."""
    by = by or []
    known = (positive, negative, *abstentions)
    checked = lambda c: F.when(F.col(c).isin(*known), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(F.col(c).cast("string"), F.lit("null")))))
    rows = pairs.select(*by, checked("a").alias("a"), checked("b").alias("b"), (F.col(weight) if weight else F.lit(1.0)).alias("w"))
    kept = F.col("a").isin(positive, negative) & F.col("b").isin(positive, negative)
    cell = lambda x, y: F.sum(F.when((F.col("a") == x) & (F.col("b") == y), F.col("w")).otherwise(0.0))
    g = rows.groupBy(*by).agg(
        F.count("*").alias("pairs"), F.count_if(kept).alias("decided"), F.count_if(F.col("a").isin(*abstentions)).alias("abstained_a"), F.count_if(F.col("b").isin(*abstentions)).alias("abstained_b"), F.count_if(F.col("a").isin(*abstentions) & F.col("b").isin(*abstentions)).alias("abstained_both"),
        cell(positive, positive).alias("pp"), cell(positive, negative).alias("pn"), cell(negative, positive).alias("np"), cell(negative, negative).alias("nn"),
    )
    n = F.col("pp") + F.col("pn") + F.col("np") + F.col("nn")
    pos, neg = 2 * F.col("pp") + F.col("pn") + F.col("np"), 2 * F.col("nn") + F.col("pn") + F.col("np")
    return g.withColumn("exact", F.when(n > 0, (F.col("pp") + F.col("nn")) / n)).withColumn("positive_agreement", F.when(pos > 0, 2 * F.col("pp") / pos)).withColumn("negative_agreement", F.when(neg > 0, 2 * F.col("nn") / neg))


def consensus(labels: DataFrame, by: list[str], label: str = "label", abstentions: tuple[str, ...] = (), least: int = 2) -> DataFrame:
    """By group the label of more than half of at least `least` ratings that are no abstentions; else null."""
    real = F.col(label).isNotNull() & ~F.col(label).isin(*abstentions) if abstentions else F.col(label).isNotNull()
    n = labels.groupBy(*by, label).agg(F.count("*").alias("n")).withColumn("real", real)
    g = n.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("real"), F.col("n"))), F.lit(0)).alias("raters"), F.max(F.when(F.col("real"), F.col("n"))).alias("top"), F.max_by(F.when(F.col("real"), F.col(label)), F.when(F.col("real"), F.col("n"))).alias("winner"))
    return g.select(*by, "raters", F.when((F.col("raters") >= least) & (2 * F.col("top") > F.col("raters")), F.col("winner")).alias("consensus"))


def weighted_proportion(df: DataFrame, by: list[str] | None, positive: Column, outcome: str, weight: str) -> DataFrame:
    """Share of the weight on positive outcomes; null outcomes are left out, zero weight gives null."""
    rows = df.where(F.col(outcome).isNotNull())
    g = rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.sum(weight).alias("weight"), F.sum(F.when(positive, F.col(weight)).otherwise(0.0)).alias("positive_weight"))
    return g.withColumn("proportion", F.when(F.col("weight") > 0, F.col("positive_weight") / F.col("weight")))


def rater_pairs(ratings: DataFrame, item: str = "item_id", rater: str = "rater", label: str = "label") -> DataFrame:
    """(item, rater_a, rater_b, a, b) for all pairs of raters of an item in order. A repeated rating is an error; panels are
    small by design, so an item's ratings are one array."""
    g = ratings.where(F.col(label).isNotNull()).groupBy(item, rater).agg(F.count("*").alias("n"), F.min(label).alias("label"))
    g = g.withColumn("label", F.when(F.col("n") == 1, F.col("label")).otherwise(F.raise_error(F.lit("repeated rating"))))
    panel = g.groupBy(item).agg(F.array_sort(F.collect_list(F.struct(F.col(rater).alias("rater"), "label"))).alias("p"))
    pairs = F.flatten(F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda y: F.struct(x["rater"].alias("rater_a"), y["rater"].alias("rater_b"), x["label"].alias("a"), y["label"].alias("b")))))
    return panel.select(item, F.explode(pairs).alias("x")).select(item, "x.*")


def pairwise_kappa(pairs: DataFrame, categories: int | None = None) -> DataFrame:
    """Kappa of each pair of raters and, weighted by its items, their mean over pairs that have one (a row with null raters)."""
    per = nominal(confusion(pairs, ["rater_a", "rater_b"]), ["rater_a", "rater_b"], categories)
    ok = F.col("kappa").isNotNull()
    mean = per.agg(F.sum("total").alias("total"), (F.sum(F.col("total") * F.col("exact")) / F.sum("total")).alias("exact"), (F.sum(F.when(ok, F.col("total") * F.col("kappa"))) / F.sum(F.when(ok, F.col("total")))).alias("kappa"), F.lit(None).cast("double").alias("ac1"))
    return per.unionByName(mean.select(F.lit(None).cast("string").alias("rater_a"), F.lit(None).cast("string").alias("rater_b"), "total", "exact", "kappa", "ac1"))


def judge_human(rows: DataFrame, human: str = "human", judge: str = "judge", weight: str = "weight") -> DataFrame:
    """Overall, by category, by surface and by both (grouping sets): n, weighted and unweighted agreement, precision, recall,
    specificity and NPV of yes; rows where either says neither yes nor no are left out."""
    rows = rows.where(F.col(human).isin("yes", "no") & F.col(judge).isin("yes", "no"))
    c = lambda h, j: F.count_if((F.col(human) == h) & (F.col(judge) == j))
    g = rows.groupingSets([[F.col("category"), F.col("surface")], [F.col("category")], [F.col("surface")], []], F.col("category"), F.col("surface")).agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), c("yes", "yes").alias("tp"), c("no", "yes").alias("fp"), c("yes", "no").alias("fn"), c("no", "no").alias("tn"),
        F.sum(weight).alias("w"), F.sum(F.when(F.col(human) == F.col(judge), F.col(weight)).otherwise(0.0)).alias("w_same"),
    )
    r = lambda x, y: F.when(y > 0, x / y)
    return g.withColumn("agreement", r(F.col("tp") + F.col("tn"), F.col("n"))).withColumn("weighted_agreement", r(F.col("w_same"), F.col("w"))).withColumn("precision", r(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", r(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("specificity", r(F.col("tn"), F.col("tn") + F.col("fp"))).withColumn("npv", r(F.col("tn"), F.col("tn") + F.col("fn")))


def equal_cell_macro(rows: DataFrame, declared: DataFrame, cell: list[str], label: str = "label") -> DataFrame:
    """The mean over declared cells of yes / (yes + no); null if a declared cell has neither."""
    g = rows.groupBy(*cell).agg(F.count_if(F.col(label) == "yes").alias("yes"), F.count_if(F.col(label) == "no").alias("no"))
    j = declared.select(*cell).distinct().join(g, cell, "left").withColumn("p", F.when(F.col("yes") + F.col("no") > 0, F.col("yes") / (F.col("yes") + F.col("no"))))
    return j.agg(F.count("*").alias("cells"), F.count("p").alias("filled"), F.when(F.count("p") == F.count("*"), F.avg("p")).alias("macro"))


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The smallest value at which the running weight reaches half of all weight; equal values are summed first."""
    v = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*by, value).agg(F.sum(weight).alias("w"))
    run = v.withColumn("run", F.sum("w").over(Window.partitionBy(*by).orderBy(value))).withColumn("total", F.sum("w").over(Window.partitionBy(*by)))
    return run.where(2 * F.col("run") >= F.col("total")).groupBy(*by).agg(F.min(value).alias("median"))


def ordinal_agreement(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of numeric pairs (a, b): exact share, share within one, median absolute difference."""
    d = F.abs(F.col("a") - F.col("b"))
    g = pairs.where("a is not null and b is not null").groupBy(*(by or [])).agg(F.count("*").alias("pairs"), F.count_if(d == 0).alias("exact"), F.count_if(d <= 1).alias("within_one"), F.percentile(d, 0.5).alias("median_difference"))
    return g.withColumn("exact_share", F.when(F.col("pairs") > 0, F.col("exact") / F.col("pairs"))).withColumn("within_one_share", F.when(F.col("pairs") > 0, F.col("within_one") / F.col("pairs")))


def suppress_small(marginals: DataFrame, least: int = 3) -> DataFrame:
    """From (field, value, n): the same, but null for all of a field's cells if one of them is smaller than `least`."""
    low = marginals.groupBy("field").agg(F.min("n").alias("low"))
    return marginals.join(low, "field").select("field", "value", F.when(F.col("low") >= least, F.col("n")).alias("n"))


def field_agreement(rows: DataFrame, field: str, phase: str, reps: int = 2000, seed: int = 0) -> DataFrame:
    """One row (field, phase, items, pairs, clusters, exact, low, high): of rater pairs of the same item of a phase, the share
    that gives the same value, with the interval of draws of whole item groups. rows has (item_id, item_group, phase,
    participant, <field>, repeat_of); repeats and missing values are left out. Fields without pairs have null results."""
    from . import resample

    first = rows.where((F.col("phase") == phase) & F.col("repeat_of").isNull() & F.col(field).isNotNull())
    labels = first.groupBy("item_id", "participant").agg(F.min("item_group").alias("item_group"), F.max(F.col(field).cast("string")).alias("label"))
    # a pair of raters agrees or not: counts of each label say how many, without a join of raters
    n = labels.groupBy("item_group", "item_id", "label").agg(F.count("*").alias("n"))
    items = n.groupBy("item_group", "item_id").agg(F.sum("n").alias("raters"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same")).where("raters > 1")
    items = items.withColumn("pairs", F.col("raters") * (F.col("raters") - 1) / 2)
    found = resample.cluster_bootstrap(items, "item_group", ["same", "pairs"], lambda s: s[0] / s[1] if s[1] else None, reps=reps, seed=seed).iloc[0]
    total = items.agg(F.count("*").alias("items"), F.sum("pairs").cast("long").alias("pairs"))
    known = bool(found["clusters"])
    out = [F.lit(float(found[c]) if known else None).cast("double").alias(a) for c, a in (("estimate", "exact"), ("low", "low"), ("high", "high"))]
    return total.select(F.lit(field).alias("field"), F.lit(phase).alias("phase"), "items", F.coalesce("pairs", F.lit(0)).cast("long").alias("pairs"), F.lit(int(found["clusters"])).cast("long").alias("clusters"), *out)


def sample_summary(rows: DataFrame) -> DataFrame:
    """By phase and in all (phase null): annotations, items, repeats, participants and item groups of (phase, item_id,
    participant, item_group, repeat_of)."""
    return rows.cube("phase").agg(
        F.count("*").alias("annotations"), F.count_distinct(F.when(F.col("repeat_of").isNull(), F.col("item_id"))).alias("items"), F.count_distinct(F.when(F.col("repeat_of").isNotNull(), F.col("item_id"))).alias("repeats"),
        F.count_distinct("participant").alias("participants"), F.count_distinct("item_group").alias("clusters"),
    )


def export_metrics(rows: DataFrame, fields: dict[str, str], reps: int = 2000, seed: int = 0) -> DataFrame:
    """(field, phase, metric, value): the agreement of each field in its phase, and the sample's counts, in long form."""
    counts = sample_summary(rows).withColumn("phase", F.coalesce("phase", F.lit("all")))
    names = ["annotations", "items", "repeats", "participants", "clusters"]
    out = counts.select(F.lit("sample").alias("field"), "phase", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["field", "phase"], names, "metric", "value")
    for field, phase in fields.items():
        one = field_agreement(rows, field, phase, reps, seed)
        names = ["items", "pairs", "clusters", "exact", "low", "high"]
        out = out.unionByName(one.select("field", "phase", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["field", "phase"], names, "metric", "value"))
    return out


def ordered(rows: DataFrame, column: str, ranks: tuple[str, ...], *then: str) -> DataFrame:
    """Report rows with the named values of a column first, in their order, unknown ones after, then by other columns."""
    place = F.lit(len(ranks))
    for k, name in enumerate(ranks):
        place = F.when(F.col(column) == name, F.lit(k)).otherwise(place)
    return rows.orderBy(place, column, *then)

"""Claims, questions and judge answers: yield, deduplication rules, support and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import held

ANSWERS = ("yes", "no", "uncertain")
STATUSES = ("supported", "contradicted", "not_visible", "uncertain", "not_visual", "invalid")


def ratio(part: Column, whole: Column) -> Column:
    """A ratio that is 0 without a denominator."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def explode_claims(rows: DataFrame, claims: str = "claims") -> DataFrame:
    """A row for each claim of a known category with a unit, with its place idx; other columns stay."""
    out = rows.select(*[c for c in rows.columns if c != claims], F.posexplode(claims).alias("idx", "c"))
    out = out.select(*[c for c in out.columns if c != "c"], "c.category", "c.unit", "c.target")
    return out.where(F.col("category").isin(*X.CATEGORIES) & F.col("unit").isNotNull())


def claim_keys(claims: DataFrame) -> DataFrame:
    """The key parts of the lexical dedup rules: category, unit and target without leading articles."""
    return claims.withColumn("norm", X.unit_norm(F.col("unit"))).withColumn("target_norm", X.unit_norm(F.coalesce("target", F.lit(""))))


def deduplicated(claims: DataFrame, caption: list[str], drop_absent_text: bool = True) -> DataFrame:
    """By caption: claimed, deduped, duplicates and suspicious (text claims that say there is no text).

    Claims whose unit has no tokens only count as claimed. With drop_absent_text suspicious claims are not in deduped.
    """
    k = claim_keys(claims)
    per = k.groupBy(*caption, "category", "norm", "target_norm").agg(F.count("*").alias("n"))
    absent = F.lit(False)
    for marker in X.ABSENT_TEXT:
        absent = absent | F.col("norm").contains(marker)
    per = per.withColumn("suspicious", (F.col("category") == "text_rendering") & absent).withColumn("real", F.col("norm") != "")
    kept = F.col("real") & (~F.col("suspicious") if drop_absent_text else F.lit(True))
    return per.groupBy(*caption).agg(F.sum("n").alias("claimed"), F.count_if(kept).alias("deduped"), F.sum(F.when(F.col("real"), F.col("n") - 1).otherwise(0)).alias("duplicates"), F.count_if(F.col("real") & F.col("suspicious")).alias("suspicious"))


def builder_dedup(claims: DataFrame, caption: list[str]) -> DataFrame:
    """The third rule: unit and target without case and with white space squeezed; the first place of each key stays."""
    squeeze = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))
    k = claims.withColumn("u", squeeze(F.col("unit"))).withColumn("t", squeeze(F.col("target")))
    return k.groupBy(*caption, "category", "u", "t").agg(F.min("idx").alias("idx")).where("u <> ''").withColumnRenamed("u", "unit").withColumnRenamed("t", "target")


def claimed_summary(captions: DataFrame, per_caption: DataFrame, key: str = "caption_id") -> DataFrame:
    """By surface and for all (__all__): sums, claims a caption and per 100 tokens (a ratio of sums), duplicate and suspicious
    rates. Captions without claims count."""
    j = captions.join(per_caption, key, "left").fillna(0, ["claimed", "deduped", "duplicates", "suspicious"])
    g = j.groupBy("surface").agg(*aggregates()).unionByName(j.groupBy(F.lit("__all__").alias("surface")).agg(*aggregates()))
    return g.withColumn("claimed_per_caption", ratio(F.col("claimed"), F.col("captions"))).withColumn("deduped_per_caption", ratio(F.col("deduped"), F.col("captions"))).withColumn("deduped_per_100", F.when(F.col("tokens") > 0, 100 * F.col("deduped") / F.col("tokens")))


def aggregates() -> list[Column]:
    return [F.count("*").alias("captions"), F.sum("tokens").alias("tokens"), *[F.sum(c).alias(c) for c in ("claimed", "deduped", "duplicates", "suspicious")], F.count_if(F.col("duplicates") > 0).alias("rows_with_duplicate"), F.count_if(F.col("suspicious") > 0).alias("rows_with_suspicious")]


def grounded_summary(units: DataFrame) -> DataFrame:
    """From (surface, verdict in grounded, unsupported, uncertain): shares of all units; null without units."""
    sums = [F.count_if(F.col("verdict") == v).alias(v) for v in ("grounded", "unsupported", "uncertain")]
    g = units.groupBy("surface").agg(F.count("*").alias("claimed"), *sums)
    return g.withColumn("precision", F.col("grounded") / F.col("claimed")).withColumn("unsupported_rate", F.col("unsupported") / F.col("claimed")).withColumn("uncertain_rate", F.col("uncertain") / F.col("claimed"))


def status_rates(units: DataFrame) -> DataFrame:
    """By surface and category: counts of the six statuses, rates over all units and over visual ones."""
    g = units.groupBy("surface", "category").agg(F.count("*").alias("units"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    g = g.withColumn("visual", F.col("units") - F.col("not_visual"))
    for s in STATUSES:
        g = g.withColumn(f"{s}_rate", ratio(F.col(s), F.col("units"))).withColumn(f"{s}_visual_rate", ratio(F.col(s), F.col("visual")))
    return g


def answers(rows: DataFrame, questions: str = "questions", results: str = "results") -> DataFrame:
    """A row for each known answer with the category of its question in the same response, else __unknown__."""
    look = F.map_from_entries(F.transform(F.array_distinct(F.transform(questions, lambda q: q["question_id"])), lambda i: F.struct(i.alias("k"), F.element_at(F.transform(F.filter(questions, lambda q: q["question_id"] == i), lambda q: q["category"]), -1).alias("v"))))
    out = rows.select(*[c for c in rows.columns if c not in (questions, results)], look.alias("look"), F.explode(results).alias("r"))
    out = out.where(F.col("r.answer").isin(*ANSWERS))
    return out.withColumn("category", F.coalesce(F.try_element_at("look", F.col("r.question_id")), F.lit("__unknown__"))).select("*", "r.question_id", "r.answer").drop("look", "r")


def answer_rates(ans: DataFrame, by: list[str]) -> DataFrame:
    g = ans.groupBy(*by).agg(F.count("*").alias("questions"), *[F.count_if(F.col("answer") == a).alias(a) for a in ANSWERS])
    for a in ANSWERS:
        g = g.withColumn(f"{a}_rate", ratio(F.col(a), F.col("questions")))
    return g


def cells(ans: DataFrame, responses: DataFrame, excluded: tuple[str, ...] = ("count", "relation")) -> DataFrame:
    """By (slice, judge, surface): supported a caption and risk, also without the excluded categories."""
    by = ["slice", "judge", "surface"]
    flag = ~F.col("category").isin(*excluded)
    g = ans.groupBy(*by).agg(
        F.count("*").alias("questions"), *[F.count_if(F.col("answer") == a).alias(a) for a in ANSWERS],
        F.count_if(flag).alias("questions_excl"), F.count_if(flag & (F.col("answer") == "yes")).alias("yes_excl"), F.count_if(flag & (F.col("answer") == "no")).alias("no_excl"),
    )
    r = responses.groupBy(*by).agg(F.count("*").alias("responses"))
    j = r.join(g, by, "left").fillna(0)
    for tail in ("", "_excl"):
        j = j.withColumn(f"supported_cap{tail}", ratio(F.col(f"yes{tail}"), F.col("responses"))).withColumn(f"risk{tail}", ratio(F.col(f"no{tail}"), F.col(f"questions{tail}")))
    return j


def common_requests(rows: DataFrame, slice_col: str = "slice", judge_col: str = "judge", request_col: str = "request_id") -> DataFrame:
    """Rows of the requests that all judges of their slice have answered."""
    judges = rows.groupBy(slice_col).agg(F.count_distinct(judge_col).alias("judges"))
    full = rows.groupBy(slice_col, request_col).agg(F.count_distinct(judge_col).alias("has")).join(judges, slice_col).where("has = judges")
    return rows.join(full.select(slice_col, request_col), [slice_col, request_col], "left_semi")


def judge_agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """Exact agreement of two judges on their common questions by category and over all (__all__)."""
    j = first.select("question_id", "category", F.col("answer").alias("a")).join(second.select("question_id", F.col("answer").alias("b")), "question_id")
    g = j.groupBy("category").agg(F.count("*").alias("questions"), F.count_if(F.col("a") == F.col("b")).alias("same"))
    whole = g.groupBy(F.lit("__all__").alias("category")).agg(F.sum("questions").alias("questions"), F.sum("same").alias("same"))
    return g.unionByName(whole.where("questions is not null")).withColumn("agreement", ratio(F.col("same"), F.col("questions")))


def rerun_overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """From two frames (request_id, keys): requests in both, share of equal key sets, mean Jaccard (1 where both are empty)."""
    j = first.select("request_id", F.array_distinct("keys").alias("a")).join(second.select("request_id", F.array_distinct("keys").alias("b")), "request_id")
    both, either = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    return j.agg(F.count("*").alias("requests"), F.count_if(both == either).alias("exact"), F.avg(F.when(either == 0, 1.0).otherwise(both / either)).alias("jaccard"))


def pareto(points: DataFrame, key: str, up: str, down: str) -> DataFrame:
    """Points with a flag frontier: no other point is at least as high in `up` and as low in `down`, and better in one.

    The distinct values of `up` are sorted over all tasks; the lowest `down` above each is a running minimum within its
    task and the minimum of the tasks before, of which one number each comes to the driver.
    """
    best = held(points.groupBy(up).agg(F.min(down).alias("low")).orderBy(F.desc(up))).withColumn("_p", F.spark_partition_id())
    lows = {r["_p"]: r["low"] for r in best.groupBy("_p").agg(F.min("low").alias("low")).collect()}
    before, least = {}, None
    for p in sorted(lows):
        before[p] = least
        least = lows[p] if least is None else min(least, lows[p])
    kind = best.schema["low"].dataType
    carried = F.create_map(*[x for p, v in before.items() for x in (F.lit(p), F.lit(v).cast(kind))])[F.col("_p")] if before else F.lit(None).cast(kind)
    own = F.min("low").over(Window.partitionBy("_p").orderBy(F.desc(up)).rowsBetween(Window.unboundedPreceding, -1))
    j = points.join(best.select(up, "low", F.least(carried, own).alias("low_above")), up)
    return j.withColumn("frontier", (F.col(down) == F.col("low")) & (F.col("low_above").isNull() | (F.col(down) < F.col("low_above")))).drop("low", "low_above")


def _histogram(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, c, upto, n): how often each value stands there, with running sums: windows sort values, not rows."""
    w = Window.partitionBy(*by)
    h = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    return h.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))


def nearest_rank(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """By group the value at the position (n - 1) q, rounded half to even, of the sorted values."""
    at = F.rint((F.col("n") - 1) * q)
    return _histogram(df, by, value).where((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).select(*by, F.col(value).alias("value"))


def trimmed_mean(df: DataFrame, by: list[str], value: str, trim: float = 0.1) -> DataFrame:
    """By group the mean without the int(n trim) lowest and highest values; with all of them where none would be left."""
    k = F.floor(F.col("n") * trim)
    k = F.when(F.col("n") - 2 * k <= 0, F.lit(0)).otherwise(k)
    taken = F.greatest(F.lit(0), F.least("upto", F.col("n") - k) - F.greatest(F.col("upto") - F.col("c"), k))
    h = _histogram(df, by, value).withColumn("taken", taken)
    return h.groupBy(*by).agg((F.sum(F.col(value) * F.col("taken")) / F.sum("taken")).alias("value"))


def judge_records(ans: DataFrame, pos: str = "pos") -> DataFrame:
    """By judge and question: the last answer, how many rows there were, and whether they disagreed."""
    return ans.groupBy("judge", "question_id").agg(F.max_by("answer", pos).alias("answer"), F.count("*").alias("rows"), (F.count_distinct("answer") > 1).alias("conflict"))


def candidate_pool(claim_rows: DataFrame, records: DataFrame, judges: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Claims (question_id, ...) with an answer of every judge about the same image, as (question_id, ..., <judge>...), and the
    counts of what was rejected: answers missing, images that differ.

    records has (judge, question_id, answer, image_key); a judge's answers are pivoted to one row a question before the join.
    """
    wide = records.where(F.col("judge").isin(*judges)).groupBy("question_id").agg(
        *[F.max(F.when(F.col("judge") == j, F.col("answer"))).alias(j) for j in judges], F.count_distinct(F.coalesce("image_key", F.lit(""))).alias("images"),
    )
    full = F.lit(True)
    for j in judges:
        full = full & F.col(j).isNotNull()
    j = claim_rows.join(wide, "question_id", "left").withColumn("full", F.coalesce(full, F.lit(False))).withColumn("same", F.coalesce(F.col("images") == 1, F.lit(False)))
    counts = j.agg(F.count("*").alias("claims"), F.count_if(F.expr("full and same")).alias("joined"), F.count_if(F.expr("not full")).alias("missing_answer"), F.count_if(F.expr("full and not same")).alias("image_differs"))
    return j.where("full and same").drop("full", "same", "images"), counts
